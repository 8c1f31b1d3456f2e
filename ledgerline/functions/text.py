"""Unicode text folding as native column expressions.

Spark has no NFKD builtin, so the decomposition is turned into one
``translate`` map (a single pass per string inside codegen).  The map comes
from ``unicodedata`` when the module is first used:

* a character that decomposes to exactly one base character maps to it;
* a combining mark maps to nothing (``translate`` drops it);
* the few characters that decompose to several go through a small literal map,
  which only rows that contain such a character evaluate.

Hangul syllables are left composed: their decomposition is one-to-one, so it
cannot change whether two keys are equal.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import fixed


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind a compound expression once, so that ``body`` may use it many times.

    Without it the expression tree grows with every use and the optimizer, not
    the data, becomes the cost.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def epoch_s(c) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(c).cast("timestamp_ntz"))


def _strip(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", s)
                   if not unicodedata.combining(ch))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    source, target, marks, several = [], [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        ch = chr(point)
        base = _strip(ch)
        if base == ch:
            continue
        if len(base) == 1:
            source.append(ch)
            target.append(base)
        elif not base:
            marks.append(ch)
        else:
            several.append((ch, base))
    return "".join(source) + "".join(marks), "".join(target), tuple(several)


@lru_cache(maxsize=1)
def _casefold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    source, target, several = [], [], []
    for point in range(0x80, 0x1F000):
        ch = chr(point)
        low, full = ch.lower(), ch.casefold()
        if low == full or 0xD800 <= point <= 0xDFFF:
            continue
        if len(full) == 1:
            source.append(ch)
            target.append(full)
        else:
            several.append((ch, full))
    return "".join(source), "".join(target), tuple(several)


def char_class(chars) -> str:
    """A regex class matching ``chars``, written as code-point ranges."""
    points = sorted(ord(c) for c in chars)
    spans: list[list[int]] = []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


@lru_cache(maxsize=4)
def _spelled_out(pairs: tuple[tuple[str, str], ...], gaps: int = 24) -> tuple[str, str, str]:
    """For :func:`_expand`: a quick pattern that any character of ``pairs`` meets, the exact one, and the pairs in one text.

    A class of a thousand points is tested point by point; the quick one leaves
    out the runs without any of them in the Latin blocks and the widest elsewhere,
    where nearly all letters lie.
    """
    points = sorted(ord(k) for k, _ in pairs)
    runs = [(a + 1, b - 1) for a, b in zip([-1, *points], [*points, sys.maxunicode + 1]) if b - a > 1]
    widest = sorted(sorted(runs, key=lambda r: (r[0] >= 0x250, r[0] - r[1]))[:gaps])
    quick = "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in widest) + "]"
    return quick, f"(?={quick}){char_class(k for k, _ in pairs)}", "\x02".join(f"{k}\x01{v}" for k, v in pairs)


def _expand(c: Column, pairs) -> Column:
    """Replace single characters by longer strings, only where one occurs and only those that do."""
    quick, exact, listed = _spelled_out(pairs)
    # one literal that the optimizer folds into a constant map
    table = F.str_to_map(F.lit(listed), F.lit("\x02"), F.lit("\x01"))
    met = F.array_distinct(F.regexp_extract_all(c, F.lit(exact), F.lit(0)))
    spelled = F.aggregate(met, c, lambda text, ch: F.replace(text, ch, F.element_at(table, ch)))
    return F.when(c.rlike(quick), spelled).otherwise(c)


def unless_ascii(c: Column, otherwise: Column) -> Column:
    """``c`` itself where it is plain ASCII (as many bytes as characters)."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(otherwise)


def decompose(c) -> Column:
    """NFKD without combining marks."""
    source, target, several = _fold_tables()
    c = text_or_empty(c)
    return unless_ascii(c, F.translate(_expand(c, several), source, target))


def fold(c) -> Column:
    """NFKD without combining marks, then lower case."""
    return F.lower(decompose(c))


def casefold(c) -> Column:
    source, target, several = _casefold_tables()
    c = text_or_empty(c)
    return F.lower(unless_ascii(c, F.translate(_expand(c, several), source, target)))


def rx(c, pattern: str, replacement: str = " ") -> Column:
    """Replace every match, with Unicode-aware classes."""
    return F.regexp_replace(col(c), F.lit("(?U)" + pattern), F.lit(replacement))


def squeeze(c) -> Column:
    return F.trim(rx(c, r"\s+", " "))


def words_only(c, gap: str = " ") -> Column:
    """Every run of characters that are not letters or numbers becomes ``gap``."""
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}]+", gap)


def ascii_key(c) -> Column:
    return F.regexp_replace(col(c), "[^a-z0-9]+", "")


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def ascii_words(c) -> Column:
    """Distinct ``[a-z0-9]+`` words of the lower-cased text."""
    return F.array_distinct(non_empty(F.split(F.lower(text_or_empty(c)), "[^a-z0-9]+")))


def demojibake(c) -> Column:
    """Undo cp1251 text that was read as latin-1.

    Only text that is accented almost throughout qualifies: at least three
    letters in U+00C0-U+00FF, those at least 40 % of all letters, every
    character representable in both encodings, and more Cyrillic afterwards.
    """
    raw = text_or_empty(c)
    bytes_ = [b for b in range(0x80, 0x100) if b != 0x98]
    pairs = [(chr(b), bytes([b]).decode("cp1251")) for b in bytes_]
    suspects = F.regexp_count(raw, F.lit(r"[\x{c0}-\x{ff}&&\p{L}]"))
    letters = F.regexp_count(raw, F.lit(r"\p{L}"))
    fixed_text = F.translate(raw, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    latin1 = ~raw.rlike(r"[^\x{00}-\x{97}\x{99}-\x{ff}]")
    # a suspect takes one byte more than a plain letter: no more suspects than extra bytes, no fewer letters than plain ones
    extra = F.octet_length(raw) - F.length(raw)
    plain = F.length(raw) - F.length(F.regexp_replace(raw, "[A-Za-z]+", ""))
    return unless_ascii(raw, F.when(
        latin1 & (extra * 5 >= plain * 2) & (suspects >= 3) & (suspects * 5 >= letters * 2), fixed_text
    ).otherwise(raw))


def transliterate(c) -> Column:
    """Cyrillic to Latin; an upper-case letter capitalises its replacement."""
    out = text_or_empty(c)
    one_from, one_to, several = [], [], []
    for low, latin in fixed.CYRILLIC_LATIN.items():
        for ch, rep in ((low, latin), (low.upper(), latin.capitalize())):
            if len(rep) == 1:
                one_from.append(ch)
                one_to.append(rep)
            else:
                several.append((ch, rep))
    for ch, rep in several:
        out = F.replace(out, F.lit(ch), F.lit(rep))
    return unless_ascii(text_or_empty(c), F.translate(out, "".join(one_from), "".join(one_to)))
