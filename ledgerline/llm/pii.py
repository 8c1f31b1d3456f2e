"""Personal data, disguised or not, with offsets in the source text.

Plain identifiers are found in the text as it is.  Disguises are undone by
transducers that keep, for every character they write, the stretch of source it
came from: look-alike letters and digits, spelled digits, and spelled or
bracketed "at" and "dot".  Identifiers found in the normalised text are mapped
back through these stretches.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]

_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Each @ with the run of local characters before it and a dotted name after it; linear in the text."""
    at, free = text.find("@"), 0
    while at >= 0:
        local = len(text[free:at]) - len(text[free:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield m.span()


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def plain(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of plain identifiers, by kind, then start; leftmost, not overlapping within a kind."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
    return out


# fixed values: letters of other scripts that look like ASCII ones
_LOOKS = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "ABESIJKMHOPCTYXaesijopcyxhdqwABEZHIKMNOPTYXoa", strict=True))
# fixed values: characters that are not seen
_UNSEEN = "­​‌‍‎‏⁠﻿"
# fixed values: spelled digits
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _compatible() -> dict[str, str]:
    """Characters whose compatibility form is one ASCII character: full width, mathematical, circled and the like."""
    forms = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(160, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return {c: f for c, f in forms if len(f) == 1 and f.isascii() and f.isprintable()}


#: look-alike of an ASCII character, or nothing for what is not seen
LOOKS = _compatible() | _LOOKS | dict.fromkeys(_UNSEEN, "")
_LOOK = re.compile("[" + re.escape("".join(LOOKS)) + "]")
#: where look-alikes can be: not ASCII and not the letters of Latin-1
_BEYOND = re.compile("[\u0080-\u00bf\u0100-\U0010ffff]")

_NUMBER = "|".join(_DIGITS)
# between digits: possessive, for no digit begins with what may stand between; so time is linear in any run
_BETWEEN = r"(?:\s++dot\s++|[\s-]*+)"
# a digit ends a word, or another spelled one follows at once
_EACH = rf"(?:{_NUMBER}|[0-9])(?:(?={_NUMBER})|(?![a-z]))"
_SPELLED = re.compile(rf"(?i)(?<![a-z])(?:(plus)[\s-]*+)?({_EACH}(?:{_BETWEEN}{_EACH}){{2,}})")
_ONE = re.compile(rf"(?i){_NUMBER}|[0-9]")
# what every match of _SPELLED with a spelled digit has: such a digit beside another, spelled or plain
_MAYBE_SPELLED = re.compile(rf"(?:{_NUMBER}){_BETWEEN}(?:{_NUMBER}|[0-9])|[0-9]{_BETWEEN}(?:{_NUMBER})")
_BRACKETED = re.compile(r"(?i)[\[({<]\s*+(at|dot|@|\.)\s*+[\])}>]\s*+")
# fixed values: characters of an address as a URL writes them
_ESCAPES = {"%40": "@", "%2e": "."}
_ESCAPED = re.compile(r"(?i)(?<=[a-z0-9])%(?:40|2e)(?=[a-z0-9])")
# fixed values: letters written for digits
_LETTERS = {"l": "1", "I": "1", "i": "1", "|": "1", "O": "0", "o": "0", "S": "5", "B": "8"}
_CARDLIKE = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[\x20-]?[0-9lIi|OoSB])++(?![A-Za-z0-9])")
_NO_CARD = re.compile(r"[0-9][\x20-]?[lIi|OoSB]")
# fixed values: last parts of names, without country codes that are common English words (as, is, to and the like)
_CODES = ("ac ad ae af ag ai al ao aq ar at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm dz ec ee eg er "
          "es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb "
          "lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs "
          "ru rw sa sb sc sd se sg sh si sj sk sl sm sn sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw")
_ENDS = "com|org|net|edu|gov|mil|int|info|biz|app|dev|test|example|" + "|".join(_CODES.split())
# a spelled "at" counts only before a dotted name that ends in one; after a real dot the end is in small letters
_AT = re.compile(rf"(?i)(?<=[a-z0-9])\x20++at\x20++(?=[a-z0-9-]++(?:(?:\x20++dot\x20++|\.)[a-z0-9-]++)*?(?:\x20++dot\x20++(?:{_ENDS})|\.(?-i:{_ENDS}))(?![a-z0-9-]|\.[a-z0-9]))")
# fixed values: words before "at" that are no names, where the name has only real dots
_NO_NAMES = set("look looks looked looking available online hosted is are was were be it us me them him her page site website here more read found see visit arrive arrived meet live based".split())
_WORD_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_REAL_DOTS = re.compile(r"[A-Za-z0-9-]+\.")
# fixed values: what announces an address; a name of only real dots is one only after it ("mail jane at example.com", not "shops at example.com")
_INTENT = re.compile(r"(?i)(?:\b(?:e-?mail|mail|contact|address|inbox|write|reach)(?:\x20(?:is|to|me|us))?|[:<(\[=])\x20*\Z")
_DOT = re.compile(r"(?i)(?<=[a-z0-9-])\x20++dot\x20++(?=[a-z0-9])")


@dataclass
class Mapped:
    """A text, and for each of its characters the stretch of source it stands for and whether that was changed."""

    text: str
    start: np.ndarray
    end: np.ndarray
    changed: np.ndarray

    @classmethod
    def of(cls, text: str) -> Mapped:
        at = np.arange(len(text))
        return cls(text, at, at + 1, np.zeros(len(text), bool))

    def rewritten(self, pattern: re.Pattern, new: Callable[[re.Match, int], list[tuple[int, int, str]]]) -> Mapped:
        """With parts of each match written anew: ``new`` lists ``start, end, string``, given the match and where the last part ended.

        Each written character stands for the whole part; a part written as
        nothing goes.
        """
        texts, starts, ends, marks, at = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            for a, b, s in new(m, at):
                texts += [self.text[at:a], s]
                starts += [self.start[at:a], np.full(len(s), self.start[a])]
                ends += [self.end[at:a], np.full(len(s), self.end[b - 1])]
                marks += [self.changed[at:a], np.ones(len(s), bool)]
                at = b
        if not texts:
            return self
        return Mapped("".join([*texts, self.text[at:]]), *(np.concatenate([*x, y[at:]]) for x, y in ((starts, self.start), (ends, self.end), (marks, self.changed))))


def _digits(m: re.Match, _: int) -> list[tuple[int, int, str]]:
    """A run of digits of which some are spelled: each by itself, what is between them gone."""
    found = list(_ONE.finditer(m.string, m.start(2), m.end(2)))
    if all(x[0].isdigit() for x in found):
        return []
    out = [(m.start(1), found[0].start(), "+")] if m[1] else []
    for i, x in enumerate(found):
        digit = _DIGITS.get(x[0].lower(), x[0])
        if i + 1 == len(found):
            out.append((*x.span(), digit))
        elif "dot" in m.string[x.end():found[i + 1].start()].lower():
            out += [(*x.span(), digit), (x.end(), found[i + 1].start(), ".")]
        else:
            out.append((x.start(), found[i + 1].start(), digit))
    return out


def _at(m: re.Match, _: int) -> list[tuple[int, int, str]]:
    before = _WORD_BEFORE.search(m.string, max(0, m.start() - 64), m.start())
    if before and _REAL_DOTS.match(m.string, m.end()) and (before[0].lower() in _NO_NAMES or not _INTENT.search(m.string, max(0, before.start() - 32), before.start())):
        return []
    return [(*m.span(), "@")]


def _bracketed(m: re.Match, at: int) -> list[tuple[int, int, str]]:
    """With the white space before it, looked back for here: each stretch of it is passed once."""
    start = m.start()
    while start > at and m.string[start - 1].isspace():
        start -= 1
    return [(start, m.end(), "@" if m[1].lower() in ("at", "@") else ".")]


def _card_letters(m: re.Match, _: int) -> list[tuple[int, int, str]]:
    """The letters in what is a card's number once they are digits; at most one in four."""
    written = [(i, c) for i, c in enumerate(m[0]) if c not in " -"]
    letters = [(i, c) for i, c in written if c in _LETTERS]
    digits = "".join(_LETTERS.get(c, c) for _, c in written)
    if not letters or 4 * len(letters) > len(written) or not 13 <= len(digits) <= 19 or not _luhn(digits):
        return []
    return [(m.start() + i, m.start() + i + 1, _LETTERS[c]) for i, c in letters]


def normalised(text: str) -> Mapped | None:
    """The text with disguises undone, or None where there is no sign of one."""
    # cheap tests first: nearly all texts end here
    looks = not text.isascii() and _BEYOND.search(text) and not LOOKS.keys().isdisjoint(set(text))
    now = Mapped.of(text).rewritten(_LOOK, lambda m, _: [(*m.span(), LOOKS[m[0]])]) if looks else None
    seen = now.text if now else text
    low = seen.lower()
    bracketed = any(c in low for c in "[({<") and _BRACKETED.search(low)
    # letters that are not ASCII and equal ASCII ones regardless of case
    low = low if low.isascii() else low.replace("i\u0307", "i").replace("\u0131", "i").replace("\u017f", "s")
    spelled = any(w in low for w in _DIGITS) and _MAYBE_SPELLED.search(low)
    named = " at " in low and _AT.search(seen)
    escaped = "%" in low and _ESCAPED.search(low)
    lettered = _NO_CARD.search(seen)
    if not (looks or bracketed or spelled or named or escaped or lettered or " dot " in low):
        return None
    now = now or Mapped.of(text)
    for pattern, new in ((_BRACKETED, _bracketed), (_ESCAPED, lambda m, _: [(*m.span(), _ESCAPES[m[0].lower()])]), (_AT, _at),
                         (_SPELLED, _digits), (_DOT, lambda m, _: [(*m.span(), ".")]), (_CARDLIKE, _card_letters)):
        now = now.rewritten(pattern, new)
    return now


def found(text: str) -> list[tuple[str, int, int, bool]]:
    """``kind, start, end, base``: plain identifiers and those that a disguise hid, by kind, start and end.

    A disguised one counts if something in it was changed and it does not lie
    within a plain one of its kind.
    """
    base = plain(text)
    out = {(k, a, b): True for k, a, b in base}
    hidden = normalised(text)
    if hidden:
        within: dict[str, list[Span]] = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
        for kind, a, b in plain(hidden.text):
            start, end = int(hidden.start[a]), int(hidden.end[b - 1])
            changed = hidden.changed[a:b].any() or end - start != b - a
            if changed and not any(x <= start and end <= y for x, y in within[kind]):
                out.setdefault((kind, start, end), False)
    return sorted(((k, a, b, is_base) for (k, a, b), is_base in out.items()), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def detected(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans``: one row per row of ``docs``, repeated rows too.

    ``spans`` is an array of ``kind, start, end, base`` in code points, end
    exclusive, by kind, then start and end; empty for a null or empty text.
    Each text is handled whole, by itself, in time linear in its length; equal
    texts get equal spans and null keys stay.  An empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    names = ("kind", "start", "end", "base")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[dict(zip(names, s)) for s in found(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, spans)], ["key", "spans"])

    return rows.mapInArrow(work, f"key {kind}, spans array<struct<kind: string, start: int, end: int, base: boolean>>")
