"""Comparison keys, each a chain of native column expressions.

The profiles differ on purpose and must not be swapped for one another: some
keep every script, some keep only ASCII, some fold accents and some drop the
accented letter.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import fixed
from ledgerline.functions.text import (
    ascii_key, casefold, col, decompose, demojibake, fold, let, non_empty, rx, squeeze,
    text_or_empty, transliterate, words_only,
)


# --- title keys ------------------------------------------------------------------
def key_fold(c) -> Column:
    return fold(c)


def _where(t: Column, guard, body) -> Column:
    """``body`` of the texts that ``guard`` lets through, the others as they are."""
    return let(t, lambda x: F.when(guard(x), body(x)).otherwise(x))


def _holds(*pieces: str):
    """Guard: any of the pieces occurs.  Much cheaper than a pattern that is tried at every letter."""
    return lambda x: reduce(or_, (F.contains(x, F.lit(p)) for p in pieces))


def _ends(words: str):
    """Guard: the text may end in one of ``words`` (at most 20 letters each) and white space; looks at its last 40 letters only."""
    return lambda x: F.substring(x, -40, 40).rlike(rf"(?U)(?:{words}|\s{{20}})\s*$")


def key_song_title(c) -> Column:
    t = _where(fold(c), _holds("(", "[", "{"), lambda x: F.regexp_replace(x, fixed.ANY_BRACKETS, " "))
    t = _where(t, _holds("feat", "ft", "with"), lambda x: rx(x, fixed.FEATURE_CLAUSE, " "))
    t = _where(t, _ends(fixed.NOISE_TAIL_ENDS), lambda x: rx(rx(x, fixed.NOISE_TAIL, ""), fixed.NOISE_TAIL, ""))
    t = _where(rx(t, fixed.LEAD_TRACK, ""), _ends(r"\d"), lambda x: rx(x, fixed.TRAIL_DISC, ""))
    return F.trim(words_only(t))


def key_credit_artist(c) -> Column:
    a = F.trim(words_only(F.replace(fold(c), F.lit("&"), F.lit(" and "))))
    return F.trim(F.regexp_replace(a, "^the +", ""))


def key_compact_title(c) -> Column:
    t = F.lower(F.regexp_replace(text_or_empty(c), fixed.PAIRED_ALL, " "))
    t = rx(F.replace(t, F.lit("&"), F.lit(" and ")), r"^\s*the\s+", "")
    spelled = t
    for short, full in fixed.TITLE_ABBREVIATIONS:
        spelled = rx(spelled, rf"\b{short}\b\.?", full)
    has_short = F.contains(t, F.lit("pt")) | F.contains(t, F.lit("vol"))
    return ascii_key(F.when(has_short, spelled).otherwise(t))


def key_compact_artist(c) -> Column:
    return ascii_key(F.replace(fold(c), F.lit("&"), F.lit("and")))


def key_album_title(c) -> Column:
    t = F.replace(F.lower(text_or_empty(c)), F.lit("&"), F.lit(" and "))
    return ascii_key(F.regexp_replace(t, fixed.ROUND_SQUARE, " "))


def key_script_artist(c) -> Column:
    """Cross-script artist key; a script it cannot spell becomes code points."""

    def strip_titles(v: Column) -> Column:
        s = rx(decompose(v), r"^\s*the\s+", "")
        return rx(s, fixed.HONORIFIC, "$1")

    def spell(s: Column) -> Column:
        points = F.array_join(
            F.transform(non_empty(F.split(rx(s, r"\s+", ""), "")), lambda ch: F.lower(F.hex(F.ascii(ch)))), "")
        return F.when(ascii_key(s) != "", ascii_key(s)).when(points != "", F.concat(F.lit("u"), points)).otherwise("")

    repaired = let(text_or_empty(c), demojibake)
    latin = let(let(repaired, transliterate), casefold)
    return let(let(F.replace(latin, F.lit("&"), F.lit(" and ")), strip_titles), spell)


def key_transliterate(c) -> Column:
    return transliterate(c)


def key_demojibake(c) -> Column:
    return demojibake(c)


def key_stage_prefix(c) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), "(?U)" + fixed.STAGE_PREFIX, ""))


def key_alias_name(c) -> Column:
    return ascii_key(let(casefold(c), decompose))


def key_release_title(c) -> Column:
    s = F.regexp_replace(F.lower(text_or_empty(c)), fixed.PAIRED_ROUND_SQUARE, " ")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def _dashes_and_brackets(c) -> Column:
    s = F.regexp_replace(text_or_empty(c), fixed.PAIRED_ROUND_SQUARE, " ")
    return F.regexp_replace(s, fixed.DASHES, "-")


def key_search_term(c) -> Column:
    return squeeze(rx(_dashes_and_brackets(c), fixed.SEARCH_PUNCT, " "))


# --- folder and path keys ----------------------------------------------------------
def _edge_trim(c: Column) -> Column:
    return F.regexp_replace(rx(c, r"\s{2,}", " "), r"^[ \-_.]+|[ \-_.]+$", "")


def key_folder_album(name, artist) -> Column:
    s = F.trim(rx(rx(text_or_empty(name), fixed.ANY_BRACKETS, " "), r"\s{2,}", " "))
    s = rx(rx(s, fixed.LEAD_NUMBER, ""), fixed.LEAD_YEARS, "")
    s = F.regexp_replace(s, "(?U)" + fixed.ARTIST_YEAR_ALBUM, "$1")
    who = F.trim(text_or_empty(artist))
    quoted = F.concat(F.lit(r"\Q"), F.replace(who, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    lead = F.concat(F.lit(r"(?iU)^\s*"), quoted, F.lit(r"\b[^-]*?-\s*"))
    return _edge_trim(F.when(who == "", s).otherwise(F.regexp_replace(s, lead, F.lit(""))))


def key_folder_artist(c) -> Column:
    s = rx(rx(text_or_empty(c), fixed.ANY_BRACKETS, " "), r"@\S+", " ")
    s = rx(rx(s, fixed.FOLDER_ARTIST_NOISE, " "), fixed.ANY_YEAR, " ")
    return _edge_trim(F.substring_index(s, " - ", 1))


def key_year(c) -> Column:
    return F.regexp_extract(text_or_empty(c), fixed.LONE_YEAR, 1)


def path_parts(c) -> Column:
    return non_empty(F.split(F.translate(text_or_empty(c), "\\", "/"), "/"))


def file_name(c) -> Column:
    return F.coalesce(F.try_element_at(path_parts(c), F.lit(-1)), F.lit(""))


def file_ext(c) -> Column:
    """Lower-case extension without the dot; a leading dot is part of the stem."""
    return F.lower(F.regexp_extract(file_name(c), r"^\.*[^.].*\.([^.]*)$", 1))


def file_stem(c) -> Column:
    return F.regexp_replace(file_name(c), r"^(\.*[^.].*)\.[^.]*$", "$1")


def album_folder_parts(folders: Column) -> Column:
    """Drop disc, art and bonus folders off the end, always keeping one."""
    last_real = F.array_max(F.transform(
        folders, lambda p, i: F.when(~p.rlike("(?U)" + fixed.LEAF_FOLDER), i + 1)))
    return F.when(F.size(folders) == 0, folders).otherwise(
        F.slice(folders, F.lit(1), F.greatest(F.coalesce(last_real, F.lit(1)), F.lit(1))))


def key_path_album_dir(path, fallback) -> Column:
    def climb(parts: Column) -> Column:
        folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        return let(folders, lambda f: F.array_join(album_folder_parts(f), "/"))

    folder = let(path_parts(path), climb)
    return F.when(folder == "", col(fallback)).otherwise(folder)


def key_path_tail2(path) -> Column:
    def tail(parts: Column) -> Column:
        n = F.greatest(F.least(F.size(parts), F.lit(2)), F.lit(1))
        return F.when(F.size(parts) == 0, parts).otherwise(F.slice(parts, -n, n))

    return F.lower(F.array_join(let(path_parts(path), tail), "/"))


def key_path_remap(path, source_root: str, target_root: str) -> Column:
    """Struct of the remapped path and whether the source root covered it."""
    raw = F.translate(text_or_empty(path), "\\", "/")
    src = source_root.replace("\\", "/").rstrip("/")
    dst = target_root.rstrip("/")
    inside = F.startswith(F.lower(raw), F.lit(src.lower()))
    rest = F.regexp_replace(F.substr(raw, F.lit(len(src) + 1)), "^/+", "")
    moved = F.when(rest == "", F.lit(dst)).otherwise(F.concat(F.lit(dst + "/"), rest))
    return F.struct(F.when(inside, moved).otherwise(raw).alias("path"), inside.alias("mapped"))


def key_path_under_root(path, save_root, target_root: str) -> Column:
    """Swap a per-row save root for ``target_root``; else keep only the base name."""
    raw = F.translate(text_or_empty(path), "\\", "/")
    root = F.regexp_replace(F.translate(text_or_empty(save_root), "\\", "/"), "/+$", "")
    inside = (root != "") & ((raw == root) | F.startswith(raw, F.concat(root, F.lit("/"))))
    rest = F.regexp_replace(F.substr(raw, F.length(root) + 1), "^/+", "")
    tail = F.when(inside, rest).otherwise(F.substring_index(raw, "/", -1))
    return F.when(tail == "", F.lit(target_root)).otherwise(F.concat(F.lit(target_root + "/"), tail))


def key_infohash(*candidates) -> Column:
    """First hash in a magnet link, else a bare 40-hex or 32-base32 value."""
    found = [F.nullif(F.lower(F.regexp_extract(text_or_empty(c), fixed.MAGNET_HASH, 1)), F.lit("")) for c in candidates]
    bare = F.lower(F.trim(text_or_empty(candidates[-1])))
    return F.coalesce(*found, F.when(bare.rlike(fixed.BARE_HASH), bare), F.lit(""))


def key_entry_id(c) -> Column:
    return F.substring(F.sha1(text_or_empty(c).cast("binary")), 1, 12)


# --- names built from parts ----------------------------------------------------------
def safe_file_part(c, fallback: str = "track") -> Column:
    s = F.regexp_replace(F.trim(F.regexp_replace(text_or_empty(c), fixed.BAD_FILE_CHARS, "_")), r"\.+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def key_safe_name(album, date) -> Column:
    """``Album (Year)`` without empty brackets or characters no file system takes."""
    year = F.trim(F.substring_index(F.trim(text_or_empty(date)), "-", 1))
    name = F.concat(text_or_empty(album), F.lit(" ("), year, F.lit(")"))
    name = rx(name, r"\s*[\(\[]\s*[-\s,]*\s*[\)\]]", "")
    name = F.regexp_replace(rx(name, r"\s{2,}", " "), r"^[ \-_.,]+|[ \-_.,]+$", "")
    name = F.regexp_replace(F.trim(F.regexp_replace(name, fixed.BAD_FILE_CHARS, "_")), r"[. ]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(text_or_empty(album), F.lit("")), F.lit("Unknown Album"))


def track_file_name(number, title, ext: str = "flac") -> Column:
    title_or = F.coalesce(F.nullif(text_or_empty(title), F.lit("")),
                          F.format_string("Track %02d", col(number)))
    return F.concat(F.format_string("%02d - ", col(number)), safe_file_part(title_or), F.lit("." + ext))


def _clean_stem(c) -> Column:
    s = F.trim(F.translate(file_stem(c), "_", " "))
    return rx(rx(s, fixed.LEAD_TRACK, ""), fixed.TRAIL_DISC, "")


def _stem_parts(stem: Column) -> Column:
    spaced = F.split(stem, " - ")
    dashed = F.split(stem, "-")
    raw = F.when(F.contains(stem, F.lit(" - ")), spaced).when(F.contains(stem, F.lit("-")), dashed) \
        .otherwise(F.array().cast("array<string>"))
    return non_empty(F.transform(raw, lambda p: F.trim(p)))


def key_titles_from_name(c) -> Column:
    """Candidate titles of a file name, best guess first."""
    unnumbered = lambda x: rx(x, r"^\s*\d{1,3}\s+", "")

    def guess(stem: Column) -> Column:
        bare = unnumbered(stem)
        whole = F.array(stem, F.when(bare != stem, bare))

        def split_up(parts: Column) -> Column:
            last, first = F.element_at(parts, -1), F.element_at(parts, 1)
            return F.when(F.size(parts) >= 2, F.array(
                last, first, F.when(unnumbered(last) != last, unnumbered(last)))).otherwise(F.array().cast("array<string>"))

        return F.concat(whole, let(_stem_parts(stem), split_up))

    return F.filter(let(_clean_stem(c), guess), lambda x: x.isNotNull() & (x != ""))


def key_artists_from_name(c) -> Column:
    def both_ends(parts: Column) -> Column:
        picks = []
        for i in (1, -1):
            part = F.element_at(parts, i)
            bare = rx(part, r"^\s*\d{1,3}\s*[-_.]?\s*\d{0,3}\s+", "")
            picks += [part, F.when(bare != part, bare)]
        return F.when(F.size(parts) >= 2, F.array(*picks)).otherwise(F.array().cast("array<string>"))

    parts = let(_clean_stem(c), lambda stem: let(_stem_parts(stem), both_ends))
    return F.filter(parts, lambda x: x.isNotNull() & (x != ""))


# --- set-valued keys -------------------------------------------------------------------
def _set_text(words: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def artist_words(c) -> Column:
    low = F.replace(fold(c), F.lit("&"), F.lit(" and "))
    return F.array_distinct(non_empty(F.split(low, "[^a-z0-9]+")))


def key_credit_sets(c) -> Column:
    """Acts credited in an artist string, each as its sorted words in one string."""

    def cut_guests(raw: Column) -> Column:
        # the first listed cut word decides, and only where it does not open the text
        low, out = F.lower(raw), raw
        for word in reversed(fixed.CREDIT_CUTS):
            at = F.locate(" " + word, low)
            follow = F.substr(raw, at + len(word) + 1, F.lit(1))
            out = F.when((at > 1) & ~follow.rlike(r"^\p{L}"), F.substr(raw, F.lit(1), at - 1)).otherwise(out)
        return out

    noise = F.array(*[F.lit(w) for w in fixed.CREDIT_NOISE])
    acts = F.transform(F.split(let(F.regexp_replace(text_or_empty(c), fixed.ROUND_SQUARE, " "), cut_guests), "[&/,;]| and "),
                       lambda part: _set_text(F.array_except(artist_words(part), noise)))
    return F.array_sort(F.array_distinct(non_empty(acts)))


def key_variant_markers(c) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(fixed.VARIANT_MARK), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.trim(m))))


def _plain_words(c) -> Column:
    return non_empty(F.split(F.translate(F.lower(key_search_term(c)), "-", " "), r"\s+"))


def key_identity_tokens(title, artist) -> Column:
    noise = F.array(*[F.lit(w) for w in fixed.IDENTITY_NOISE])
    left = F.array_except(F.array_except(_plain_words(title), _plain_words(artist)), noise)
    keep = F.filter(left, lambda w: (F.length(w) > 1) & ~w.rlike(r"^\p{N}+$"))
    return F.array_sort(keep)


def key_search_variants(title, artist, *, trim_years: bool = True) -> Column:
    """Up to three queries for a title, most specific first.

    Trailing years are cut off a term unless the last number is known to be something else, such as a volume.
    """
    without_years = lambda term: F.trim(rx(term, fixed.TRAIL_YEARS, "")) if trim_years else term
    who = squeeze(text_or_empty(artist))
    base = key_search_term(title)
    trimmed = without_years(base)
    head_raw = F.element_at(F.split(_dashes_and_brackets(title), "(?U)" + fixed.SUBTITLE, 2), 1)
    head = without_years(key_search_term(head_raw))
    shapes = F.filter(F.array_distinct(F.array(base, trimmed, head)), lambda s: s != "")
    terms = F.transform(shapes, lambda s: F.when(
        (who == "") | F.contains(F.lower(s), F.lower(who)), s).otherwise(F.concat_ws(" ", who, s)))
    usable = F.filter(terms, lambda t: (F.lower(t) != F.lower(who)) & F.contains(t, F.lit(" ")))
    # keep the first spelling of terms that differ only by case
    lows = F.transform(usable, lambda t: F.lower(t))
    firsts = F.filter(usable, lambda t, i: F.array_position(lows, F.lower(t)) == i + 1)
    return F.when(base == "", F.array().cast("array<string>")).otherwise(firsts)


def fill_missing_tags(df: DataFrame, path: str, title: str, track: str, album: str, artist: str) -> DataFrame:
    """Fill only the absent tags from ``.../Artist/Album (Year)/NN - Title.ext``."""
    stem = file_stem(path)
    numbered = r"^\s*(\d{1,3})\s*[-._ ]+\s*(.+)$"
    has_number = stem.rlike("(?U)" + numbered)
    number = F.regexp_extract(stem, "(?U)" + numbered, 1)
    number = F.coalesce(F.nullif(F.regexp_replace(number, "^0+", ""), F.lit("")), number)
    name = F.when(has_number, F.regexp_extract(stem, "(?U)" + numbered, 2)).otherwise(stem)
    parts = path_parts(path)
    album_dir = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    artist_dir = F.coalesce(F.try_element_at(parts, F.lit(-3)), F.lit(""))
    guess = {
        title: F.regexp_replace(name, r"^[ \-_.]+|[ \-_.]+$", ""),
        track: F.when(has_number, number),
        album: F.trim(rx(album_dir, r"\s*[\(\[]\d{4}[\)\]]\s*$", "")),
        artist: artist_dir,
    }
    return df.withColumns({
        k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.nullif(v, F.lit(""))) for k, v in guess.items()})


def with_key(df: DataFrame, name: str, key: Column) -> DataFrame:
    return df.withColumn(name, key)
