"""Row predicates as native column expressions, plus the filters that need a join."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import fixed
from ledgerline.functions.keys import file_ext, key_album_title, path_parts
from ledgerline.functions.text import ascii_words, col, let, non_empty, text_or_empty


def is_disc_folder(name) -> Column:
    words = non_empty(F.split(F.lower(text_or_empty(name)), "[^a-z0-9]+"))
    return F.exists(words, lambda w: w.rlike(fixed.DISC_NUMBERED)) | (
        (F.size(words) <= 3) & F.exists(words, lambda w: w.rlike(fixed.DISC_WORD)))


def is_noise_category(path_key) -> Column:
    """A containing folder (never the last one) is a noise category."""
    parts = path_parts(path_key)
    outer = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(outer, lambda p: p.rlike("(?U)" + fixed.NOISE_FOLDER))


def is_unofficial_title(title) -> Column:
    return text_or_empty(title).rlike("(?U)" + fixed.UNOFFICIAL)


def is_audio_file(path, extensions: Iterable[str] = fixed.AUDIO_EXT_DOWNLOADS) -> Column:
    return file_ext(path).isin(*extensions)


def is_video_file(path) -> Column:
    low = F.lower(F.translate(text_or_empty(path), "\\", "/"))
    video = low.rlike(fixed.VIDEO_ZONE) | file_ext(path).isin(*fixed.VIDEO_EXT_BUNDLES)
    return ~low.rlike(fixed.AUDIO_ZONE) & video


def only_edition_words(longer: Column, shorter: Column) -> Column:
    """Every word of ``longer`` that ``shorter`` lacks is an edition word or year."""
    extra = F.array_except(longer, shorter)
    return F.forall(extra, lambda w: w.isin(*fixed.EDITION_WORDS) | w.rlike(r"^(?:19|20)\d{2}$"))


def is_wanted(monitored, have, total, has_file, track_monitored, key) -> Column:
    """Track still missing from a monitored album that is not complete."""
    incomplete = (F.coalesce(col(total), F.lit(0)) == 0) | (
        F.coalesce(col(have), F.lit(0)) < col(total))
    return (F.coalesce(col(monitored), F.lit(False)) & incomplete
            & ~F.coalesce(col(has_file), F.lit(False))
            & F.coalesce(col(track_monitored), F.lit(True)) & (text_or_empty(key) != ""))


def searchable_source(kind, interactive, automatic, categories, url) -> Column:
    """Numeric id of a search source that carries audio, else NULL."""
    path = F.regexp_replace(F.regexp_extract(text_or_empty(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+", "")
    head = F.substring_index(path, "/", 1)
    ok = ((F.lower(text_or_empty(kind)) == "torznab")
          & (F.coalesce(col(interactive), F.lit(False)) | F.coalesce(col(automatic), F.lit(False)))
          & F.exists(col(categories), lambda c: (c >= 3000) & (c < 4000))
          & head.rlike(r"^\d+$"))
    return F.when(ok, head.cast("bigint"))


def release_type_admitted(primary, secondary, *, studio_only: bool = True, include_eps: bool = False) -> Column:
    kind = F.lower(F.trim(text_or_empty(primary)))
    wanted = ["album"] + (["ep"] if include_eps else [])
    ok = (kind == "") | kind.isin(*wanted)
    if studio_only:
        low = F.transform(col(secondary), lambda s: F.lower(F.trim(s)))
        ok = ok & ~F.coalesce(F.arrays_overlap(low, F.array(*[F.lit(t) for t in fixed.NON_STUDIO_TYPES])), F.lit(False))
    return ok


def release_is_collection(secondary) -> Column:
    low = F.transform(col(secondary), lambda s: F.lower(F.trim(s)))
    return F.coalesce(F.arrays_overlap(low, F.array(*[F.lit(t) for t in fixed.COLLECTION_TYPES])), F.lit(False))


def release_admission(*, has_video, has_audio, artist, title, seeders, size, albums_filled,
                      min_seeders: int = 1, max_gb_per_album: float = 2.5,
                      placeholder_artists: Iterable[str] = ("various artists", "unknown artist", "va")) -> Column:
    """First reason to refuse a release, or ``admit``."""
    who = F.lower(F.trim(text_or_empty(artist)))
    name = F.lower(text_or_empty(title))
    at = F.locate(who, name) if isinstance(who, str) else F.position(who, name)
    budget = F.lit(max_gb_per_album * 1e9) * F.greatest(F.coalesce(col(albums_filled), F.lit(0)), F.lit(1))
    return (
        F.when(F.coalesce(col(has_video), F.lit(False)), "video")
        .when(~F.coalesce(col(has_audio), F.lit(False)), "no audio")
        .when(who.isin(*placeholder_artists), "placeholder artist")
        .when((F.length(who) <= 4) & (at > 1), "short artist inside title")
        .when(col(size) > budget, "too large")
        .when(F.coalesce(col(seeders), F.lit(0)) < min_seeders, "too few seeders")
        .otherwise("admit")
    )


def stable_groups(df: DataFrame, group: str, modified: str, now, seconds: int) -> DataFrame:
    """Groups whose newest change is at least ``seconds`` old (epoch seconds)."""
    newest = df.groupBy(group).agg(F.max(modified).alias("newest"), F.count("*").alias("n"))
    return newest.filter(F.lit(now) - F.col("newest") >= seconds)


def ancestors(path) -> Column:
    """Every proper ancestor folder of a relative path, nearest last."""

    def climb(parts: Column) -> Column:
        n = F.size(parts)
        # the filter drops the descending 1..0 sequence of a one-part path
        steps = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: i < n)
        return F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))

    return let(path_parts(path), climb)


def self_and_ancestors(path) -> Column:
    return F.array_append(ancestors(path), F.array_join(path_parts(path), "/"))


def _plain_path(path) -> Column:
    """The parts of a path joined by single slashes."""

    def tidy(p: Column) -> Column:
        untidy = F.startswith(p, F.lit("/")) | F.endswith(p, F.lit("/")) | F.contains(p, F.lit("//"))
        return F.when(untidy, F.regexp_replace(F.regexp_replace(p, "/+", "/"), "^/|/$", "")).otherwise(p)

    return let(F.translate(text_or_empty(path), "\\", "/"), tidy)


def _parent(plain: Column) -> Column:
    """The folder of a plain path, empty at the root."""
    return F.substr(plain, F.lit(1), F.length(plain) - F.length(F.substring_index(plain, "/", -1)) - 1)


def exclude_under(df: DataFrame, path: str, excluded: Iterable[str]) -> DataFrame:
    """Drop rows equal to or under an excluded folder.

    The list comes from configuration, so its size is bounded by the caller's
    own argument; an entry that covers the root is refused (it would drop all).
    """
    keep = sorted({"/".join(p for p in e.replace("\\", "/").split("/") if p and p != ".")
                   for e in excluded if e} - {""})
    if not keep:
        return df

    def inside(at: Column) -> Column:
        hit = F.lit(False)
        for k in keep:
            hit = hit | (at == k) | F.startswith(at, F.lit(k + "/"))
        return hit

    return df.filter(~let(_plain_path(path), inside))


def exclude_under_table(df: DataFrame, path: str, excluded: DataFrame, folder: str) -> DataFrame:
    """As :func:`exclude_under` for an exclusion list that is itself a table."""
    roots = excluded.select(F.array_join(path_parts(folder), "/").alias("_root")).filter("_root <> ''").distinct()
    both = let(_plain_path(path), lambda p: F.struct(p.alias("at"), _parent(p).alias("up")))
    rows = df.withColumn("_n", both).withColumns({"_at": F.col("_n.at"), "_in": F.col("_n.up")})
    # folders are far fewer than what they hold: only they climb
    inside = (rows.select("_in").distinct().select("_in", F.explode(self_and_ancestors("_in")).alias("_root"))
              .join(roots, "_root", "left_semi").select("_in").distinct())
    return rows.join(inside, "_in", "left_anti").join(roots, F.col("_at") == F.col("_root"), "left_anti").select(*df.columns)


def facet_filter(df: DataFrame, *, include: Mapping[str, Iterable] | None = None,
                 exclude: Mapping[str, Iterable] | None = None, text: str = "",
                 text_columns: Iterable[str] = (), nested: Mapping[str, str] | None = None, chips: Iterable[Column] = ()) -> DataFrame:
    """Conjunction of chips, per-column value sets and a free-text search.

    A value both included and excluded counts as excluded.  ``nested`` names
    arrays of records and the field of theirs that is searched as well.
    """
    cond = F.lit(True)
    for chip in chips:
        cond = cond & chip
    for name, values in (include or {}).items():
        cond = cond & F.col(name).isin(*values)
    for name, values in (exclude or {}).items():
        cond = cond & ~F.coalesce(F.col(name).isin(*values), F.lit(False))
    asked = text.strip().lower()
    if asked:
        holds = lambda c: F.contains(F.lower(text_or_empty(c)), F.lit(asked))
        within = lambda c, field: F.coalesce(F.exists(c, lambda x: holds(x[field])), F.lit(False))
        inside = [within(c, field) for c, field in (nested or {}).items()]
        found = F.lit(False)
        for h in [*(holds(c) for c in text_columns), *inside]:
            found = found | h
        cond = cond & found
    return df.filter(cond)


def facet_counts(df: DataFrame, columns: Iterable[str], chips: Mapping[str, Column] | None = None) -> DataFrame:
    """``facet, value, n``: rows of every value of the columns and of every chip, in one scan; null values are left out."""
    values = [F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]
    switched = [F.struct(F.lit(name).alias("facet"), F.when(chip, "on").alias("value")) for name, chip in (chips or {}).items()]
    each = df.select(F.explode(F.array(*values, *switched)).alias("x")).select("x.*").filter("value IS NOT NULL")
    return each.groupBy("facet", "value").agg(F.count("*").alias("n"))


def facet_order(column, *, numeric: bool = False) -> Column:
    """What a column is sorted by: the number it begins with, else 0, or its text regardless of case."""
    if not numeric:
        return F.lower(text_or_empty(column))
    number = F.regexp_extract(text_or_empty(column), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def accepted_answer(answers: DataFrame, *, query: str, answer: str, candidates: str,
                    ordinal: str, require_overlap: bool = True) -> DataFrame:
    """Keep an answer only where it names a supplied candidate.

    Exact (case-insensitive) first, then by album key; the pick must share a
    word of four or more letters with the question or contain one another.
    All work is per row on arrays, so nothing shuffles.
    """
    said = F.trim(F.regexp_replace(F.trim(text_or_empty(answer)), "^[`\"' ]+|[`\"' ]+$", ""))
    exact = F.filter(F.col(candidates), lambda c: F.lower(F.trim(c)) == F.lower(said))
    keyed = F.filter(F.col(candidates), lambda c: key_album_title(c) == key_album_title(said))
    pick = F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(keyed, F.lit(1)))
    pick = F.when((said != "") & (F.upper(said) != "NONE"), pick)
    out = answers.withColumn("picked", pick)
    long_words = lambda c: F.filter(ascii_words(c), lambda w: F.length(w) >= 4)
    qk, pk = key_album_title(query), key_album_title("picked")
    contained = (qk != "") & (pk != "") & (F.contains(qk, pk) | F.contains(pk, qk))
    shared = F.size(F.array_intersect(long_words(query), long_words("picked"))) > 0
    if require_overlap:
        out = out.withColumn("picked", F.when(shared | contained, F.col("picked")))
    return out


def grounded_answer(source, artist, album) -> Column:
    """Both parts given and every word of the answer occurs in the source text."""
    said = ascii_words(F.concat_ws(" ", text_or_empty(artist), text_or_empty(album)))
    return ((F.trim(text_or_empty(artist)) != "") & (F.trim(text_or_empty(album)) != "")
            & (F.size(said) > 0) & (F.size(F.array_except(said, ascii_words(source))) == 0))


def shaped_answer(raw, expected) -> Column:
    """A model's JSON reply as an array of JSON strings, whatever its wrapping.

    Accepts a list, an object wrapping a list under a usual key, an object with
    one list, or an object keyed "0", "1", ... with the expected size.
    """
    doc = text_or_empty(raw)
    as_list = lambda j: F.from_json(j, "array<string>")
    bare = F.when(F.ltrim(doc).startswith("["), as_list(doc))
    # top-level keys and values; a bad document gives NULL and is refused
    pairs = F.when(F.ltrim(doc).startswith("{"), F.from_json(doc, "map<string,string>"))
    wrapped = [F.when(F.ltrim(pairs[k]).startswith("["), as_list(pairs[k])) for k in fixed.ANSWER_WRAPPERS]
    values = F.map_values(pairs)
    single = F.when((F.size(values) == 1) & F.ltrim(F.try_element_at(values, F.lit(1))).startswith("["),
                    as_list(F.try_element_at(values, F.lit(1))))
    keys = F.map_keys(pairs)
    numbered = F.when(
        (F.size(keys) > 0) & (F.size(keys) == col(expected)) & F.forall(keys, lambda k: k.rlike(r"^\d+$")),
        F.transform(
            F.array_sort(F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].try_cast("int").alias("n"), e["value"].alias("v")))),
            lambda e: e["v"]))
    return F.coalesce(bare, *wrapped, single, numbered)
