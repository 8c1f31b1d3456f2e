"""Bindings of the predicates and similarity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.bindings import duck as D
from ledgerline.bindings.q_keys import URL_PATH, url_path
from ledgerline.bindings.registry import DERIVED, query
from ledgerline.functions import fixed, keys as K, predicates as P, similarity as S
from ledgerline.functions.text import ascii_words, epoch_s
from ledgerline.operators.common import numbered

DERIVED["disc_names"] = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'CD' || page_id WHEN 1 THEN 'Green disc' WHEN 2 THEN 'Pearl (Columbia CD 64188)'
  WHEN 3 THEN '[FLAC CD]' WHEN 4 THEN 'CD 2' ELSE url END AS name FROM pages
"""


@query("flt_disc_folder", """
SELECT page_id, name FROM disc_names WHERE len(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: regexp_full_match(w, '(cd|disc|disk)\\d+'))) > 0
 OR (len(regexp_extract_all(lower(name), '[a-z0-9]+')) <= 3 AND len(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: w IN ('cd', 'disc', 'disk'))) > 0)
""".replace("\\\\", "\\"))
def flt_disc_folder(t):
    return t.disc_names.filter(P.is_disc_folder("name"))


@query("flt_noise_category", """
SELECT file_id, path FROM files WHERE orderkey % 6 IN (0, 1)""")
def flt_noise_category(t):
    return t.files.select("file_id", "path").filter(P.is_noise_category("path"))


_UNOFFICIAL = (r"(?i)(^|[\s\-_.\(\[])(greatest\s+hits|best\s+of|the\s+very\s+best|antholog(y|ies)|compilations?|collections?|box\s*sets?|sampler|essential"
               r"|definitive|remix(es|ed)?|megamix|dj[\s\-_.]*mix|mixtape|karaoke|tribute|bootleg|rarities|b[\s\-_.]*sides|outtakes|unreleased"
               r"|live\s+(at|in|from|on)\b|in\s+concert|unplugged|live\s+albums?|live\s+recordings?)($|[\s\-_.\)\]0-9])")


@query("flt_unofficial_title", f"""
SELECT CAST(doc_id AS BIGINT) AS id, text AS title FROM documents WHERE regexp_matches(text, '{_UNOFFICIAL}')
UNION ALL SELECT id, title FROM titles WHERE regexp_matches(title, '{_UNOFFICIAL}')""")
def flt_unofficial_title(t):
    both = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("title")).unionAll(t.titles.select("id", "title"))
    return both.filter(P.is_unofficial_title("title"))


@query("flt_video_file", f"""
SELECT file_id, path FROM files WHERE NOT contains(lower(path), '/audio_ts/') AND (contains(lower(path), '/video_ts/') OR contains(lower(path), '/bdmv/')
 OR {D.ext('path')} IN {D.in_list(fixed.VIDEO_EXT_BUNDLES)})""")
def flt_video_file(t):
    return t.files.select("file_id", "path").filter(P.is_video_file("path"))


_EDITION = D.in_list(fixed.EDITION_WORDS).replace("remaster's", "remaster''s")


@query("flt_edition_words", f"""
SELECT id, title FROM titles WHERE len(list_filter({D.except_(D.words('title'), D.words('base'))}, lambda w: NOT (w IN {_EDITION} OR regexp_full_match(w, '(19|20)[0-9][0-9]')))) = 0""")
def flt_edition_words(t):
    return t.titles.filter(P.only_edition_words(ascii_words("title"), ascii_words("base"))).select("id", "title")


@query("flt_wanted", f"""
SELECT t.track_id, t.album_id, {D.compact_title('t.title')} AS title_key FROM tracks t JOIN albums a ON t.album_id = a.album_id
WHERE a.monitored AND (a.total = 0 OR a.have < a.total) AND NOT t.has_file AND t.track_monitored AND {D.compact_title('t.title')} <> ''""")
def flt_wanted(t):
    from ledgerline.operators.joins import flt_wanted as op

    return op(t.tracks, t.albums).select("track_id", "album_id", "title_key")


@query("flt_indexers", """
SELECT DISTINCT CAST(regexp_extract(url, '^[a-z]+://[^/]*/([0-9]+)', 1) AS BIGINT) AS source_id FROM (
  SELECT page_id, replace(url, '/' || split_part(url, '/', 4), '/' || page_id || '/' || split_part(url, '/', 4)) AS url FROM pages)
WHERE page_id % 2 = 0 AND page_id % 5 <> 0 AND page_id % 3 <> 0""")
def flt_indexers(t):
    rows = t.pages.select(
        F.when(F.col("page_id") % 2 == 0, "Torznab").otherwise("Newznab").alias("kind"),
        (F.col("page_id") % 5 != 0).alias("interactive"), F.lit(False).alias("automatic"),
        F.when(F.col("page_id") % 3 != 0, F.array(F.lit(5000), F.lit(3010))).otherwise(F.array(F.lit(5000), F.lit(4000))).alias("categories"),
        F.regexp_replace(F.col("url"), F.lit(r"^([a-z]+://[^/]*)/"), F.concat(F.lit("$1/"), F.col("page_id").cast("string"), F.lit("/"))).alias("url"))
    found = P.searchable_source("kind", "interactive", "automatic", "categories", "url")
    return rows.select(found.alias("source_id")).filter("source_id IS NOT NULL").distinct()


_TYPES = """SELECT id, CASE id % 4 WHEN 0 THEN 'Album' WHEN 1 THEN 'EP' WHEN 2 THEN '' ELSE 'Single' END AS kind,
 CASE id % 5 WHEN 0 THEN 'Live' WHEN 1 THEN 'Compilation' WHEN 2 THEN 'Demo' ELSE 'Other' END AS secondary FROM titles"""


@query("flt_release_types", f"""
WITH r AS ({_TYPES}) SELECT id, kind IN ('Album', '') AND secondary = 'Other' AS studio, kind IN ('Album', 'EP', '') AND secondary = 'Other' AS studio_ep, secondary IN ('Live', 'Compilation') AS collection FROM r""")
def flt_release_types(t):
    i = F.col("id")
    kind = F.when(i % 4 == 0, "Album").when(i % 4 == 1, "EP").when(i % 4 == 2, "").otherwise("Single")
    second = F.array(F.when(i % 5 == 0, "Live").when(i % 5 == 1, "Compilation").when(i % 5 == 2, "Demo").otherwise("Other"))
    return t.titles.select("id", P.release_type_admitted(kind, second).alias("studio"),
                           P.release_type_admitted(kind, second, include_eps=True).alias("studio_ep"),
                           P.release_is_collection(second).alias("collection"))


@query("flt_release_admission", """
SELECT file_id, CASE WHEN orderkey % 23 = 0 THEN 'video' WHEN orderkey % 19 = 0 THEN 'no audio' WHEN suppkey % 10 = 0 THEN 'placeholder artist'
  WHEN strpos(lower(path), '0' || line) > 1 AND suppkey % 10 = 1 THEN 'short artist inside title'
  WHEN size * 1000 > 2.5e9 * greatest(qty % 3, 1) THEN 'too large' WHEN qty < 5 THEN 'too few seeders' ELSE 'admit' END AS verdict FROM files""")
def flt_release_admission(t):
    artist = F.when(F.col("suppkey") % 10 == 0, "Various Artists").when(F.col("suppkey") % 10 == 1, F.concat(F.lit("0"), F.col("line").cast("string"))) \
        .otherwise("Some Artist")
    verdict = P.release_admission(
        has_video=F.col("orderkey") % 23 == 0, has_audio=F.col("orderkey") % 19 != 0, artist=artist, title="path",
        seeders="qty", size=F.col("size") * 1000, albums_filled=F.col("qty") % 3, min_seeders=5)
    return t.files.select("file_id", verdict.alias("verdict"))


@query("flt_stable", """
SELECT user_id, CAST(floor(max(epoch(ts))) AS BIGINT) AS newest, COUNT(*) AS n FROM events GROUP BY user_id HAVING 1706659200 - floor(max(epoch(ts))) >= 43200""")
def flt_stable(t):
    e = t.events.select("user_id", epoch_s("ts").alias("mtime"))
    return P.stable_groups(e, "user_id", "mtime", 1706659200, 43200)


@query("flt_excluded_prefix", """
SELECT file_id, path FROM files WHERE NOT starts_with(path, 'Supplier 3/') AND NOT starts_with(path, 'Supplier 4/Live/')
 AND NOT contains(path, '/CD2/')""")
def flt_excluded_prefix(t):
    f = P.exclude_under(t.files.select("file_id", "path"), "path", ["Supplier 3/", "/Supplier 4/Live", "./", ""])
    listed = t.files.select(K.path_parts("path").alias("p"), "path").filter(F.contains("path", F.lit("/CD2/"))).select(
        F.array_join(F.slice("p", 1, F.size("p") - 1), "/").alias("folder"))
    return P.exclude_under_table(f, "path", listed, "folder")


@query("flt_facets", """
SELECT lang, quality, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE lang IN ('en', 'fr', 'de') AND (quality IS NULL OR quality <> 0) AND n_chars > 100 AND contains(lower(text), 'the') GROUP BY lang, quality""")
def flt_facets(t):
    docs = t.documents.join(t.labels, "doc_id", "left")
    kept = P.facet_filter(docs, include={"lang": ["en", "fr", "de"]}, exclude={"quality": [0]}, text="The",
                          text_columns=["text"], chips=[F.col("n_chars") > 100])
    return kept.groupBy("lang", "quality").agg(F.count("*").alias("n"))


@query("flt_facet_counts", """
WITH d AS (SELECT lang, quality, n_chars > 1000 AS long FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'lang' AS facet, lang AS value, COUNT(*) AS n FROM d WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), COUNT(*) FROM d WHERE quality IS NOT NULL GROUP BY 2
UNION ALL SELECT 'long', 'on', COUNT(*) FROM d WHERE long HAVING COUNT(*) > 0""")
def flt_facet_counts(t):
    docs = t.documents.join(t.labels, "doc_id", "left")
    return P.facet_counts(docs, ["lang", "quality"], {"long": F.col("n_chars") > 1000})


# conversations searched through their turns, sorted by the number that a text begins with
@query("flt_facet_search", """
WITH c AS (SELECT conv_id, (conv_id % 50) || ' turns' AS label, bool_or(contains(lower(text), 'the')) AS hit FROM conversations GROUP BY 1, 2)
SELECT conv_id, row_number() OVER (ORDER BY conv_id % 50, conv_id) AS rank FROM c WHERE hit""")
def flt_facet_search(t):
    label = F.concat((F.col("conv_id") % 50).cast("string"), F.lit(" turns"))
    talks = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("turns")).withColumn("label", label)
    found = P.facet_filter(talks, text=" The", nested={"turns": "text"})
    return numbered(found.select("conv_id", "label"), P.facet_order("label", numeric=True).asc(), F.col("conv_id").asc()).drop("label")


def _answers(t):
    c, b = t.conversations, t.benchmark
    j = c.join(b.select("item_id", F.col("text").alias("btext")), c["conv_id"] % b.count() == b["item_id"])
    turn = F.col("turn") % 4
    return j.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.col("text"), F.lit(" "), F.when(F.col("conv_id") % 2 == 0, F.col("btext")).otherwise("")).alias("question"),
        F.when(turn == 0, F.lower("btext")).when(turn == 1, F.concat(F.lit("`"), F.col("btext"), F.lit(" (extra)`"))).when(turn == 2, "NONE").otherwise(F.col("text")).alias("answer"),
        F.array("btext", "role").alias("candidates"))


_A = "trim(regexp_replace(trim(answer), '^[`\"'' ]+|[`\"'' ]+$', '', 'g'))"
_LONG = lambda x: f"list_filter({D.words(x)}, lambda w: length(w) >= 4)"


@query("flt_answer_guard", f"""
WITH a AS (SELECT c.conv_id * 1000 + c.turn AS id, c.text || ' ' || CASE WHEN c.conv_id % 2 = 0 THEN b.text ELSE '' END AS question,
 CASE c.turn % 4 WHEN 0 THEN lower(b.text) WHEN 1 THEN '`' || b.text || ' (extra)`' WHEN 2 THEN 'NONE' ELSE c.text END AS answer, b.text AS c1, c.role AS c2
 FROM conversations c JOIN benchmark b ON c.conv_id % (SELECT COUNT(*) FROM benchmark) = b.item_id),
s AS (SELECT *, {_A} AS said FROM a),
p AS (SELECT *, CASE WHEN said = '' OR upper(said) = 'NONE' THEN NULL WHEN lower(trim(c1)) = lower(said) THEN c1 WHEN lower(trim(c2)) = lower(said) THEN c2
 WHEN {D.album_title('c1')} = {D.album_title('said')} THEN c1 WHEN {D.album_title('c2')} = {D.album_title('said')} THEN c2 END AS picked FROM s)
SELECT id, CASE WHEN len(list_intersect({_LONG('question')}, {_LONG('picked')})) > 0 OR ({D.album_title('question')} <> '' AND {D.album_title('picked')} <> ''
 AND (contains({D.album_title('question')}, {D.album_title('picked')}) OR contains({D.album_title('picked')}, {D.album_title('question')}))) THEN picked END AS picked,
 said <> '' AND len(list_filter({D.words('said')}, lambda w: NOT list_contains({D.words('question')}, w))) = 0 AS grounded FROM p""")
def flt_answer_guard(t):
    a = _answers(t)
    out = P.accepted_answer(a, query="question", answer="answer", candidates="candidates", ordinal="id")
    said = F.trim(F.regexp_replace(F.trim("answer"), "^[`\"' ]+|[`\"' ]+$", ""))
    return out.select("id", "picked", P.grounded_answer("question", said, said).alias("grounded"))


@query("flt_answer_shape", """
WITH c AS (SELECT conv_id, turn, role, text, replace(replace(text, '\\', ' '), '"', ' ') AS safe, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 5 IN (0, 1, 2) AND turn % 3 <> 2 THEN upper(role) ELSE role END AS fixed_role FROM c
""".replace("\\\\", "\\"))
def flt_answer_shape(t):
    """Per conversation, a reply in one of several shapes renames the roles."""
    c = t.conversations.select("conv_id", "turn", "role")
    # the reply holds an object per turn; every third one is not usable
    item = F.when(F.col("turn") % 3 != 2, F.concat(F.lit('{"role":"'), F.upper("role"), F.lit('"}'))).otherwise(F.lit("7"))
    turns = c.select("conv_id", "turn", item.alias("item")).groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda s: s["item"]).alias("items"), F.count("*").cast("int").alias("n"))
    listed = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    keyed = F.concat(F.lit("{"), F.array_join(F.transform("items", lambda s, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'), s)), ","), F.lit("}"))
    raw = F.when(F.col("conv_id") % 5 == 0, listed).when(F.col("conv_id") % 5 == 1, F.concat(F.lit('{"tracks":'), listed, F.lit("}"))) \
        .when(F.col("conv_id") % 5 == 2, keyed).otherwise("sorry, no list")
    replies = turns.select("conv_id", F.posexplode_outer(P.shaped_answer(raw, "n")).alias("pos", "obj"))
    # rows align by position; a missing or non-object item keeps the original
    from pyspark.sql import Window

    ranked = c.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    said = F.when(F.ltrim(F.col("obj")).startswith("{"), F.get_json_object("obj", "$.role"))
    return ranked.join(replies, ["conv_id", "pos"], "left").select("conv_id", "turn", F.coalesce(said, F.col("role")).alias("fixed_role"))


# --- scores ---------------------------------------------------------------------------------
DERIVED["title_pairs"] = """
SELECT p.p_partkey AS id, p.p_name AS a, CASE p.p_partkey % 5 WHEN 0 THEN p.p_name WHEN 1 THEN p.p_name || ' and more' WHEN 2 THEN substr(p.p_name, 3, 4) WHEN 3 THEN '' ELSE p.p_type END AS b FROM part p
"""


# the ratio: the longest common piece, the first in a and then in b, splits both texts; what is left of it and right of it goes on
@query("sim_title", """
WITH RECURSIVE piece AS (SELECT id, a AS x, b AS y, 0 AS k, 0 AS deep FROM title_pairs WHERE a <> '' AND b <> '' AND NOT contains(a, b) AND NOT contains(b, a)
 UNION ALL SELECT id, CASE side WHEN 0 THEN substr(x, 1, m.i - 1) ELSE substr(x, m.i + m.k) END, CASE side WHEN 0 THEN substr(y, 1, m.j - 1) ELSE substr(y, m.j + m.k) END, CASE side WHEN 0 THEN m.k ELSE 0 END, deep + 1
  FROM (SELECT id, x, y, deep, (SELECT max({'k': n, 'i': -i, 'j': -j}) FROM range(1, length(x) + 1) AS r(i), range(1, length(y) + 1) AS s(j), range(1, least(length(x) - i, length(y) - j) + 2) AS t(n) WHERE substr(x, i, n) = substr(y, j, n)) AS f
        FROM piece WHERE x <> '' AND y <> '') AS p, LATERAL (SELECT f.k AS k, -f.i AS i, -f.j AS j) AS m, (VALUES (0), (1)) AS v(side) WHERE f IS NOT NULL),
matched AS (SELECT id, sum(k) AS k FROM piece GROUP BY id)
SELECT p.id, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 * least(length(a), length(b)) / greatest(length(a), length(b)) + 0.05
 ELSE 2.0 * m.k / (length(a) + length(b)) END, 6) AS score FROM title_pairs p LEFT JOIN matched m ON m.id = p.id""")
def sim_title(t):
    return t.title_pairs.select("id", F.round(S.sim_title("a", "b"), 6).alias("score"))


DERIVED["doc_pairs"] = """
SELECT d.doc_id AS id, d.source AS source, d.text AS found, b.text AS wanted FROM (SELECT doc_id, source, text, doc_id % (SELECT COUNT(*) FROM benchmark) AS k FROM documents) d JOIN benchmark b ON d.k = b.item_id
"""


@query("sim_identity_f1", f"""
WITH x AS (SELECT id, list_distinct({D.identity_tokens('found', 'source')}) AS got, list_distinct({D.identity_tokens('wanted', 'source')}) AS want FROM doc_pairs),
y AS (SELECT id, len(got) AS g, len(want) AS w, len(list_intersect(got, want)) AS o FROM x)
SELECT id, round(CASE WHEN o = 0 THEN 0.0 ELSE 2.0 * (o / w) * (o / g) / ((o / w) + (o / g)) END, 6) AS score FROM y""")
def sim_identity_f1(t):
    return t.doc_pairs.select("id", F.round(S.sim_identity_f1("found", "wanted", "source"), 6).alias("score"))


@query("sim_credit_agree", f"""
SELECT id, len(list_intersect({D.credit_sets('credit')}, {D.credit_sets('artist')})) > 0 AS agree FROM credits""")
def sim_credit_agree(t):
    return t.credits.select("id", S.sim_credit_agree("credit", "artist").alias("agree"))


@query("sim_substring_artist", f"""
WITH k AS (SELECT id, {D.compact_artist('credit')} AS a, {D.compact_artist('artist')} AS b FROM credits)
SELECT id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS agree FROM k""")
def sim_substring_artist(t):
    return t.credits.select("id", S.sim_substring_artist(K.key_compact_artist("credit"), K.key_compact_artist("artist")).alias("agree"))


@query("sim_quality_rank", """
SELECT p_partkey, round(CASE WHEN p_type <> 'SMALL' THEN 2 ELSE 0 END + CASE WHEN p_size % 7 > 2 THEN 2 ELSE 0 END + (p_size % 7) / 10 + p_size / 100 + p_retailprice / 1e7, 6) AS score FROM part""")
def sim_quality_rank(t):
    return t.part.select("p_partkey", F.round(S.sim_quality_rank(F.col("p_type") != "SMALL", F.col("p_size") % 7, "p_size", "p_retailprice"), 6).alias("score"))


@query("sim_edit_native", """
SELECT id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS score FROM title_pairs""")
def sim_edit_native(t):
    return t.title_pairs.select("id", F.round(S.sim_edit_native("a", "b"), 6).alias("score"))
