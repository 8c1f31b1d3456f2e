"""Bindings of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.bindings import duck as D
from ledgerline.bindings.registry import DERIVED, query
from ledgerline.functions import fixed, keys as K
from ledgerline.functions.text import ascii_words
from ledgerline.operators import joins as J
from ledgerline.operators.common import with_keys

# songs and wants with the keys the SQL side joins on
DERIVED["song_keys"] = f"""
SELECT ordinal, title, artist, duration_ms, {D.compact_title('title')} AS k, {D.text_list(D.variants('title'))} AS v, {D.credit_sets('artist')} AS acts FROM songs
"""
DERIVED["want_keys"] = f"""
SELECT ordinal, title, artist, album, duration_ms, {D.compact_title('title')} AS k, {D.text_list(D.variants('title'))} AS v, {D.credit_sets('artist')} AS acts FROM wants
"""

_KEYED = ["title_key"]


def _keyed(df):
    return with_keys(df, "title", title_key=K.key_compact_title)


@query("join_wanted_title", """
SELECT s.ordinal, s.k AS title_key, n_wanted, first_wanted FROM song_keys s
JOIN (SELECT k, COUNT(*) AS n_wanted, MIN(ordinal) AS first_wanted FROM want_keys WHERE k <> '' GROUP BY k) w ON s.k = w.k""")
def join_wanted_title(t):
    out = J.join_wanted_title(_keyed(t.songs), _keyed(t.wants))
    return out.select("ordinal", "title_key", "n_wanted", "first_wanted")


_TOL = """
WITH p AS (SELECT s.ordinal, w.ordinal AS want_ordinal, abs(s.duration_ms - w.duration_ms) AS delta_ms,
  row_number() OVER (PARTITION BY s.ordinal ORDER BY abs(s.duration_ms - w.duration_ms), w.ordinal) AS rn
  FROM song_keys s JOIN want_keys w ON s.k = w.k WHERE s.duration_ms > 0 AND w.duration_ms > 0 AND abs(s.duration_ms - w.duration_ms) <= 10000)
SELECT ordinal, want_ordinal, delta_ms FROM p WHERE rn = 1"""


@query("join_duration_tolerance", _TOL)
def join_duration_tolerance(t):
    out = J.join_duration_tolerance(_keyed(t.songs), _keyed(t.wants), keys=_KEYED)
    return out.select("ordinal", "want_ordinal", "delta_ms")


@query("join_duration_unknown", """
WITH p AS (SELECT s.ordinal, w.ordinal AS want_ordinal, CASE WHEN s.duration_ms = 0 OR w.duration_ms = 0 THEN 0 ELSE abs(s.duration_ms - w.duration_ms) END AS delta_ms
  FROM song_keys s JOIN want_keys w ON s.k = w.k WHERE s.duration_ms = 0 OR w.duration_ms = 0 OR abs(s.duration_ms - w.duration_ms) <= 15000),
r AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY delta_ms, want_ordinal) AS rn FROM p)
SELECT ordinal, want_ordinal, delta_ms FROM r WHERE rn = 1""")
def join_duration_unknown(t):
    out = J.join_duration_tolerance(_keyed(t.songs), _keyed(t.wants), keys=_KEYED,
                                    tolerance=fixed.AUTHORITY_TOLERANCE_MS, allow_unknown=True)
    return out.select("ordinal", "want_ordinal", "delta_ms")


DERIVED["gated"] = """
SELECT s.ordinal, s.title, s.artist, s.k, s.acts, s.duration_ms, w.ordinal AS want_ordinal, w.album AS album, w.artist AS want_artist, w.duration_ms AS want_ms,
  CASE WHEN s.artist <> '' AND len(list_intersect(s.acts, w.acts)) = 0 THEN 'artist ' || s.artist || ' != ' || w.artist
   WHEN s.v <> w.v THEN 'variant mismatch (' || CASE WHEN s.v = '' THEN '-' ELSE s.v END || ' vs ' || CASE WHEN w.v = '' THEN '-' ELSE w.v END || ')'
   WHEN s.duration_ms = 0 OR w.duration_ms = 0 THEN 'duration unknown'
   WHEN abs(s.duration_ms - w.duration_ms) > 10000 THEN 'duration off by ' || CAST(round(abs(s.duration_ms - w.duration_ms) / 1000, 1) AS STRING) || 's' END AS why
FROM song_keys s JOIN want_keys w ON s.k = w.k AND s.k <> ''
"""
DERIVED["judged"] = """
SELECT s.ordinal, m.want_ordinal, m.delta_ms, CASE WHEN m.ordinal IS NOT NULL THEN NULL WHEN s.title = '' THEN 'no title tag'
  WHEN r.reason IS NULL THEN 'title not wanted by any album' ELSE r.reason END AS reason, m.album
FROM songs s LEFT JOIN (SELECT * FROM (SELECT ordinal, want_ordinal, album, abs(duration_ms - want_ms) AS delta_ms,
   row_number() OVER (PARTITION BY ordinal ORDER BY abs(duration_ms - want_ms), want_ordinal) AS rn FROM gated WHERE why IS NULL) WHERE rn = 1) m ON s.ordinal = m.ordinal
LEFT JOIN (SELECT ordinal, string_agg(why, '; ' ORDER BY want_ordinal) AS reason FROM (SELECT ordinal, why, want_ordinal,
   row_number() OVER (PARTITION BY ordinal ORDER BY want_ordinal) AS rn FROM gated) WHERE rn <= 3 GROUP BY ordinal) r ON s.ordinal = r.ordinal
"""


@query("join_four_gates", "SELECT ordinal, want_ordinal, delta_ms, reason FROM judged")
def join_four_gates(t):
    return J.join_four_gates(t.songs, t.wants).drop("confidence")


# every line of the documents against all titles of the benchmark
DERIVED["line_titles"] = f"""
SELECT DISTINCT k AS cand FROM (SELECT {D.song_title('line')} AS k FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE k <> ''
"""


def _line_titles(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select(K.key_song_title("line").alias("title_key"))


@query("join_token_block", f"""
WITH w AS (SELECT DISTINCT {D.song_title('text')} AS want FROM benchmark), ww AS (SELECT want, list_distinct(list_filter(string_split(want, ' '), lambda x: length(x) >= 3)) AS l FROM w WHERE want <> ''),
s AS (SELECT cand, list_distinct(list_filter(string_split(cand, ' '), lambda x: length(x) >= 3)) AS l FROM line_titles),
x AS (SELECT want, cand, COUNT(*) AS n FROM (SELECT want, unnest(l) AS tok FROM ww WHERE want NOT IN (SELECT cand FROM s)) a JOIN (SELECT cand, unnest(l) AS tok FROM s) b ON a.tok = b.tok GROUP BY 1, 2)
SELECT want, want AS cand, 'exact' AS kind, CAST(len(l) AS INTEGER) AS n_shared FROM ww WHERE want IN (SELECT cand FROM s)
UNION ALL SELECT x.want, cand, 'token', CAST(n AS INTEGER) FROM x JOIN ww ON x.want = ww.want WHERE 100 * n >= 50 * len(l)""")
def join_token_block(t):
    wants = t.benchmark.select(K.key_song_title("text").alias("title_key"))
    return J.join_token_block(wants, _line_titles(t))


# the same titles, every pair that can reach the least score of a plan; no SQL twin
@query("join_title_close_lines")
def join_title_close_lines(t):
    wants = t.benchmark.select(K.key_song_title("text").alias("title_key"))
    return J.join_title_close(wants, _line_titles(t), floor=fixed.PLAN_MIN_SCORE)


_EDITION = D.in_list(fixed.EDITION_WORDS).replace("remaster's", "remaster''s")


@query("join_word_subset", f"""
WITH o AS (SELECT artist, min(ordinal) AS ordinal, {D.sorted_words('title')} AS w FROM titled_albums GROUP BY artist, {D.sorted_words('title')}),
d AS (SELECT DISTINCT brand AS artist, title AS dl_title, {D.words('title')} AS w FROM titles),
p AS (SELECT d.artist, d.dl_title, o.ordinal, len(o.w) AS n_words, row_number() OVER (PARTITION BY d.artist, d.dl_title ORDER BY len(o.w) DESC, o.ordinal) AS rn
 FROM d JOIN o ON d.artist = o.artist AND len(list_filter(o.w, lambda x: NOT list_contains(d.w, x))) = 0
 WHERE len(list_filter(list_filter(d.w, lambda x: NOT list_contains(o.w, x)), lambda x: NOT (x IN {_EDITION} OR regexp_full_match(x, '(19|20)[0-9][0-9]')))) = 0)
SELECT artist, dl_title, ordinal AS owned_ordinal, CAST(n_words AS INTEGER) AS n_words FROM p WHERE rn = 1""")
def join_word_subset(t):
    owned = t.titled_albums
    downloads = t.titles.select(F.col("brand").alias("artist"), "title")
    return J.join_word_subset(owned, downloads).drop("owned_title")


# two catalogues: customers under odd spellings, resolved against the customer names
def _artists(t):
    return t.customer.select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("artist_name"))


DERIVED["asked"] = f"""
SELECT DISTINCT credit AS name, lower(trim(credit)) AS plain, {D.script_key('credit')} AS key,
 {D.script_key("trim(regexp_replace(credit, '(?i)^\\s*(?:dj|mc|vj|dr)[\\s.\\-_]+', ''))")} AS bare FROM credits
"""
DERIVED["held"] = f"SELECT c_custkey AS id, lower(c_name) AS plain, {D.script_key('c_name')} AS key FROM customer"


# what an authority knows of every third of them
DERIVED["authority_names"] = """
SELECT c_custkey AS ordinal, 'mb' || c_custkey AS mbid, c_name AS name, c_name || ', The' AS sort_name, c_name || ' & The Sweet Inspirations' AS alias1, 'Motörhead ' || c_name AS alias2
FROM customer WHERE c_custkey % 3 = 0
"""


# the ratio as in sim_title; two keys of that ratio are at most so many edits apart
@query("join_resolve_artist", f"""
WITH RECURSIVE e AS (SELECT plain, MIN(id) AS id FROM held GROUP BY plain), k AS (SELECT key, MIN(id) AS id, COUNT(*) AS n FROM held WHERE key <> '' GROUP BY key),
s AS (SELECT a.name, e.id AS e, k.id AS k, b.id AS b, a.plain, a.key FROM asked a LEFT JOIN e ON a.plain = e.plain LEFT JOIN k ON a.key = k.key LEFT JOIN k b ON a.bare = b.key),
c AS (SELECT s.name, MIN(h.id) AS id FROM s JOIN held h ON contains(h.plain, s.plain) WHERE e IS NULL AND k IS NULL AND b IS NULL GROUP BY s.name),
q AS (SELECT DISTINCT s.key FROM s LEFT JOIN c ON s.name = c.name WHERE e IS NULL AND k IS NULL AND b IS NULL AND c.id IS NULL AND length(s.key) >= 6),
near AS (SELECT q.key AS ka, k.key AS kb FROM q JOIN k ON levenshtein(q.key, k.key) <= 0.15 * (length(q.key) + length(k.key)) + 0.000001),
piece AS (SELECT ka, kb, ka AS x, kb AS y, 0 AS k FROM near
 UNION ALL SELECT ka, kb, CASE side WHEN 0 THEN substr(x, 1, i - 1) ELSE substr(x, i + n) END, CASE side WHEN 0 THEN substr(y, 1, strpos(y, substr(x, i, n)) - 1) ELSE substr(y, strpos(y, substr(x, i, n)) + n) END, CASE side WHEN 0 THEN n ELSE 0 END
  FROM (SELECT ka, kb, x, y, f.n AS n, -f.i AS i FROM (SELECT *, list_max(list_transform(range(1, length(x) + 1), lambda i: {{'n': CAST(len(list_filter(range(1, length(x) - i + 2), lambda n: contains(y, substr(x, i, n)))) AS INTEGER), 'i': CAST(-i AS INTEGER)}})) AS f
        FROM piece WHERE x <> '' AND y <> '')) AS p, (VALUES (0), (1)) AS v(side) WHERE n > 0),
ratio AS (SELECT ka, kb, CAST(2 * sum(k) AS DOUBLE) / (length(ka) + length(kb)) AS score FROM piece GROUP BY ka, kb),
r AS (SELECT ka, k.id, k.n, score, row_number() OVER (PARTITION BY ka ORDER BY score DESC, kb) AS rn, lead(score) OVER (PARTITION BY ka ORDER BY score DESC, kb) AS nxt FROM ratio JOIN k ON kb = k.key),
z AS (SELECT ka, id FROM r WHERE rn = 1 AND score >= 0.9 AND score - CASE WHEN n > 1 THEN score ELSE COALESCE(nxt, 0.0) END >= 0.05),
l AS (SELECT {D.alias_name('nm')} AS k, arg_min(CAST(substr(mbid, 3) AS BIGINT), ordinal) AS id FROM (SELECT ordinal, mbid, unnest([name, sort_name, alias1, alias2]) AS nm FROM authority_names) GROUP BY 1)
SELECT s.name, COALESCE(e, s.k, b, c.id, z.id, l.id) AS artist_id, CASE WHEN e IS NOT NULL THEN 'exact' WHEN s.k IS NOT NULL THEN 'script key' WHEN b IS NOT NULL THEN 'stage prefix'
 WHEN c.id IS NOT NULL THEN 'substring' WHEN z.id IS NOT NULL THEN 'fuzzy' WHEN l.id IS NOT NULL THEN 'alias' ELSE 'none' END AS stage
 FROM s LEFT JOIN c ON s.name = c.name LEFT JOIN z ON s.key = z.ka LEFT JOIN l ON {D.alias_name('s.name')} = l.k AND l.k <> ''""")
def join_resolve_artist(t):
    artists = _artists(t).withColumn("mbid", F.concat(F.lit("mb"), F.col("artist_id").cast("string")))
    aliases = t.authority_names.withColumn("aliases", F.array("alias1", "alias2"))
    return J.join_resolve_artist(t.credits.select(F.col("credit").alias("name")), artists, aliases)


@query("join_resolve_artist_fuzzy")
def join_resolve_artist_fuzzy(t):
    """All stages: titles stand for odd spellings, their base names for artists."""
    artists = t.titles.groupBy("base").agg(F.min("id").alias("ordinal")).select(
        "ordinal", F.col("ordinal").alias("artist_id"), F.col("base").alias("artist_name"), F.col("base").alias("mbid"))
    aliases = artists.select("ordinal", "mbid", F.col("artist_name").alias("name"), F.col("artist_name").alias("sort_name"),
                             F.array(F.concat(F.lit("夜 "), F.col("artist_name"))).alias("aliases"))
    return J.join_resolve_artist(t.titles.select(F.col("title").alias("name")), artists, aliases)


@query("join_fuzzy_margin")
def join_fuzzy_margin(t):
    artists = t.titles.groupBy("base").agg(F.min("id").alias("ordinal")).select(
        "ordinal", F.col("ordinal").alias("artist_id"), K.key_script_artist("base").alias("key"))
    names = t.titles.select(K.key_script_artist("title").alias("key")).distinct()
    return J.join_fuzzy_margin(names, artists).withColumn("score", F.round("score", 6))


@query("join_edit_margin", f"""
WITH n AS (SELECT DISTINCT {D.script_key('title')} AS ka FROM titles), a AS (SELECT {D.script_key('base')} AS kb, COUNT(*) AS n, MIN(id) AS artist_id FROM (SELECT base, MIN(id) AS id FROM titles GROUP BY base) GROUP BY kb),
p AS (SELECT ka, kb, n, artist_id, 1.0 - levenshtein(ka, kb) / greatest(length(ka), length(kb)) AS score FROM n JOIN a ON length(ka) >= 6),
r AS (SELECT *, row_number() OVER (PARTITION BY ka ORDER BY score DESC, kb) AS rn, lead(score) OVER (PARTITION BY ka ORDER BY score DESC, kb) AS nxt FROM p)
SELECT ka AS key, artist_id, round(score, 6) AS score FROM r WHERE rn = 1 AND score >= 0.8 AND score - CASE WHEN n > 1 THEN score ELSE COALESCE(nxt, 0.0) END >= 0.05""")
def join_edit_margin(t):
    artists = t.titles.groupBy("base").agg(F.min("id").alias("ordinal")).select(
        "ordinal", F.col("ordinal").alias("artist_id"), K.key_script_artist("base").alias("key"))
    names = t.titles.select(K.key_script_artist("title").alias("key"))
    return J.join_edit_margin(names, artists).withColumn("score", F.round("score", 6))


@query("join_alias", f"""
WITH al AS (SELECT n.n_nationkey AS o, 'mb' || n.n_nationkey AS mbid, unnest([n.n_name, r.r_name || ' ' || n.n_nationkey, 'Nation No ' || n.n_nationkey]) AS nm FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
k AS (SELECT {D.alias_name('nm')} AS k, arg_min(mbid, o) AS mbid FROM al GROUP BY 1),
q AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'nation_' || c_nationkey WHEN 1 THEN 'NATION NO. ' || c_nationkey WHEN 2 THEN 'nobody ' || c_custkey ELSE 'Éurope ' || c_nationkey END AS name FROM customer),
s AS (SELECT 'mb' || s_nationkey AS mbid, MIN(s_suppkey) AS artist_id FROM supplier GROUP BY 1)
SELECT q.id, q.name, k.mbid, s.artist_id FROM q LEFT JOIN k ON {D.alias_name('q.name')} = k.k LEFT JOIN s ON k.mbid = s.mbid""")
def join_alias(t):
    c = F.col("c_custkey")
    nation = F.col("c_nationkey").cast("string")
    names = t.customer.select(c.alias("id"), F.when(c % 4 == 0, F.concat(F.lit("nation_"), nation)).when(c % 4 == 1, F.concat(F.lit("NATION NO. "), nation))
                              .when(c % 4 == 2, F.concat(F.lit("nobody "), c.cast("string"))).otherwise(F.concat(F.lit("Éurope "), nation)).alias("name"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    num = F.col("n_nationkey").cast("string")
    aliases = n.select(F.col("n_nationkey").alias("ordinal"), F.concat(F.lit("mb"), num).alias("mbid"), F.col("n_name").alias("name"),
                       F.concat("r_name", F.lit(" "), num).alias("sort_name"), F.array(F.concat(F.lit("Nation No "), num)).alias("aliases"))
    artists = t.supplier.select(F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").alias("artist_id"), F.concat(F.lit("mb"), F.col("s_nationkey").cast("string")).alias("mbid"))
    return J.join_alias(names, aliases, artists).select("id", "name", "mbid", "artist_id")


DERIVED["asks"] = """
SELECT id AS ask_id, brand AS artist_id, CASE id % 4 WHEN 0 THEN base WHEN 1 THEN upper(base) || ' (2CD)' WHEN 2 THEN substr(base, 1, 4) ELSE base END AS title,
 CAST(n_tracks + id % 3 - 1 AS BIGINT) AS track_count, CAST(1960 + id % 60 AS INTEGER) AS year FROM titles
"""


@query("join_album_disambiguate", """
WITH a AS (SELECT ask_id, artist_id, lower(trim(title)) AS t, track_count, year FROM asks), b AS (SELECT artist AS artist_id, lower(trim(title)) AS u, ordinal, album_id, have, total, substr(release_date, 1, 4) AS y FROM titled_albums),
e AS (SELECT a.*, b.*, 'title' AS how FROM a JOIN b ON a.artist_id = b.artist_id AND t = u),
n AS (SELECT a.*, b.*, 'substring' AS how FROM a JOIN b ON a.artist_id = b.artist_id AND (contains(u, t) OR contains(t, u)) WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.artist_id = a.artist_id AND x.u = a.t)),
c AS (SELECT ask_id, track_count, year, ordinal, album_id, have, total, y, how FROM e UNION ALL SELECT ask_id, track_count, year, ordinal, album_id, have, total, y, how FROM n),
r AS (SELECT ask_id, album_id, how, COUNT(*) OVER (PARTITION BY ask_id) AS n_candidates, row_number() OVER (PARTITION BY ask_id ORDER BY
  CASE WHEN track_count > 0 AND total = track_count THEN 2 WHEN track_count > 0 AND abs(total - track_count) <= 1 THEN 1 ELSE 0 END DESC,
  CASE WHEN year > 0 AND y = CAST(year AS STRING) THEN 1 ELSE 0 END DESC, CASE WHEN total = 0 OR have < total THEN 1 ELSE 0 END DESC,
  abs(total - CASE WHEN track_count = 0 THEN total ELSE track_count END), ordinal) AS rn FROM c)
SELECT ask_id, album_id, how, n_candidates FROM r WHERE rn = 1""")
def join_album_disambiguate(t):
    return J.join_album_disambiguate(t.asks, t.titled_albums.withColumnRenamed("artist", "artist_id"))


DERIVED["folders"] = """
SELECT id AS folder_id, brand AS artist, title, CASE WHEN id % 7 = 0 THEN (1960 + id % 60) || ' - ' || title ELSE '' END AS hint, n_tracks AS n_files FROM titles
"""
DERIVED["owned_verdict"] = f"""
SELECT q.folder_id, q.how, q.album_id, CASE WHEN q.how = 'ambiguous' THEN false ELSE COALESCE((q.have > 0 AND q.have >= q.total) OR (q.tracks_have > 0 AND q.tracks_have >= q.tracks_total), false) END AS complete,
  CASE WHEN q.how = 'ambiguous' THEN q.gap_have WHEN q.have > 0 AND q.have >= q.total THEN q.have WHEN q.tracks_have > 0 AND q.tracks_have >= q.tracks_total THEN q.tracks_have ELSE greatest(COALESCE(q.have, 0), COALESCE(q.tracks_have, 0)) END AS have,
  CASE WHEN q.how = 'ambiguous' THEN q.gap_total WHEN q.have > 0 AND q.have >= q.total THEN q.total WHEN q.tracks_have > 0 AND q.tracks_have >= q.tracks_total THEN q.tracks_total ELSE greatest(COALESCE(q.total, 0), COALESCE(q.tracks_total, 0)) END AS total
FROM (
 SELECT f.folder_id, f.how, f.gap_have, f.gap_total, a.album_id, a.have, a.total, a.tracks_have, a.tracks_total FROM (
  SELECT fo.folder_id, CASE WHEN s.n IS NULL THEN CASE WHEN w.ordinal IS NULL THEN 'none' ELSE 'words' END WHEN s.n > 1 AND COALESCE(y.n, 0) <> 1 AND s.n_gap > 0 THEN 'ambiguous' ELSE 'title' END AS how,
   CASE WHEN s.n IS NULL THEN w.ordinal WHEN s.n > 1 AND COALESCE(y.n, 0) = 1 THEN y.ordinal WHEN s.n > 1 AND s.n_gap > 0 THEN NULL ELSE s.ordinal END AS ordinal, s.gap_have, s.gap_total
  FROM (SELECT folder_id, artist, title, {D.album_title('title')} AS k, regexp_extract(CASE WHEN hint = '' THEN title ELSE hint END, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1) AS y FROM folders) fo
  LEFT JOIN (SELECT artist, {D.album_title('title')} AS k, COUNT(*) AS n, MIN(ordinal) AS ordinal, COUNT(*) FILTER (WHERE NOT (have > 0 AND have >= total)) AS n_gap,
     arg_min(have, ordinal) FILTER (WHERE NOT (have > 0 AND have >= total)) AS gap_have, arg_min(total, ordinal) FILTER (WHERE NOT (have > 0 AND have >= total)) AS gap_total FROM titled_albums GROUP BY 1, 2) s ON fo.artist = s.artist AND fo.k = s.k AND fo.k <> ''
  LEFT JOIN (SELECT artist, {D.album_title('title')} AS k, substr(release_date, 1, 4) AS y, COUNT(*) AS n, MIN(ordinal) AS ordinal FROM titled_albums GROUP BY 1, 2, 3) y ON fo.artist = y.artist AND fo.k = y.k AND fo.y = y.y
  LEFT JOIN (SELECT d.folder_id, arg_min(o.ordinal, -len(o.w) * 1000000 + o.ordinal) AS ordinal FROM (SELECT folder_id, artist, {D.words('title')} AS w FROM folders) d
    JOIN (SELECT artist, MIN(ordinal) AS ordinal, {D.sorted_words('title')} AS w FROM titled_albums WHERE have > 0 AND have >= total GROUP BY artist, {D.sorted_words('title')}) o
    ON d.artist = o.artist AND len(list_filter(o.w, lambda x: NOT list_contains(d.w, x))) = 0
    AND len(list_filter(list_filter(d.w, lambda x: NOT list_contains(o.w, x)), lambda x: NOT (x IN {_EDITION} OR regexp_full_match(x, '(19|20)[0-9][0-9]')))) = 0 GROUP BY 1) w ON fo.folder_id = w.folder_id
 ) f LEFT JOIN titled_albums a ON f.ordinal = a.ordinal) q
"""


@query("join_album_owned", "SELECT folder_id, album_id, how, complete, have, total FROM owned_verdict")
def join_album_owned(t):
    return J.join_album_owned(t.folders, t.titled_albums)


@query("join_unique_owner", f"""
WITH o AS (SELECT {D.album_title('title')} AS k, MIN(artist) AS lo, MAX(artist) AS hi FROM (SELECT title, artist FROM titled_albums UNION ALL SELECT title, brand FROM titles) GROUP BY 1)
SELECT l_orderkey, COUNT(*) AS n, MIN(lo) AS owner FROM (SELECT l_orderkey, t.title FROM lineitem JOIN titles t ON l_partkey = t.id) x JOIN o ON {D.album_title('x.title')} = o.k AND o.k <> '' AND lo = hi GROUP BY l_orderkey""")
def join_unique_owner(t):
    albums = t.titled_albums.select("title", "artist").unionAll(t.titles.select("title", F.col("brand").alias("artist")))
    rows = t.lineitem.join(t.titles, F.col("l_partkey") == F.col("id")).select("l_orderkey", "title")
    return J.join_unique_owner(rows, albums).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))


@query("join_positional", """
WITH f AS (SELECT orderkey AS album_id, path, file_id, row_number() OVER (PARTITION BY orderkey ORDER BY lower(path), path, file_id) AS pos, COUNT(*) OVER (PARTITION BY orderkey) AS n FROM files WHERE flag <> 'R' OR orderkey % 2 = 0),
t AS (SELECT album_id, track_id, row_number() OVER (PARTITION BY album_id ORDER BY track_no, track_id) AS pos, COUNT(*) OVER (PARTITION BY album_id) AS n FROM tracks)
SELECT f.album_id, f.pos, f.path, t.track_id FROM f JOIN t ON f.album_id = t.album_id AND f.pos = t.pos AND f.n = t.n""")
def join_positional(t):
    files = t.files.filter("flag <> 'R' OR orderkey % 2 = 0").select(F.col("orderkey").alias("album_id"), "path")
    tracks = t.tracks.select("album_id", "track_id", "track_no", F.lit(0).alias("absolute_no"), F.lit(None).cast("int").alias("medium_no"))
    return J.join_positional(files, tracks).select("album_id", F.col("pos").cast("bigint").alias("pos"), "path", "track_id")


DERIVED["numbered"] = """
SELECT album_id, track_id, CASE WHEN track_no > 4 THEN 2 ELSE 1 END AS medium_no, track_no, song_id % 5 AS pos, CAST(song_id AS STRING) AS title_key FROM tracks
"""


@query("join_track_three_index", """
WITH a AS (SELECT album_id, medium_no, track_no, MIN(track_id) AS t FROM numbered WHERE track_no % 2 = 0 GROUP BY 1, 2, 3), b AS (SELECT album_id, pos, MIN(track_id) AS t FROM numbered WHERE track_no % 2 = 0 GROUP BY 1, 2),
c AS (SELECT album_id, title_key, MIN(track_id) AS t FROM numbered WHERE track_no % 2 = 0 GROUP BY 1, 2)
SELECT f.track_id AS file_id, COALESCE(a.t, b.t, c.t) AS track_id, CASE WHEN a.t IS NOT NULL THEN 'number' WHEN b.t IS NOT NULL THEN 'position' WHEN c.t IS NOT NULL THEN 'title' ELSE 'none' END AS how
FROM numbered f LEFT JOIN a ON f.album_id = a.album_id AND f.medium_no = a.medium_no AND f.track_no = a.track_no LEFT JOIN b ON f.album_id = b.album_id AND f.pos = b.pos LEFT JOIN c ON f.album_id = c.album_id AND f.title_key = c.title_key""")
def join_track_three_index(t):
    n = t.numbered
    return J.join_track_three_index(n.withColumnRenamed("track_id", "file_id"), n.filter("track_no % 2 = 0")).select("file_id", "track_id", "how")


# baskets: a supplier's songs, some of them played live, against the songs of an order
DERIVED["baskets"] = """
SELECT l_suppkey AS folder_id, l_orderkey AS album_id, l_partkey AS song, t.title AS title, CASE WHEN l_orderkey % 6 = 1 THEN t.title || ' (live)' ELSE t.title END AS tagged
FROM lineitem JOIN titles t ON l_partkey = t.id
"""


@query("join_album_by_songs", f"""
WITH f AS (SELECT DISTINCT folder_id, song, {D.text_list(D.variants('tagged'))} AS v FROM baskets), a AS (SELECT DISTINCT album_id, song, {D.text_list(D.variants('title'))} AS v FROM baskets),
nf AS (SELECT folder_id, COUNT(*) AS nf FROM f GROUP BY 1), na AS (SELECT album_id, COUNT(*) AS na FROM a GROUP BY 1),
s AS (SELECT folder_id, album_id, COUNT(*) AS n FROM f JOIN a ON f.song = a.song AND f.v = a.v GROUP BY 1, 2),
x AS (SELECT s.*, n / na AS coverage, n / nf AS belonging, greatest(n / na, n / nf) AS score FROM s JOIN nf USING (folder_id) JOIN na USING (album_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY score DESC, n DESC, album_id) AS rn, lead(score) OVER (PARTITION BY folder_id ORDER BY score DESC, n DESC, album_id) AS nxt FROM x)
SELECT folder_id, album_id, n AS n_shared, round(coverage, 6) AS coverage, round(belonging, 6) AS belonging FROM r WHERE rn = 1 AND (coverage >= 0.6 OR belonging >= 0.9) AND score - COALESCE(nxt, 0) >= 0.0""")
def join_album_by_songs(t):
    marks = lambda c: F.array_join(K.key_variant_markers(c), "|")
    songs = lambda owner, title: with_keys(t.baskets.select(owner, "song", title), title, variants=marks).drop(title)
    out = J.join_album_by_songs(songs("folder_id", "tagged"), songs("album_id", "title"), margin=0.0)
    return out.withColumns({"coverage": F.round("coverage", 6), "belonging": F.round("belonging", 6)})


@query("join_grab_target", """
SELECT o_orderkey AS hash, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN o_custkey + 1 WHEN o_orderkey % 5 = 0 THEN o_custkey + 2 END AS album_id,
 CASE WHEN o_orderkey % 4 = 0 THEN 'recorded' WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'queue' WHEN o_orderkey % 5 = 0 THEN 'name' ELSE 'none' END AS via FROM orders""")
def join_grab_target(t):
    o = t.orders.select(F.col("o_orderkey").alias("hash"), "o_custkey", "o_orderstatus")
    part = lambda n, add: o.filter(F.col("hash") % n == 0).select("hash", (F.col("o_custkey") + add).alias("album_id"), (F.col("o_orderstatus") == "F").alias("songs_agree"))
    return J.join_grab_target(o.select("hash"), part(4, 0), part(3, 1), part(5, 2))


@query("join_presence_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_presence_semi(t):
    albums = t.customer.select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("artist_key"))
    sources = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("artist_key"))
    return J.join_presence_semi(albums, sources).drop("artist_key")


@query("join_keep_semi", """
WITH n AS (SELECT DISTINCT lower(regexp_extract(path, '[^/]+/[^/]+$')) AS k FROM files WHERE partkey % 50 = 0 UNION SELECT DISTINCT lower(regexp_extract(path, '[^/]+$')) FROM files WHERE partkey % 97 = 0 AND suppkey % 9 = 0)
SELECT file_id, lower(regexp_extract(path, '[^/]+/[^/]+$')) IN (SELECT k FROM n) OR lower(regexp_extract(path, '[^/]+$')) IN (SELECT k FROM n) AS needed FROM files""")
def join_keep_semi(t):
    f = t.files
    needed = f.filter("partkey % 50 = 0").select("path").unionAll(
        f.filter("partkey % 97 = 0 AND suppkey % 9 = 0").select(K.file_name("path").alias("path")))
    return J.join_keep_semi(f.select("file_id", "path"), needed).drop("path")


# what an authority lists of an artist, with types; the catalogue holds the finished orders
DERIVED["authority"] = """
SELECT o_custkey AS artist_id, CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE 'Album ' || (o_orderkey % 90) || CASE o_orderkey % 4 WHEN 0 THEN ' (Remastered)' WHEN 1 THEN ': Part' ELSE '' END END AS title,
 CASE o_orderkey % 6 WHEN 0 THEN 'EP' WHEN 1 THEN 'Single' WHEN 2 THEN '' ELSE 'Album' END AS primary_type, CASE o_orderkey % 7 WHEN 0 THEN 'Live' WHEN 1 THEN 'Other' ELSE '' END AS second,
 CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_orderdate AS STRING) END AS date, o_orderstatus AS status FROM orders
"""


@query("join_external_gap", f"""
WITH l AS (SELECT artist_id, {D.release_title('trim(title)')} AS title_key, trim(title) AS title, substr(date, 1, 10) AS date FROM authority WHERE trim(title) <> '' AND primary_type IN ('', 'Album') AND second <> 'Live'),
g AS (SELECT artist_id, title_key, arg_min(title, (date, title)) AS title, min(date) AS date FROM l GROUP BY 1, 2),
h AS (SELECT DISTINCT artist_id, {D.release_title('title')} AS title_key FROM authority WHERE status = 'F')
SELECT artist_id, title_key, title, date, 'missing' AS status, row_number() OVER (PARTITION BY artist_id ORDER BY date, title_key) AS rank FROM g
 WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.artist_id = g.artist_id AND h.title_key = g.title_key)
UNION ALL SELECT c_custkey, NULL, NULL, NULL, 'unchecked', NULL FROM customer WHERE c_custkey NOT IN (SELECT artist_id FROM g)""")
def join_external_gap(t):
    authority = t.authority.withColumn("secondary_types", F.when(F.col("second") != "", F.array("second")))
    artists = t.customer.select(F.col("c_custkey").alias("artist_id"))
    return J.join_external_gap(artists, authority, t.authority.filter("status = 'F'"))


_DIRS = "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM files"


@query("join_ancestor", f"""
WITH d AS ({_DIRS}), v AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM files WHERE {D.ext('path')} IN ('mkv', 'vob'))
SELECT d.path, EXISTS (SELECT 1 FROM v WHERE v.path = d.path OR starts_with(v.path, d.path || '/')) AS holds FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE starts_with(d.path, x.path || '/'))""")
def join_ancestor(t):
    from ledgerline.operators.rollups import parent_dir

    dirs = t.files.select(parent_dir("path").alias("path")).distinct()
    video = t.files.filter(K.file_ext("path").isin("mkv", "vob")).select(parent_dir("path").alias("path"))
    return J.join_holds_below(J.join_ancestor_drop(dirs), video)


DERIVED["releases"] = """
SELECT l_orderkey AS album_id, l_suppkey AS release_id, MIN(l_linenumber) AS ordinal, CAST(SUM(l_linenumber) AS BIGINT) AS track_count, MAX(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS monitored
FROM lineitem GROUP BY l_orderkey, l_suppkey
"""


@query("join_release_capacity", """
WITH c AS (SELECT l_orderkey AS album_id, COUNT(*) AS n_files FROM lineitem GROUP BY 1),
r AS (SELECT c.*, r.release_id, r.track_count, row_number() OVER (PARTITION BY c.album_id ORDER BY abs(r.track_count - n_files), r.ordinal, r.release_id) AS rn, MAX(r.track_count) OVER (PARTITION BY c.album_id) AS mx FROM c JOIN releases r ON c.album_id = r.album_id)
SELECT album_id, n_files, CASE WHEN abs(track_count - n_files) <= 1 THEN release_id END AS release_id, CASE WHEN mx >= n_files THEN mx ELSE 0 END AS room FROM r WHERE rn = 1""")
def join_release_capacity(t):
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("album_id")).agg(F.count("*").alias("n_files"))
    return J.join_release_capacity(counts, t.releases)


@query("join_primary_release", """
SELECT album_id, release_id FROM (SELECT album_id, release_id, row_number() OVER (PARTITION BY album_id ORDER BY CASE WHEN monitored THEN 0 ELSE 1 END, o) AS rn
 FROM (SELECT *, ordinal * 1000000 + release_id AS o FROM releases)) WHERE rn = 1""")
def join_primary_release(t):
    return J.join_primary_release(t.releases.withColumn("ordinal", F.col("ordinal") * 1000000 + F.col("release_id")))


DERIVED["prints"] = """
SELECT e.vec_id, 'p' || (e.vec_id % 200) AS path, e.vec_id AS ordinal, (e.vec_id * 37 % 100) / 100.0 AS score, t.title AS title, t.brand AS artist, t.base AS base
FROM embeddings e JOIN titles t ON e.vec_id = t.id
"""


@query("join_fingerprint_verify", f"""
WITH b AS (SELECT path, score, title, artist FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, ordinal) AS rn FROM prints) WHERE rn = 1),
m AS (SELECT id, 'p' || (id % 260) AS path, title AS want_title, brand AS want_artist FROM titles)
SELECT m.id, CASE WHEN b.path IS NULL THEN NULL WHEN score < 0.5 THEN 'score too low' WHEN {D.compact_title('b.title')} <> {D.compact_title('want_title')} AND b.title <> '' THEN 'title differs'
 WHEN NOT (contains({D.compact_artist('artist')}, {D.compact_artist('want_artist')}) OR contains({D.compact_artist('want_artist')}, {D.compact_artist('artist')})) THEN 'artist differs' END AS reason, b.path IS NULL AS no_hit
FROM m LEFT JOIN b ON m.path = b.path""")
def join_fingerprint_verify(t):
    m = t.titles.select("id", F.concat(F.lit("p"), (F.col("id") % 260).cast("string")).alias("path"), F.col("title").alias("want_title"), F.col("brand").alias("want_artist"))
    out = J.join_fingerprint_verify(m, t.prints)
    return out.select("id", "reason", (F.col("verdict") == "unknown").alias("no_hit"))


@query("join_import_rows", """
SELECT track_id, CASE WHEN track_no > 5 THEN NULL ELSE 'Q' || track_no END AS quality, CASE WHEN track_no > 5 THEN 'no quality for this path' WHEN suppkey % 7 = 0 THEN 'missing id' END AS reason,
 CASE WHEN track_no > 5 OR suppkey % 7 = 0 THEN 'skip' ELSE 'import' END AS action FROM tracks""")
def join_import_rows(t):
    m = t.tracks.select("track_id", "album_id", F.when(F.col("suppkey") % 7 != 0, F.col("suppkey")).alias("artist_id"), F.col("track_id").alias("path"))
    q = t.tracks.filter("track_no <= 5").select(F.col("track_id").alias("path"), F.concat(F.lit("Q"), F.col("track_no").cast("string")).alias("quality"))
    return J.join_import_rows(m, q).select("track_id", "quality", "reason", "action")
