"""Inputs derived from the given tables (SQL that both engines run)."""

from ledgerline.bindings.registry import DERIVED

# song and album titles with every kind of noise the keys have to see through
DERIVED["titles"] = """
SELECT p_partkey AS id, p_brand AS brand, p_name AS base, p_size AS n_tracks, p_retailprice AS price,
  CASE p_partkey % 24
    WHEN 0 THEN p_name
    WHEN 1 THEN p_name || ' (Remastered 2020)'
    WHEN 2 THEN '03. ' || p_name
    WHEN 3 THEN p_name || '-cd1'
    WHEN 4 THEN p_name || ' feat. Guest & Co'
    WHEN 5 THEN p_name || ' - Live'
    WHEN 6 THEN p_name || ' (take 2)'
    WHEN 7 THEN 'The ' || p_name || ', Pt. 1'
    WHEN 8 THEN p_name || ' [Deluxe Edition]'
    WHEN 9 THEN p_name || ' & Friends, Vol. 2'
    WHEN 10 THEN 'Élan ' || p_name || ' Ñandú'
    WHEN 11 THEN p_name || ' - Remix - Mono'
    WHEN 12 THEN p_name || ': Complete Collection'
    WHEN 13 THEN 'The Quintessential ' || p_name || ', Volume 9: 1940-1942'
    WHEN 14 THEN p_name || ' Greatest Hits 2001'
    WHEN 15 THEN 'Лили ' || p_name
    WHEN 16 THEN '1988 ' || p_brand || ' - ' || p_name || ' (1988 Island)'
    WHEN 17 THEN 'Live At ' || p_name
    WHEN 18 THEN p_name || ' Deluxe Edition 2011'
    WHEN 19 THEN p_name || ' remastered 2011'
    WHEN 20 THEN '99 ' || p_name
    WHEN 21 THEN 'DJ ' || p_name
    WHEN 22 THEN p_name || ' {demo} instrumental'
    ELSE '夜 ' || p_name END AS title
FROM part
"""

# artist credits: the same customers as other people spell them
DERIVED["credits"] = """
SELECT c_custkey AS id, c_name AS artist, c_nationkey AS nation,
  CASE c_custkey % 14
    WHEN 0 THEN c_name
    WHEN 1 THEN 'The ' || c_name
    WHEN 2 THEN 'DJ ' || c_name
    WHEN 3 THEN c_name || ' feat. Kirsty Hawkshaw'
    WHEN 4 THEN c_name || ' & The Sweet Inspirations'
    WHEN 5 THEN 'Ms. ' || c_name
    WHEN 6 THEN 'Motörhead ' || c_name
    WHEN 7 THEN 'Лили Иванова ' || c_name
    WHEN 8 THEN 'Òàíãî Ëèëè Èâàíîâà ' || substr(c_name, 10, 9)
    WHEN 9 THEN upper(c_name)
    WHEN 10 THEN c_name || ' (Anni-Frid Lyngstad)'
    WHEN 11 THEN substr(c_name, 1, 12)
    WHEN 12 THEN translate(substr(c_name, 10, 9), '0123456789', 'ابتثجحخدذر')
    ELSE 'Kustomer#' || substr(c_name, 10, 9) END AS credit
FROM customer
"""

# files inside downloaded bundles, one per line item
DERIVED["files"] = """
SELECT 'h' || (l_orderkey % 997) AS hash, l_orderkey AS orderkey, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS file_id,
  CAST(floor(l_extendedprice * 100) AS BIGINT) AS size, CAST(floor(l_quantity) AS BIGINT) AS qty,
  l_returnflag AS flag, l_linestatus AS status, l_shipdate AS shipdate,
  'Supplier ' || (l_suppkey % 50) || '/'
  || CASE l_orderkey % 6 WHEN 0 THEN 'Singles/' WHEN 1 THEN 'Live/' ELSE '' END
  || (1980 + l_orderkey % 40) || ' - Album ' || (l_orderkey % 200)
  || CASE WHEN l_orderkey % 5 = 0 THEN ' (Deluxe)' ELSE '' END
  || CASE l_linenumber WHEN 6 THEN '/CD2' WHEN 7 THEN '/Scans' WHEN 5 THEN '/VIDEO_TS' WHEN 4 THEN '/AUDIO_TS' ELSE '' END
  || '/0' || l_linenumber || CASE l_orderkey % 3 WHEN 0 THEN ' - ' WHEN 1 THEN '. ' ELSE ' ' END
  || 'Song_' || (l_partkey % 300)
  || CASE l_partkey % 9 WHEN 0 THEN '.mp3' WHEN 1 THEN '.jpg' WHEN 2 THEN '.mkv' WHEN 3 THEN '.vob' WHEN 4 THEN '.cue' ELSE '.flac' END AS path
FROM lineitem
"""

# sources: tagged songs on disk (one per line item), and the songs the catalogue wants
DERIVED["songs"] = """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ordinal,
  CASE WHEN l_linenumber = 7 AND l_orderkey % 11 = 0 THEN '' ELSE t.title END AS title,
  CASE WHEN l_orderkey % 4 = 0 THEN t.brand || ' feat. Guest' WHEN l_orderkey % 4 = 1 THEN '' ELSE t.brand || ' & Supplier ' || l_suppkey END AS artist,
  CASE WHEN l_orderkey % 17 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(l_extendedprice * 10) AS BIGINT) END AS duration_ms
FROM lineitem JOIN titles t ON l_partkey = t.id
"""
DERIVED["wants"] = """
SELECT CAST(id AS STRING) AS ordinal, title, brand AS artist, 'Album ' || (id % 100) AS album,
  CASE WHEN id % 13 = 0 THEN CAST(0 AS BIGINT) ELSE (id * 7919) % 1000000 END AS duration_ms
FROM titles
"""

# catalogue: albums are orders, tracks are line items
DERIVED["album_facts"] = """
SELECT l_orderkey AS album_id, COUNT(*) AS total, SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS have,
  COUNT(DISTINCT l_partkey) AS n_songs, MAX(l_suppkey) AS supplier
FROM lineitem GROUP BY l_orderkey
"""
DERIVED["albums"] = """
SELECT o.o_orderkey AS album_id, o.o_custkey AS artist_id, o.o_orderstatus <> 'P' AS monitored,
  substr(CAST(o.o_orderdate AS STRING), 1, 10) AS release_date,
  CAST(COALESCE(f.have, 0) AS BIGINT) AS have, CAST(COALESCE(f.total, 0) AS BIGINT) AS total
FROM orders o LEFT JOIN album_facts f ON o.o_orderkey = f.album_id
"""
DERIVED["tracks"] = """
SELECT l_orderkey AS album_id, l_linenumber AS track_no, l_partkey AS song_id, l_suppkey AS suppkey,
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS track_id,
  l_linestatus = 'F' AS has_file, l_returnflag <> 'R' AS track_monitored, CAST(floor(l_extendedprice * 10) AS BIGINT) AS duration_ms,
  t.title AS title, t.brand AS artist
FROM lineitem JOIN titles t ON l_partkey = t.id
"""
# albums by title: one per part, artist = brand
DERIVED["titled_albums"] = """
SELECT p_partkey AS ordinal, p_partkey AS album_id, p_brand AS artist, p_name AS title,
  CAST(p_size AS BIGINT) AS total, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size - 1 END AS BIGINT) AS have,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE 0 END AS BIGINT) AS tracks_have, CAST(p_size AS BIGINT) AS tracks_total,
  CAST(1960 + p_partkey % 60 AS STRING) || '-05-01' AS release_date
FROM part
"""
