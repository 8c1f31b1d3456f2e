"""The operators on the given tables: one query each, with the contract's columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, conversations, exact_dedup, mixing, near_dedup, ngram_join, pii, quality_model, quality_rules, secret_scan, suffix_dedup, toxicity, vector_codes
from ledgerline.llm.common import documents, held_out, new_folder
from ledgerline.session import table


def _predicted(scores: DataFrame, least: float) -> DataFrame:
    """Scores under the contract's names, with the verdict at a threshold."""
    return scores.withColumnRenamed("key", "doc_id").withColumns({
        "held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= least).cast("int")})


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.detected(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return spans.select(F.col("key").alias("doc_id"), *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return found.select(F.col("key").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return _predicted(found, 0.3).withColumn("neighbours", F.to_json(found["neighbours"]))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return judged.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def coded(docs: DataFrame) -> DataFrame:
    """Each text encoded and decoded again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded.select("doc_id", "ids"), ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(documents(spark, sf_dir), words=4)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the one version of a path, over a new ledger."""
    rules = secret_scan.RULES
    found = secret_scan.scan(documents(spark, sf_dir), new_folder(spark, "ledger"), "doc_id")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    base = F.filter("findings", lambda s: s["rule"].isin([r.name for r in rules if r.base]))
    count = lambda name: F.size(F.filter("findings", lambda s: s["rule"] == name)).cast("long").alias(f"n_{name}")
    return found.select(F.col("path").alias("doc_id"), *(count(r.name) for r in rules if r.base),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(quality_model.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels")), 0.7)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.without_repeats(documents(spark, sf_dir))
    return left.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                       (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("repeats"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(documents(spark, sf_dir))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.select(F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.joined_groups(documents(spark, sf_dir))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    turns, report = conversations.repaired(conversations.damaged(original))
    digests = conversations.digests(turns)
    every = original.select("conv_id").distinct()
    joined = every.join(report, every["conv_id"].eqNullSafe(report["key"]), "left").drop("key")
    joined = joined.join(digests, joined["conv_id"].eqNullSafe(digests["key"]), "left").drop("key")
    counts = ("gaps", *conversations.FAULTS, "illegal", "cost")
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pii, op2_exact_dedup, op3_toxicity, op4_quality_rules, op5_byte_bpe, op6_near_dedup, op7_secret_scan, op8_quality_model, op9_repeats, op10_mix_sources, op11_vector_codes, op12_ngram_join, op13_conversation_repair)}


def _codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Plain search of every entry for every part, unrolled over the rounds."""
    near = """SELECT p.i, p.vec_id, p.label, p.k, p.x, arg_min(c.j, {{'d': {d}, 'j': c.j}}) AS j, min({d}) AS d
              FROM p JOIN c{r} c ON c.k = p.k GROUP BY ALL"""
    square = "list_sum(list_transform(list_zip(p.x, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = "".join(f""",
        a{r} AS ({near.format(d=square, r=r)}),
        m{r} AS (SELECT k, j, list(s ORDER BY pos) AS e FROM (SELECT k, j, pos, CAST(floor(CAST(sum(x[pos]) AS DOUBLE) / count(*)) AS BIGINT) AS s FROM a{r}, range(1, len(x) + 1) AS u(pos) GROUP BY ALL) GROUP BY k, j),
        c{r + 1} AS (SELECT c.k, c.j, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (k, j))""" for r in range(rounds))
    return f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT i, vec_id, label, k, q[k * (len(q) // 16) + 1:(k + 1) * (len(q) // 16)] AS x FROM v, range(16) AS u(k)),
        c0 AS (SELECT k, i - 1 AS j, x AS e FROM p WHERE i <= 64){steps},
        f AS ({near.format(d=square, r=rounds)}),
        r AS (SELECT vec_id, label, string_agg(printf('%02x', j), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY i, vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
          (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY k, j)) FROM c{rounds}) AS codebooks_sha256 FROM r"""


def _links_sql(words: int) -> str:
    """Components of documents by shingles of so many words: all pairs that share one."""
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {words - 1}], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {words - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        shared AS (SELECT s FROM s GROUP BY 1 HAVING count(*) > 1),
        few AS (SELECT s.* FROM s JOIN shared USING (s)),
        edges AS (SELECT a.doc_id AS a, b.doc_id AS b FROM few a JOIN few b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
                  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (min(na.n) + min(nb.n) - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
        groups AS (SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n)"""


ORACLES: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    # edits row by row: the least cost and audit of each state, with the lines they give
    "op13_conversation_repair": r"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::UBIGINT)),
            lambda h, b: list_reduce([xor(h, b), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 20 AS k FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS n FROM c WHERE k <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i FROM d),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
          lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
          (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])) AS v(a, b, c, e, l)),
        own AS (SELECT * FROM (VALUES ('D', '', 0, 0, 3), ('D', '', 1, 1, 3), ('D', '', 2, 2, 3), ('D', '', 3, 3, 3), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
          ('R', 'user', 0, 2, 2), ('R', 'user', 1, 2, 2), ('R', 'user', 3, 2, 2), ('R', 'assistant', 2, 3, 2)) AS v(e, r, a, b, c)),
        p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS st, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS s FROM o
          UNION ALL SELECT conv_id, i, st, min(s) AS s FROM (SELECT p.conv_id, f.i, m.b AS st, {'cost': p.s.cost + n.c + m.c + CASE WHEN m.e <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': p.s.audit || n.e || m.e,
              'lines': list_concat(list_concat(p.s.lines, n.l), CASE m.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [m.r || ':' || f.text] END)} AS s
            FROM p JOIN ins n ON n.a = p.st JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN own m ON m.a = n.b AND (m.e = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (m.e = 'R' OR role[1] = m.r))) GROUP BY conv_id, i, st),
        z AS (SELECT conv_id, max(i) AS i FROM f GROUP BY 1),
        best AS (SELECT p.conv_id, min({'cost': p.s.cost + n.c, 'audit': p.s.audit || n.e, 'lines': list_concat(p.s.lines, n.l)}) AS s FROM p JOIN z ON z.conv_id IS NOT DISTINCT FROM p.conv_id AND z.i = p.i JOIN ins n ON n.a = p.st AND n.b IN (0, 3) GROUP BY 1),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
          count(*) FILTER (i > 1 AND (before || role[1]) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
        SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(s.cost AS BIGINT), 0) AS cost,
          coalesce(s.audit, '') AS audit, sha256(coalesce(array_to_string(s.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id""",
    "op6_near_dedup": f"{_links_sql(4)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM groups",
    "op12_ngram_join": f"{_links_sql(5)} SELECT doc_id, n_shingles, component_id FROM groups",
    "op7_secret_scan": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        k AS (SELECT * FROM (VALUES
          (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'), (1, 'access', 'AKIA[A-Z0-9]{16,}'), (2, 'hex', '[0-9a-f]{24,}'),
          (3, 'jwt', 'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}'), (4, 'pem', '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----')) AS v(o, kind, p)),
        h AS (SELECT doc_id, 0 AS o, regexp_extract_all(t, (SELECT p FROM k WHERE o = 0)) AS hits, regexp_extract_all(t, (SELECT p FROM k WHERE o = 0), 2) AS tested, string_split_regex(t, (SELECT p FROM k WHERE o = 0)) AS gaps FROM d
          UNION ALL SELECT doc_id, o, regexp_extract_all(t, p), regexp_extract_all(t, p), string_split_regex(t, p) FROM d, k WHERE o > 0),
        e AS (SELECT doc_id, o, hits, tested, gaps, unnest(range(1, len(hits) + 1)) AS i FROM h),
        s AS (SELECT doc_id, o, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a, length(hits[i]) AS n
          FROM e WHERE o > 0 OR length(tested[i]) >= 6),
        f AS (SELECT doc_id, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2,
          string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, o) AS spans
          FROM s JOIN k USING (o) GROUP BY 1)
        SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN f USING (doc_id)""",
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
