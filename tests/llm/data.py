"""Small tables with everything that is odd."""

from __future__ import annotations

import random

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()

#: columns that the operators use as names inside
CLASHES = ("key", "digest", "size", "kept", "id", "bucket", "component", "spans", "ids", "part", "rank", "label", "_k", "_row", "_text", "path", "blob", "n")


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """``doc_id, text, source``: nulls, empty and blank texts, a very long one, ties and repeated rows."""
    rng = random.Random(4)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "a"), (5, "One", "b"), (6, "one", None),
            (7, prose(rng, 30_000), "b"), (8, "ünï çødé 👍🏽 " * 5, "c"), (None, "no key " + prose(rng, 120), "a"), (None, None, None)]
    body = prose(rng, 200)
    rows += [(20, body, "a"), (20, body, "a"), (21, body, "b"), (22, body.replace(" ", "\t\n"), "b"), (23, body.replace("the", "THE"), "c")]
    words = body.split()
    for i in range(6):
        w = list(words)
        for k in rng.sample(range(len(w)), i):
            w[k] = "changed" + str(k)
        rows.append((30 + i, " ".join(w), rng.choice("abc")))
    rows += [(50 + i, prose(rng, rng.randint(1, 150)), rng.choice("abc")) for i in range(40)]
    return rows


def table(spark, rows):
    """Rows as documents with extra columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *("x" for _ in CLASHES)) for i, t, s in rows], schema)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
