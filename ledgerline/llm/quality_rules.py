"""Learned decision lists: sequential covering over labelled statistics.

A rule is a conjunction of thresholds on features.  Rules are grown condition
by condition for the best information gain, pruned on rows kept back from
growing, and taken in order until none is precise enough.  All statistics are
counts that Spark sums over every labelled row; the driver sees one number for
each feature, bin and label.  The list is emitted as one ordered conditional
expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import held_out, staged
from ledgerline.llm.features import RATIOS, counted, ratios

#: quantiles of each class that become thresholds of a feature
QUANTILES = 16

#: limits of a list and of a rule
MAX_RULES, MAX_CONDITIONS = 16, 4

#: a rule stays if so much of what it covers, of the rows kept back too, is of the class it names
PRECISION = 0.97

#: and if it covers so much of that class
SUPPORT = 0.002

#: base rules: fewest words, most repeated words in percent
LEAST_WORDS, MOST_REPEATED = 50, 50


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def rule_number(rules: Sequence[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(i)) if out is None else out.when(holds, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def thresholds(rows: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each feature in each class, and the middles between them."""
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    got = rows.groupBy("label").agg(*(F.percentile_approx(f, at, 10_000).alias(f) for f in features)).collect()
    found = {f: sorted({x for r in got for x in (r[f] or [])}) for f in features}
    return {f: sorted({*xs, *((a + b) / 2 for a, b in zip(xs, xs[1:], strict=False))}) for f, xs in found.items()}


def _gain(p: float, n: float, base: float) -> float:
    return p * (math.log2(p / (p + n)) - base) if p else 0.0


def learn(rows: DataFrame, features: Sequence[str], key: str = "key") -> list[Rule]:
    """Rules for label 0 from ``rows``: ``key``, ``label`` 0 or 1 and the features.

    Rows with a null label are left out; null features hold in no condition.
    Without rows of either class the list is empty.  A third of the rows, by a
    hash of the key, prunes what the others grew.  Ties go to the first feature,
    and within it to the middle threshold, which lies in the gap between the
    classes; so equal rows give equal lists.
    """
    rows = rows.filter(F.col("label").isin(0, 1))
    cuts = thresholds(rows, features)
    if not all(cuts.values()):
        return []
    below = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda t: t < F.col(f)))
    cells = staged(rows.select("label", (F.pmod(F.xxhash64(key, F.lit("prune")), F.lit(3)) == 0).alias("back"), *(F.when(F.col(f).isNotNull(), below(f)).alias(f) for f in features))
                   .groupBy("label", "back", *features).agg(F.count("*").alias("n")), "cells")
    # a condition on bins: the value exceeds threshold i exactly if more than i thresholds lie below it
    binned = lambda c: F.col(c.feature) > cuts[c.feature].index(c.threshold) if c.above else F.col(c.feature) <= cuts[c.feature].index(c.threshold)
    total = {r["label"]: r["n"] for r in cells.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(total) < 2:
        return []
    rules: list[Rule] = []
    left = cells
    while len(rules) < MAX_RULES:
        rule = _grow(left.filter(~F.col("back")), cuts, features, binned)
        rule = _prune(left.filter("back"), rule, binned) if rule else ()
        if not rule:
            break
        holds = F.lit(True)
        for c in rule:
            holds = holds & binned(c)
        seen = {(r["label"], r["back"]): r["n"] for r in left.filter(holds).groupBy("label", "back").agg(F.sum("n").alias("n")).collect()}
        bad, good = (sum(n for (y, _), n in seen.items() if y == label) for label in (0, 1))
        kept_bad, kept_good = seen.get((0, True), 0), seen.get((1, True), 0)
        if bad < max(5, SUPPORT * total[0]) or bad < PRECISION * (bad + good) or kept_bad < PRECISION * (kept_bad + kept_good):
            break
        rules.append(rule)
        left = left.filter(~F.coalesce(holds, F.lit(False)))
    return rules


def _grow(cells: DataFrame, cuts: dict[str, list[float]], features: Sequence[str], binned) -> Rule:
    rule: list[Condition] = []
    base = None
    while len(rule) < MAX_CONDITIONS:
        inside = cells
        for c in rule:
            inside = inside.filter(binned(c))
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in features)))
        got = inside.select("label", "n", each.alias("x")).groupBy("x.feature", "x.bin", "label").agg(F.sum("n").alias("n")).filter("bin IS NOT NULL").collect()
        counts: dict[str, dict[int, list[int]]] = {f: {} for f in features}
        for r in got:
            counts[r["feature"]].setdefault(r["bin"], [0, 0])[r["label"]] += r["n"]
        first = counts[features[0]].values()
        bad, good = sum(x[0] for x in first), sum(x[1] for x in first)
        if not bad or not good and rule:
            break
        base = math.log2(bad / (bad + good))
        best: tuple[float, list[Condition]] | None = None
        for f in features:
            p = n = 0
            all_p, all_n = (sum(x[i] for x in counts[f].values()) for i in (0, 1))
            for i, t in enumerate(cuts[f]):
                low = counts[f].get(i, (0, 0))
                p, n = p + low[0], n + low[1]
                for c, gain in ((Condition(f, False, t), _gain(p, n, base)), (Condition(f, True, t), _gain(all_p - p, all_n - n, base))):
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, [c])
                    elif gain > best[0] - 1e-9 and (f, c.above) == (best[1][0].feature, best[1][0].above):
                        best[1].append(c)
        if best is None or best[0] <= 1e-6:
            break
        rule.append(best[1][len(best[1]) // 2])
    return tuple(rule)


def _prune(cells: DataFrame, rule: Rule, binned) -> Rule:
    """The shortest beginning of the rule with the best (p - n) / (p + n)."""
    depth = F.lit(0)
    holds = F.lit(True)
    for i, c in enumerate(rule, 1):
        holds = holds & F.coalesce(binned(c), F.lit(False))
        depth = F.when(holds, F.lit(i)).otherwise(depth)
    got = cells.groupBy(depth.alias("depth"), "label").agg(F.sum("n").alias("n")).collect()
    best, keep = -2.0, len(rule)
    for k in range(1, len(rule) + 1):
        p, n = (sum(r["n"] for r in got if r["depth"] >= k and r["label"] == label) for label in (0, 1))
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-9:
            best, keep = worth, k
    return rule[:keep]


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", held: Callable[[Column], Column] = held_out) -> DataFrame:
    """One row per row of ``docs``: ``key``, the counts, ``base_failed, rule, kept``.

    ``kept`` is false where a base rule fails or a rule of the list, learned
    from the labelled rows that pass the base rules and are not held out,
    names the text as poor.  A null text counts as empty and fails.  Without
    labels only the base rules decide.  Repeated rows get equal verdicts; a
    label repeated for one key counts as often; null keys have none.  An empty
    table gives an empty result; texts of any length are one row.  Other columns
    are not read.  ``held`` tells which keys are kept from learning.
    """
    counts = staged(counted(docs, key, text), "counts")
    scored = counts.withColumn("base_failed", base_failed()).withColumns(ratios() | {c: F.col(c) for c in counts.columns if c not in RATIOS})
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(~held(F.col("key")))
    rules = learn(scored.filter(~F.col("base_failed")).join(known, "key"), RATIOS)
    number = F.when(~F.col("base_failed"), rule_number(rules))
    return (scored.withColumn("rule", number).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
            .withColumns({c: F.col(c).cast("long") for c in ("n_words", "longest_word")}))
