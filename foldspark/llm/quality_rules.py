"""Quality rules whose cutoffs come from risk control.

A base rule fails short or repetitive documents. Each further rule rejects a
document when a ratio goes beyond a cutoff. The cutoffs of all rules together
make one sequence of settings, fixed in advance, from the loosest to the
tightest; a tighter setting rejects all that a looser one does. The setting is
chosen for each stratum (language) so that, with probability 1 - delta over the
labelled holdout, no stratum's rules together reject more than the share
``risk`` of its good documents:

* a setting is tested with the exact binomial test of "false rejection is above
  the risk" (the exact Clopper-Pearson bound, put as a test), from the loosest
  on; the first failure ends the sequence, so the sequence needs no further
  correction;
* delta is divided by the number of strata (Bonferroni).

The last setting that passed is used; a stratum without one rejects nothing
beyond the base rule. With risk 2 % and delta 5 % over four strata, 217 good
labelled documents are enough for settings that reject none of them.

False rejections are counted by Spark over all labelled documents, each id once:
it becomes one number (the loosest setting that rejects one of its rows), and
equal numbers are summed on the map side.

Defined results: null text is empty and fails the base rule; texts of any length
are read whole; a null stratum is a stratum of its own; null labels are no
labels; a document with several labels is good if one says so; repeated rows
stay, and a repeated id counts once among the labelled; a null id stays and is no
label's; other columns aren't read and may have any name; without labels only
the base rule rejects; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cached, compact, quoted
from .text_stats import with_base_stats

#: How many settings the sequence has.
SETTINGS = 16


@dataclass(frozen=True)
class Rule:
    name: str
    #: A ratio that grows with badness, made of the base statistics.
    value: str
    #: The cutoffs of the first and the last setting.
    loosest: float
    tightest: float

    @property
    def cutoffs(self) -> tuple[float, ...]:
        """Evenly spaced on a logarithmic scale."""
        share = (self.tightest / self.loosest) ** (1 / (SETTINGS - 1))
        return tuple(self.loosest * share**i for i in range(SETTINGS))


RULES = (
    Rule("symbols", "try_divide(__symbols, __chars)", 0.9, 0.05),
    Rule("duplicate lines", "try_divide(__dups, __lines)", 0.95, 0.3),
    Rule("repeated words", "try_divide(__repeats, __words)", 0.495, 0.25),
    Rule("long words", "try_divide(__chars, __words)", 100.0, 9.5),
    Rule("short words", "try_divide(__words, __chars)", 1.0, 0.32),
)
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Cutoffs of up to so many strata are broadcast; of more, joined.
MOST_BROADCAST = 1000


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b), by the continued fraction, which takes some root of a + b steps at most."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total, m = d, 0
    while True:
        m += 1
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-13 or m > 1_000_000:
            return front * total


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with probability p."""
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    return 0.0 if p >= 1 else min(1.0, max(0.0, incomplete_beta(n - k, k + 1, 1 - p)))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of a share, k of n, at level 1 - delta."""
    low, high = k / n if n else 0.0, 1.0
    if not n or k >= n:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def certified(rejected: list[int], n: int, risk: float, delta: float) -> int:
    """How many cutoffs of a sequence pass: rejected[i] of n good documents go at the i-th."""
    for i, k in enumerate(rejected):
        if not n or k > risk * n or binomial_cdf(k, n, risk) > delta:
            return i
    return len(rejected)


def base_failed() -> Column:
    return (F.col("__words") < LEAST_WORDS) | (100 * F.col("__repeats") > MOST_REPEATED * F.col("__words"))


def passes(rule: Rule) -> Column:
    """How many settings the rule lets the document through: SETTINGS if none rejects it."""
    value = F.coalesce(F.expr(rule.value), F.lit(float("-inf")))
    return F.size(F.filter(F.array(*[F.lit(c) for c in rule.cutoffs]), lambda c: value <= c))


def thresholds(stats: DataFrame, labels: DataFrame, risk: float, delta: float, id_col: str) -> tuple[DataFrame, int]:
    """__stratum, good (its good labelled documents), __held (how many settings hold) and bound (the exact upper bound of the last one's false rejection) of every stratum with labels; and how many there are."""
    good = labels.filter("quality is not null").groupBy(F.col(quoted(id_col)).cast("string").alias("__id")).agg(F.max("quality").alias("__q")).filter("__q > 0").select("__id")
    passed = stats.filter(~base_failed()).select(F.col(quoted(id_col)).cast("string").alias("__id"), "__stratum", F.least(*[passes(r) for r in RULES]).alias("__passes"))
    once = passed.join(good, "__id", "left_semi").groupBy("__id", "__stratum").agg(F.min("__passes").alias("__passes"))
    counts = once.groupBy("__stratum", "__passes").agg(F.count(F.lit(1)).alias("n"))
    by = compact(counts.groupBy("__stratum").agg(F.collect_list(F.struct("__passes", "n")).alias("cells"), F.sum("n").alias("good")))
    strata = by.count()

    def row(r) -> tuple:
        n, level = int(r.good), delta / strata
        rejected = [sum(int(c["n"]) for c in r.cells if c["__passes"] <= i) for i in range(SETTINGS)]
        held = certified(rejected, n, risk, level)
        return r.stratum, n, held, upper_bound(rejected[held - 1], n, level) if held else None

    def run(batches):
        for rows in batches:
            yield pd.DataFrame([row(r) for r in rows.itertuples()], columns=["__stratum", "good", "__held", "bound"])

    return by.withColumnRenamed("__stratum", "stratum").mapInPandas(run, "__stratum string, good long, __held int, bound double"), strata


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, the base statistics, base_failed, kept, and why: the rules that reject."""
    rows = docs.select(F.col(quoted(id_col)), F.col(quoted(stratum_col)).cast("string").alias("__stratum"), F.col(quoted(text_col)).alias("__text"))
    stats = cached(with_base_stats(rows, [id_col, "__stratum"], "__text"))
    found, strata = thresholds(stats, labels, risk, delta, id_col)
    table = found.select(F.coalesce("__stratum", F.lit("\0")).alias("__s"), "__held")
    judged = stats.withColumn("__s", F.coalesce("__stratum", F.lit("\0"))).join(F.broadcast(table) if strata <= MOST_BROADCAST else table, "__s", "left")

    held = F.coalesce("__held", F.lit(0))
    why = F.array_compact(F.array(F.when(base_failed(), F.lit("base")), *[F.when(passes(r) < held, F.lit(r.name)) for r in RULES]))
    return judged.select(
        id_col, F.col("__words").alias("n_words"), F.col("__chars").alias("word_chars"), F.col("__symbols").alias("n_symbols"), F.col("__dups").alias("n_dup_lines"),
        F.col("__repeats").alias("n_repeat_words"), base_failed().alias("base_failed"), (F.size(why) == 0).alias("kept"), F.array_join(why, ", ").alias("why"),
    )
