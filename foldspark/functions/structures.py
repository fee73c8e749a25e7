"""Dot-bracket strings: pairs, helices, distances and agreement of structures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def pair_table(structure: str) -> list[int]:
    """The partner of each base, -1 for none; an error for unbalanced or unknown signs."""
    out, opened = [-1] * len(structure), []
    for i, c in enumerate(structure):
        if c == "(":
            opened.append(i)
        elif c == ")":
            if not opened:
                raise ValueError("unbalanced structure")
            j = opened.pop()
            out[i], out[j] = j, i
        elif c not in ".,x":
            raise ValueError(f"unknown sign {c!r}")
    if opened:
        raise ValueError("unbalanced structure")
    return out


def helices(pairs: list[int], keep_lonely: bool = True) -> list[tuple[int, int, int]]:
    """Stacked pairs as (first, partner of the first, length)."""
    out: list[tuple[int, int, int]] = []
    for i, j in enumerate(pairs):
        if j > i:
            if out and out[-1][0] + out[-1][2] == i and out[-1][1] - out[-1][2] == j:
                out[-1] = (*out[-1][:2], out[-1][2] + 1)
            else:
                out.append((i, j, 1))
    return [h for h in out if keep_lonely or h[2] > 1]


def compatible(a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """Whether two helices can stand in one structure: no base twice, no crossing."""
    pairs = [(h[0] + k, h[1] - k) for h in (a, b) for k in range(h[2])]
    bases = [x for p in pairs for x in p]
    return len(set(bases)) == len(bases) and all(not (p[0] < q[0] < p[1] < q[1]) for p in pairs for q in pairs)


@pandas_udf(T.ArrayType(T.IntegerType()))
def pairs_of(structures: pd.Series) -> pd.Series:
    """Partners of each base; null for a string that is no structure."""

    def one(s):
        try:
            return pair_table(s) if s is not None else None
        except ValueError:
            return None

    return structures.map(one)


@pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "partner", "length")])))
def helices_of(structures: pd.Series) -> pd.Series:
    def one(s):
        try:
            return [dict(first=a, partner=b, length=n) for a, b, n in helices(pair_table(s))] if s is not None else None
        except ValueError:
            return None

    return structures.map(one)


def is_balanced(structure: Column) -> Column:
    """Opening and closing signs match, and none closes too early; without a stack: depths are running sums."""
    signs = F.transform(F.split(structure, ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    depth = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.least(s["least"], s["now"] + x).alias("least")))
    return (depth["now"] == 0) & (depth["least"] >= 0)


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ; null for other lengths."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)))


def pair_stats(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """PPV and sensitivity of predicted pairs (arrays of partners)."""
    hit = F.size(F.filter(F.zip_with(truth, predicted, lambda t, p: (t == p) & (t >= 0)), lambda x: x))
    t, p = (F.size(F.filter(c, lambda x: x >= 0)) for c in (truth, predicted))
    sums = df.groupBy(*keys).agg(F.sum(hit).alias("common"), F.sum(t).alias("true_pairs"), F.sum(p).alias("predicted_pairs"))
    return sums.select(*keys, F.when(F.col("predicted_pairs") > 0, F.col("common") / F.col("predicted_pairs")).alias("ppv"), F.when(F.col("true_pairs") > 0, F.col("common") / F.col("true_pairs")).alias("sensitivity"))


def concatenated(a: Column, b: Column) -> Column:
    """One structure behind another; pairs of the second move on by the first's length."""
    return F.concat(a, b)


def shifted(helices: Column, by) -> Column:
    """Helices (first, partner, length) moved along the sequence."""
    return F.transform(helices, lambda h: F.struct((h["first"] + by).cast("int").alias("first"), (h["partner"] + by).cast("int").alias("partner"), h["length"].alias("length")))
