"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source that shall make up share w of N documents, and has n, is repeated at
the mean rate N * w / n. Each document's count is drawn from the Poisson
distribution with that mean, by inverting its cumulative distribution at a
uniform number made from a hash of the seed and the document's id: the same
document gets the same count in any run, on any cluster, and sources are drawn
independently of each other. Documents are exploded by their counts and
shuffled globally by a hash of the id and the copy's number.

Rates over 64 are drawn as a sum of equal parts, each with a hash of its own, so
the cumulative distribution never underflows.

Per-source counts are pre-aggregated on the map side, so a hot source is no
matter. The rates are broadcast only if there are at most ``most_broadcast``
sources; with more, they are joined by source and a salt.

Rows without an id are told apart all the same: equal ones are counted (on the
map side first) and numbered, and each is drawn by the hash of its columns and
its number. They are numbered in pieces of PIECE, so many equal rows are no one
task's work.

Defined results: null and empty source are one source, named ''; rows that repeat
an id share its draw, so they get the same count each; rows with a null id are
drawn one by one; a source without a target weight, or with one that isn't
positive, gets none; texts of any length are carried along; an empty table gives
none; columns stay, whatever their names, and ``copy`` (from 1) is added,
replacing a column of that name, unless number_col is another name or None.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cached, quoted

PART = 64.0
SALTS = 64
#: Equal rows without an id that are numbered at once.
PIECE = 1024


def uniform(seed: str, *of: Column) -> Column:
    """A number in (0, 1) with 52 random bits, from the MD5 of the seed and the values."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in of])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, exponent: float, total: float | None, source_col: str = "source") -> tuple[DataFrame, int]:
    """__source, n and the mean repetition rate of each source; and how many there are.

    Without weights, a source's target is its number of documents to the power
    of exponent (1: as they are, 0: all alike).
    """
    counts = docs.groupBy(F.coalesce(F.col(quoted(source_col)).cast("string"), F.lit("")).alias("__source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double")) if exponent == 0.5 else F.pow(F.col("n").cast("double"), F.lit(exponent))
        weighed = counts.withColumn("w", weight)
    else:
        table = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()] or [("", 0.0)], "__source string, w double")
        weighed = counts.join(table, "__source", "left").withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(0.0))
    weighed = cached(weighed)
    sums = weighed.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    out = float(sums["n"] if total is None else total)
    rate = F.lit(out) * F.col("w") / F.lit(sums["w"]) / F.col("n") if sums["w"] > 0 else F.lit(0.0)
    return weighed.select("__source", "n", rate.alias("rate")), sums["sources"]


def _cumulative(rate: Column) -> Column:
    """P(count <= 0), P(count <= 1), ... for a rate of at most PART, as far as doubles tell them from 1."""
    ends = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("all"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["all"], F.array(F.element_at(state["all"], -1) + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), ends), start, add, lambda state: state["all"])


def identified(docs: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """__row (a struct of the columns) and __key, the text that a row is drawn by: its id, or its columns' hash and its number among equals."""
    row = F.struct(*[F.col(quoted(c)) for c in columns]).alias("__row")
    named = docs.filter(F.col(quoted(id_col)).isNotNull()).select(row, F.col(quoted(id_col)).cast("string").alias("__key"))
    text = F.concat_ws("\x1f", *[F.coalesce(F.col("__row")[c].cast("string"), F.lit("\x1e")) for c in columns])
    equal = docs.filter(F.col(quoted(id_col)).isNull()).select(row).groupBy("__row").agg(F.count(F.lit(1)).alias("__n"))
    pieces = equal.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / PIECE))))
    hashed = pieces.withColumn("__hash", F.md5(text.cast("binary"))).repartition("__hash", "__piece")
    last = F.least(F.col("__n"), (F.col("__piece") + 1) * PIECE)
    numbered = hashed.select("__row", "__hash", F.explode(F.sequence(F.col("__piece") * PIECE + 1, last)).alias("__no"))
    return named.unionByName(numbered.select("__row", F.concat_ws(":", "__hash", F.col("__no").cast("string")).alias("__key")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, total: float | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", most_broadcast: int = 20_000, number_col: str | None = "copy") -> DataFrame:
    """docs, each as often as drawn, in a random order, with the copy's number if it has a column."""
    per_source, sources = rates(docs, weights, exponent, total, source_col)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    tables = per_source.select("__source", "rate", parts.alias("__parts"), _cumulative(F.col("rate") / parts).alias("__cdf")).filter("rate > 0").drop("rate")
    columns = [c for c in docs.columns if c != number_col]
    rows = identified(docs, columns, id_col).withColumn("__source", F.coalesce(F.col("__row")[source_col].cast("string"), F.lit("")))
    key = F.col("__key")
    if sources <= most_broadcast:
        drawn = rows.join(F.broadcast(tables), "__source")
    else:
        salted = tables.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["__source", "__salt"])
    # The first part's hash has no part number, the only one where rates are small.
    first = F.size(F.filter("__cdf", lambda c: c < F.col("__u")))
    more = F.aggregate(F.sequence(F.lit(2), F.col("__parts")), F.lit(0), lambda n, j: n + F.size(F.filter("__cdf", lambda c: c < uniform(seed, key, j))))
    count = F.when(F.col("__parts") > 1, first + more).otherwise(first)
    drawn = drawn.withColumn("__u", uniform(seed, key)).withColumn("__count", count).filter("__count > 0")
    copies = drawn.select("__row", "__key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__count").cast("long"))).alias("__copy"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "__key", F.col("__copy").cast("string")).cast("binary"))
    shuffled = copies.withColumn("__order", order).drop("__key").repartition("__order").sortWithinPartitions("__order")
    return shuffled.select(*[F.col("__row")[c].alias(c) for c in columns], *([F.col("__copy").alias(number_col)] if number_col else []))


def duckdb_sql(seed: str = "mix", columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> str:
    """mix() with its defaults over the table documents of these columns, for DuckDB (rates up to PART)."""
    cells = ", ".join(f"coalesce(cast({c} as varchar), chr(30))" for c in columns)
    return f"""
with n as (select coalesce(source, '') as s, count(*) as n from documents group by 1),
r as (select s, sum(n) over () * sqrt(n) / sum(sqrt(n)) over () / n as rate from n),
c as (select s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by s order by k) as cdf
      from r, generate_series(0, 200) as g(k)),
h as (select d.*, md5(concat_ws(chr(31), {cells})) as h from documents d),
k as (select *, case when doc_id is null then h || ':' || row_number() over (partition by doc_id, h) else cast(doc_id as varchar) end as key from h),
u as (select * exclude (h, key), (('0x' || substr(md5('{seed}:' || key), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u from k),
p as (select u.* exclude (u), (select count(*) from c where c.s = coalesce(u.source, '') and c.cdf < u.u) as m from u)
select * exclude (m), unnest(generate_series(1, m)) as copy from p where m > 0"""
