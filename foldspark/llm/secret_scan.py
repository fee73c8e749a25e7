"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is a blob named by the SHA-256 of its text. The
ledger (a folder of Parquet files that grows) says which blob was scanned with
which rule version and what was found. An update takes each distinct blob once,
applies only the rules whose version the ledger lacks for it, and appends what
it finds; findings are joined back to every path that holds the blob. A new rule
version scans again with that rule alone; a copy of a known blob is never
scanned. An update that is cut off appends nothing, and one that is repeated
does no harm: equal findings count once.

Positions come from splitting a text at the matches: a match starts behind all
the pieces and matches before it. These sums are made in chunks, and texts are
cut in chunks when they are masked, so a text with very many findings takes
little more than linear time. Offsets are code points, the end is exclusive.

Rules assign, access and hex are the base; pem and jwt are added. A match whose
named group is shorter than the rule asks is dropped, and what it covers is not
searched again. (For access and hex the length can stand in the pattern: their
matches are whole runs, so no other match could begin within a dropped one.)

Defined results: null text is the empty blob, without findings (and stays null
when texts are masked); very long texts are scanned whole; a null id stays null;
repeated rows and ids stay, each row with its own text's findings; an empty table
gives none; columns other than the id and the text aren't read, may have any name
and stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cached, quoted


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    #: What a match is; group is the one whose length counts.
    pattern: str
    group: int
    least: int
    #: A text without a match of this has no finding.
    needs: str

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base patterns.
_NAMES = "((?i:password|passwd|secret|token|api_?key))"
_ASSIGN = _NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""

RULES = (
    Rule("assign", 1, _ASSIGN % "+", 2, 12, _ASSIGN % "{12,}"),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", 0, 18, "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\."),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,end:int,rule:string>>"
LEDGER = f"blob binary, scanned array<string>, spans {SPANS}"
CHUNK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(values: Column) -> Column:
    """An array cut into arrays of CHUNK."""
    last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))).otherwise(F.array(F.slice(values, 1, 0)))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or maxima) of an array of whole numbers, the chunks' totals first, then within chunks."""
    zero = F.lit(0)

    def grow(state: Column, x: Column) -> Column:
        return F.concat(state, F.array(add(F.element_at(state, -1), x)))

    def whole(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, add))
        before = F.aggregate(totals, F.array(zero), grow)
        return _let(before, lambda b: F.flatten(F.transform(F.arrays_zip(chunks.alias("0"), F.slice(b, F.lit(1), F.size(chunks)).alias("1")), lambda x: F.slice(F.aggregate(x["0"], F.array(x["1"]), grow), F.lit(2), F.size(x["0"])))))

    return _let(values, lambda v: _let(_chunks(v), whole))


def _spans(text: Column, rule: Rule) -> Column:
    """The rule's findings in text, in order."""
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    lengths = F.transform(F.arrays_zip(between.alias("0"), found.alias("1"), counted.alias("2")), lambda x: F.struct(F.length(x["0"]).alias("b"), F.length(x["1"]).alias("m"), F.length(x["2"]).alias("c")))
    # The text behind the last match has no match of its own.
    matches = F.filter(lengths, lambda x: x["m"].isNotNull())

    def placed(each: Column) -> Column:
        ends = _running(F.transform(each, lambda x: x["b"] + x["m"]), lambda a, b: a + b)
        pairs = F.filter(F.arrays_zip(each.alias("0"), ends.alias("1")), lambda x: x["0"]["c"] >= rule.least)
        return F.transform(pairs, lambda x: F.struct((x["1"] - x["0"]["m"]).alias("start"), x["1"].alias("end"), F.lit(rule.key).alias("rule")))

    return F.when(text.rlike(rule.needs), _let(matches, placed)).otherwise(F.array()).cast(SPANS)


def blobs_of(history: DataFrame, text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary"), 256))


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """New ledger rows for the blobs of ``history``: blob, scanned (rule keys), spans.

    Only (blob, rule version) pairs that ``ledger`` lacks are scanned; a blob
    without such a pair gives no row.
    """
    blobs = history.select(blobs_of(history, text_col).alias("blob"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    seen = F.coalesce("seen", F.array().cast("array<string>"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    found = [F.when(F.array_contains(seen, r.key), F.array().cast(SPANS)).otherwise(_spans(F.col("text"), r)) for r in rules]
    return blobs.filter(F.size(F.array_except(keys, seen)) > 0).select("blob", F.array_except(keys, seen).alias("scanned"), F.array_sort(F.flatten(F.array(*found))).alias("spans"))


class Ledger:
    """The ledger's rows in a folder that all executors share; it outlives sessions if the folder does."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        """All rows, or None before the first update."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, history: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows_per_file: int = 100_000) -> int:
        """Scan what the ledger lacks and append it; how many blobs were scanned.

        Whether anything is lacking is first asked of the blobs' names alone, so
        texts that are all known aren't moved.
        """
        known = self.read()
        if known is not None:
            keys = F.array(*[F.lit(r.key) for r in rules])
            seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen")).filter(F.size(F.array_except(keys, "seen")) == 0)
            if not history.select(blobs_of(history, text_col).alias("blob")).distinct().join(seen, "blob", "left_anti").limit(1).count():
                return 0
        new = cached(scan(history, known, rules, text_col))
        n = new.count()
        new.coalesce(max(1, -(-n // rows_per_file))).write.mode("append").parquet(self.path)
        new.unpersist()
        return n


def _of_rules(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob and spans (start, kind_no, end) of what these rule versions found; blobs without findings are left out."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    some = ledger.filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    held = F.filter("spans", lambda x: F.array_contains(keys, x["rule"]))
    ordered = F.array_sort(F.transform(held, lambda x: F.struct(x["start"].alias("start"), (F.array_position(keys, x["rule"]) - 1).cast("int").alias("kind_no"), x["end"].alias("end"))))
    # Equal findings of repeated updates stand side by side; array_distinct would compare all with all.
    once = _let(ordered, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))
    return some.select("blob", once.alias("spans")).filter(F.size("spans") > 0)


def findings(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, blob and spans (start, kind_no, end) of every row of history, from a ledger that covers it.

    Narrow rows only: texts don't take part. A blob that a third of all rows
    share makes a skewed key. Adaptive execution splits such a key where both
    sides of the join come straight from a shuffle, so the findings are computed
    first and not aggregated within the join.
    """
    paths = history.select(F.col(quoted(id_col)), blobs_of(history, text_col).alias("blob"))
    found = cached(_of_rules(ledger, rules))
    return paths.join(found, "blob", "left").select(quoted(id_col), "blob", F.coalesce("spans", F.array().cast("array<struct<start:int,kind_no:int,end:int>>")).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of findings(): the base rules' and all spans."""
    no = {r.kind: i for i, r in enumerate(rules)}

    def count_of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind_no"] == no[kind])).cast("long").alias(f"n_{kind}")

    count = [count_of(kind) for kind in BASE]
    base = F.filter("spans", lambda x: x["kind_no"].isin([no[k] for k in BASE]))
    return found.select(id_col, *count, F.sha2(_joined(base, rules).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"))


#: Bytes of findings (32 a blob, 16 a span) that are broadcast; more are joined.
MOST_BROADCAST = 16 << 20


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with its spans (in order, they may overlap) masked."""

    def kept_parts(ends: Column) -> Column:
        """What stands before each span that begins behind all earlier ones: from, to."""
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        pairs = F.filter(F.arrays_zip(spans.alias("0"), before.alias("1")), lambda x: x["0"]["start"] >= x["1"])
        return F.struct(F.transform(pairs, lambda x: F.struct(x["1"].alias("from"), x["0"]["start"].alias("to"))).alias("parts"), F.element_at(ends, -1).alias("tail"))

    def chunk(parts: Column) -> Column:
        first, last = F.element_at(parts, 1)["from"], F.element_at(parts, -1)["to"]
        stretch = F.substring(text, first + 1, last - first)
        return _let(stretch, lambda t: F.array_join(F.transform(parts, lambda x: F.concat(F.substring(t, x["from"] - first + 1, x["to"] - x["from"]), F.lit(mask))), ""))

    def whole(x: Column) -> Column:
        return F.concat(F.array_join(F.transform(_chunks(x["parts"]), chunk), ""), F.substring(text, x["tail"] + 1, F.length(text)))

    ends = _running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    return _let(_let(ends, kept_parts), whole)


def redacted(docs: DataFrame, ledger: Ledger, mask: str = "[secret]", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with every finding in their texts masked; columns and rows as they were (n_chars, if there is one, counts anew).

    The ledger is brought up to date first. Texts without a finding stay as they
    are, null texts stay null. The findings, few beside the texts, are broadcast
    if they are small enough, so that texts aren't moved a second time.
    """
    ledger.update(docs, text_col=text_col)
    found = cached(_of_rules(ledger.read(), RULES))
    size = found.agg(F.coalesce(F.sum(32 + 16 * F.size("spans")), F.lit(0)).alias("bytes")).first()["bytes"]
    left = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__row"), blobs_of(docs, text_col).alias("blob"))
    text = F.col("__row")[text_col]
    hit = F.col("spans").isNotNull() & text.isNotNull()
    rows = left.join(F.broadcast(found) if size <= most_broadcast else found, "blob", "left").withColumn("__new", F.when(hit, _masked(text, F.col("spans"), mask)).otherwise(text))
    changed = {text_col: F.col("__new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("__new")).otherwise(F.col("__row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def duckdb_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """digest() over the table documents, for DuckDB."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    each = []
    for no, r in enumerate(rules):
        p = quoted(r.pattern)
        each.append(f"""
select doc_id, row_id, {no} as kind_no, '{r.kind}' as kind, i, m,
  coalesce(list_sum([length(x) for x in b[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) as s
from (select doc_id, row_id, m, g, b, unnest(generate_series(1, len(m))) as i
      from (select doc_id, row_id, regexp_extract_all(t, {p}, 0) as m, regexp_extract_all(t, {p}, {r.group}) as g, string_split_regex(t, {p}) as b from d))
where length(g[i]) >= {r.least}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)
    return f"""
with d as (select doc_id, row_number() over () as row_id, coalesce(text, '') as t from documents),
f as ({' union all '.join(each)}),
j as (select row_id, kind, kind_no, s, kind || ':' || cast(s as bigint) || ':' || cast(s + length(m[i]) as bigint) as span from f),
a as (select row_id, {counts},
        sha256(coalesce(string_agg(span, ',' order by s, kind_no) filter (kind in ({base})), '')) as base_sha256,
        string_agg(span, ',' order by s, kind_no) as spans
      from j group by row_id)
select d.doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k in BASE)},
  coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (row_id)"""
