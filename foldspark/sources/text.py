"""Text sources: read matrices, structure databases, dot-bracket strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str, keep_fragments: bool = True) -> DataFrame:
    """start<TAB>end<TAB>01-string, 1-based and inclusive: read_id (line order within the file), begin, end, idx.

    Without fragments only reads over the whole extent stay.
    """
    rows = spark.read.csv(path, sep="\t", schema="start int, stop int, hits string")
    length = F.length("hits")
    idx = F.filter(F.transform(F.sequence(F.lit(1), length), lambda i: F.when(F.substring("hits", i, F.lit(1)) == "1", F.col("start") + i - 2)), lambda x: x.isNotNull())
    out = rows.select(F.monotonically_increasing_id().alias("read_id"), (F.col("start") - 1).alias("begin"), F.col("stop").alias("end"), F.when(length > 0, idx).otherwise(F.array().cast("array<int>")).alias("idx"))
    if keep_fragments:
        return out
    extent = out.agg(F.min("begin").alias("b"), F.max("end").alias("e")).first()
    return out.filter((F.col("begin") == extent["b"]) & (F.col("end") == extent["e"]))


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a sequence, structure lines of ( ) x . and as many count lines: entry, sequence, profile_idx, profile."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.monotonically_increasing_id().alias("entry"), F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines")).filter(F.size("lines") >= 3)
    structures = F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: x.rlike("^[().x]+$"))
    counts = F.slice("lines", F.size(structures) + 2, F.size("lines"))
    each = blocks.select("entry", F.element_at("lines", 1).alias("sequence"), F.posexplode(F.arrays_zip(structures.alias("structure"), counts.alias("counts"))).alias("profile_idx", "p"))
    profile = F.transform(F.split("p.counts", ","), lambda x: x.cast("int"))
    return each.select("entry", "sequence", "profile_idx", F.col("p.structure").alias("structure"), profile.alias("profile"))


def bad_profiles(structures: DataFrame) -> DataFrame:
    """Rows whose counts aren't positive exactly at unpaired bases."""
    marks = F.transform(F.sequence(F.lit(1), F.length("structure")), lambda i: F.substring("structure", i, F.lit(1)) == ".")
    return structures.filter((F.size("profile") != F.length("structure")) | ~F.coalesce(F.forall(F.zip_with("profile", marks, lambda n, free: (n != 0) == free), lambda ok: ok), F.lit(False)))


def split_numbers(column, separator: str = ","):
    """A list of numbers in a string; what isn't a number is null."""
    return F.transform(F.split(column, f"\\Q{separator}\\E"), lambda x: x.try_cast("int"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON values, one a line, with a schema; lines that aren't JSON (a header) are left out."""
    rows = spark.read.text(path).filter(F.trim("value").rlike(r"^[\[{]"))
    return rows.select(F.from_json("value", schema).alias("x")).select("x.*")


def read_lines(reads: DataFrame) -> DataFrame:
    """Reads as text lines: begin-end, and the mutated bases behind a blank."""
    idx = F.array_join(F.transform("idx", lambda i: i.cast("string")), ",")
    span = F.concat_ws("-", F.col("begin").cast("string"), F.col("end").cast("string"))
    return reads.withColumn("line", F.when(F.size("idx") > 0, F.concat_ws(" ", span, idx)).otherwise(span))
