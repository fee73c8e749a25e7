"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import cached, kept, release, settle, shared_dir

__all__ = ["Memo", "SPACES", "WORD", "cached", "compact", "held", "in_fold", "kept", "map_texts", "prepare", "quoted", "release", "shared_dir", "words_of"]

#: White space of the contracts: 0x20 and 0x09-0x0D. bytes.split() splits at exactly these.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(f"[^{SPACES}]+")


class Memo(dict):
    """A dict that computes missing values and holds at most twice ``most`` keys of at most ``longest`` letters or bytes.

    When it is full, its keys become the old generation, from which those that
    are asked for again come back; the older ones go. Longer keys are computed
    each time. The bounds are on memory only: a dropped value is computed again.
    """

    def __init__(self, compute, most: int = 100_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        if isinstance(key, (bytes, str)) and len(key) > self.longest:
            return self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


_held: dict = {}


def held(key: tuple, build):
    """What ``build`` makes, kept for this worker's next tasks.

    Workers outlive stages, so one that keeps the tables and memos of every
    operator it has served grows with each; only the last one's are kept.
    """
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def compact(df: DataFrame, rows_per_file: int = 100_000) -> DataFrame:
    """kept(), in as many files as its rows need: for tables much smaller than what they are made from.

    Also keeps plans short: cached tables inside cached plans are spelled out at every use.
    The driver then lets go of what the plan held.
    """
    spark = df.sparkSession
    once = cached(df)
    path = shared_dir(spark)
    once.coalesce(max(1, -(-once.count() // rows_per_file))).write.parquet(path)
    once.unpersist()
    settle(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch of whole texts; a single text may be longer.
BATCH_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Set up a session for whole texts: Arrow batches of at most BATCH_BYTES, or one row.

    Called once a session, by the registered queries and the pipeline; operators
    change no setting. Narrow rows aren't concerned: 10,000 of them (Spark's own
    bound) are smaller. Without this call Spark's 64 MB hold, and each operator
    still slices what it gets.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("b")) != BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], column: int = -1, most: int = BATCH_BYTES, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut where ``rows`` rows or, in that column's texts, about ``most`` bytes are full."""
    for batch in batches:
        at = 0
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = sizes.cumsum()
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(max(at + 1, int(ends.searchsorted(before + most, "right"))), at + rows)
            yield batch.slice(at, stop - at)
            at = stop


def map_texts(rows: DataFrame, run, schema: str | StructType, column: int = -1) -> DataFrame:
    """rows.mapInArrow(run, schema) over slices whose texts (in that column) are bounded in bytes."""
    return rows.mapInArrow(lambda batches: run(slices(batches, column)), schema)


def quoted(name: str) -> str:
    """A column's name for select and col, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def in_fold(id_column: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, mod folds, equals fold; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))
