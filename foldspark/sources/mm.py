"""Binary mutation maps: a Spark data source and sink, and their codec.

Little-endian. A transcript: u16 length of the id with its NUL, the id, NUL, u32
bases, the bases as nibbles (high one first; A C G T N are 0 to 4), u32 reads,
then reads: u32 begin, u32 end (inclusive), u32 k, k sorted u32 indices. A file
ends in ``[mmeof]``. An index file beside it, named with a further ``i``, holds
u16 length, id, NUL, u64 offset for each transcript.

Reading: with an index, a file is split into one partition a transcript range;
without, transcripts are found one after another in one partition a file. Only
headers are read for the transcripts table. Filters on transcript_id are pushed
down: reads of other transcripts aren't decoded. Paths are opened through
pyarrow's file systems, so they may be local or remote.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ..schemas import READS, TRANSCRIPTS

# Fixed values of the format.
TRAILER = b"[mmeof]"
BASES = "ACGTN"


def pack_bases(sequence: str) -> bytes:
    try:
        codes = np.array([BASES.index(c) for c in sequence.upper()], dtype=np.uint8)
    except ValueError:
        raise ValueError("a sequence may hold A, C, G, T and N only") from None
    codes = np.append(codes, np.zeros(len(codes) % 2, np.uint8))
    return (codes[0::2] << 4 | codes[1::2]).tobytes()


def unpack_bases(data: bytes, n: int) -> str:
    pairs = np.frombuffer(data, np.uint8)
    codes = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n]
    if (codes >= len(BASES)).any():
        raise ValueError("unknown base code")
    return "".join(BASES[c] for c in codes)


def encode_header(transcript_id: str, sequence: str, n_reads: int) -> bytes:
    name = transcript_id.encode() + b"\0"
    return struct.pack("<H", len(name)) + name + struct.pack("<I", len(sequence)) + pack_bases(sequence) + struct.pack("<I", n_reads)


def encode_read(begin: int, end: int, idx) -> bytes:
    return struct.pack(f"<{3 + len(idx)}I", begin, end - 1, len(idx), *sorted(idx))


def encode_index(entries: list[tuple[str, int]]) -> bytes:
    out = b""
    for name, offset in entries:
        raw = name.encode() + b"\0"
        out += struct.pack("<H", len(raw)) + raw + struct.pack("<Q", offset)
    return out


@dataclass
class Header:
    transcript_id: str
    sequence: str
    n_reads: int


def read_header(f) -> Header:
    size = struct.unpack("<H", f.read(2))[0]
    name = f.read(size)[:-1].decode()
    n = struct.unpack("<I", f.read(4))[0]
    sequence = unpack_bases(f.read((n + 1) // 2), n)
    return Header(name, sequence, struct.unpack("<I", f.read(4))[0])


def read_batches(f, n: int, size: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """begin, end, counts and indices (flat) of n reads, a few megabytes of file at a time.

    Only the walk from read to read is a loop; the rest is array work.
    """
    rest = b""
    while n:
        more = f.read(size)
        if not more:
            raise ValueError("the file ends within a transcript")
        data = rest + more
        words = np.frombuffer(data, "<u4", len(data) // 4)
        listed, starts, at, last = words.tolist(), [], 0, len(words)
        while n and at + 3 <= last and at + 3 + listed[at + 2] <= last:
            starts.append(at)
            at += 3 + listed[at + 2]
            n -= 1
        first = np.array(starts, dtype=np.int64)
        inner = np.ones(at, dtype=bool)
        for k in range(3):
            inner[first + k] = False
        yield words[first].astype(np.int32), words[first + 1].astype(np.int32) + 1, words[first + 2].astype(np.int32), words[:at][inner].astype(np.int32)
        rest = data[4 * at :]
    f.seek(f.tell() - len(rest))


def encode_reads(begin: np.ndarray, end: np.ndarray, counts: np.ndarray, indices: np.ndarray) -> bytes:
    """Reads with sorted indices (flat), as they stand in a file."""
    sizes = counts + 3
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype="<u4")
    inner = np.ones(len(out), dtype=bool)
    for k, values in enumerate((begin, end - 1, counts)):
        out[first + k] = values
        inner[first + k] = False
    out[inner] = indices
    return out.tobytes()


def skip_reads(f, n: int, size: int = 1 << 22) -> None:
    """Behind n reads, where no index says where that is: a few megabytes at a time, without taking them apart."""
    rest = b""
    while n:
        more = f.read(size)
        if not more:
            raise ValueError("the file ends within a transcript")
        data = rest + more
        listed, at, last = np.frombuffer(data, "<u4", len(data) // 4).tolist(), 0, len(data) // 4
        while n and at + 3 <= last and at + 3 + listed[at + 2] <= last:
            at += 3 + listed[at + 2]
            n -= 1
        rest = data[4 * at :]
    f.seek(f.tell() - len(rest))


def opened(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, inner


def check_trailer(fs, path: str) -> int:
    """The size of what comes before the trailer; an error where that is missing."""
    size = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        if size is None or size < len(TRAILER):
            raise ValueError(f"{path}: no end marker")
        f.seek(size - len(TRAILER))
        if f.read(len(TRAILER)) != TRAILER:
            raise ValueError(f"{path}: no end marker")
    return size - len(TRAILER)


def read_index(fs, path: str) -> list[tuple[str, int]]:
    if not path.endswith(".mm") or fs.get_file_info(path + "i").type != pafs.FileType.File:
        return []
    with fs.open_input_file(path + "i") as f:
        data, out, at = f.read(), [], 0
    while at < len(data):
        size = struct.unpack_from("<H", data, at)[0]
        out.append((data[at + 2 : at + 1 + size].decode(), struct.unpack_from("<Q", data, at + 2 + size)[0]))
        at += 10 + size
    return out


@dataclass
class Part(InputPartition):
    path: str
    replicate: int
    #: Byte range whose transcripts this partition reads, and the number of the first.
    start: int
    stop: int
    ordinal: int
    #: Where its transcripts begin, and where the last one ends, if there is an index.
    offsets: tuple[int, ...] = ()


class MmReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.headers_only = options.get("table", "reads") == "transcripts"
        self.per_part = int(options.get("transcriptsperpartition", "64"))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("transcript_id",):
                self.wanted = values if self.wanted is None else self.wanted & values
            yield f  # Spark checks every row again

    def partitions(self):
        out = []
        for replicate, path in enumerate(self.paths):
            fs, inner = opened(path)
            stop, index = check_trailer(fs, inner), read_index(fs, inner)
            if not index:
                out.append(Part(path, replicate, 0, stop, 0))
                continue
            offsets = [o for _, o in index] + [stop]
            for i in range(0, len(index), self.per_part):
                if self.wanted is None or any(n in self.wanted for n, _ in index[i : i + self.per_part]):
                    some = tuple(offsets[i : i + self.per_part + 1])
                    out.append(Part(path, replicate, some[0], some[-1], i, some))
        return out or [Part("", 0, 0, 0, 0)]

    def read(self, part: Part):
        if not part.path:
            return
        fs, inner = opened(part.path)
        with fs.open_input_file(inner) as f:
            f.seek(part.start)
            ordinal = part.ordinal

            def skip(h: Header) -> None:
                if part.offsets:
                    f.seek(part.offsets[ordinal - part.ordinal + 1])
                else:
                    skip_reads(f, h.n_reads)

            while f.tell() < part.stop:
                h = read_header(f)
                wanted = self.wanted is None or h.transcript_id in self.wanted
                if self.headers_only:
                    if wanted:
                        columns = [pa.array([part.replicate], pa.int32()), pa.array([ordinal], pa.int32()), pa.array([h.transcript_id]), pa.array([h.sequence]), pa.array([h.n_reads], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["replicate", "ordinal", "transcript_id", "sequence", "n_reads"])
                    skip(h)
                elif wanted:
                    done = 0
                    for begin, end, counts, indices in read_batches(f, h.n_reads):
                        r = len(begin)
                        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                        columns = [pa.array(np.full(r, part.replicate, np.int32)), pa.array([h.transcript_id] * r, pa.string()), pa.array(np.arange(done, done + r)), pa.array(begin), pa.array(end), pa.ListArray.from_arrays(pa.array(offsets), pa.array(indices))]
                        yield pa.RecordBatch.from_arrays(columns, names=["replicate", "transcript_id", "read_id", "begin", "end", "idx"])
                        done += r
                else:
                    skip(h)
                ordinal += 1


@dataclass
class Written(WriterCommitMessage):
    path: str


class MmWriter(DataSourceArrowWriter):
    """Rows of transcript_id, sequence, n_reads, begin, end, sorted idx, by transcript; one file a partition.

    A transcript's first row is its head: sequence and n_reads, without begin. Its
    reads follow, without sequence and n_reads. Files bear the number of the job;
    what failed attempts of its tasks left is deleted when it ends.
    """

    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex[:12]

    def write(self, batches):
        from pyspark import TaskContext

        fs, base = opened(self.path)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        path = f"{base}/part-{self.job}-{context.partitionId():05d}-{context.taskAttemptId()}.mm"
        index, current, left = [], None, 0
        with fs.open_output_stream(path) as f:
            for batch in batches:
                ids, heads, totals = (batch.column(c).to_pylist() for c in ("transcript_id", "sequence", "n_reads"))
                has = np.asarray(batch.column("begin").is_valid())
                begin, end = (batch.column(c).fill_null(0).to_numpy() for c in ("begin", "end"))
                lists = batch.column("idx")
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                flat, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(counts)])
                at = 0
                while at < len(ids):
                    if not has[at]:
                        if left:
                            raise ValueError(f"{current}: fewer reads than its header says")
                        index.append((ids[at], f.tell()))
                        f.write(encode_header(ids[at], heads[at], totals[at]))
                        current, left = ids[at], totals[at]
                        at += 1
                        continue
                    stop = at
                    while stop < len(ids) and has[stop] and ids[stop] == ids[at]:
                        stop += 1
                    if ids[at] != current:
                        raise ValueError(f"{ids[at]}: reads without a head")
                    f.write(encode_reads(begin[at:stop], end[at:stop], counts[at:stop], flat[offsets[at] : offsets[stop]]))
                    left -= stop - at
                    at = stop
            if left:
                raise ValueError(f"{current}: fewer reads than its header says")
            f.write(TRAILER)
        with fs.open_output_stream(path + "i") as f:
            f.write(encode_index(index))
        if not index:
            fs.delete_file(path)
            fs.delete_file(path + "i")
        return Written(path if index else "")

    def _clear(self, but: set[str]) -> None:
        fs, base = opened(self.path)
        for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.job}-") and f.base_name.removesuffix("i") not in but:
                fs.delete_file(f.path)

    def commit(self, messages):
        self._clear({m.path.rsplit("/", 1)[1] for m in messages if m and m.path})

    def abort(self, messages):
        self._clear(set())


class MmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mm"

    def schema(self) -> str:
        return TRANSCRIPTS if self.options.get("table", "reads") == "transcripts" else READS

    def reader(self, schema) -> MmReader:
        return MmReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> MmWriter:
        return MmWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MmSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_mm(spark: SparkSession, paths: list[str], whitelist: str | None = None) -> tuple[DataFrame, DataFrame]:
    """transcripts and reads; each path is a replicate, in order."""
    register(spark)
    source = spark.read.format("mm").option("path", ",".join(paths))
    transcripts, reads = source.option("table", "transcripts").load(), source.option("table", "reads").load()
    if whitelist is not None:
        from ..operators.filters import whitelist_filter

        ids = read_whitelist(spark, whitelist)
        transcripts, reads = whitelist_filter(transcripts, ids), whitelist_filter(reads, ids)
    return transcripts, reads


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("id")).filter("id != ''")


def write_mm(reads: DataFrame, transcripts: DataFrame, path: str, partitions: int | None = None) -> None:
    """One replicate as files of whole transcripts, as many as the session's shuffles have partitions. n_reads is counted from the reads.

    The format keeps a transcript in one file, so a hot one is one task's; its
    reads are sorted on disk and written as they come, and only heads hold sequences.
    """
    spark = reads.sparkSession
    register(spark)
    counts = reads.groupBy("transcript_id").agg(F.count(F.lit(1)).cast("long").alias("n_reads"))
    heads = transcripts.select("transcript_id", "sequence").distinct().join(counts, "transcript_id", "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0).cast("long")))
    each = reads.select("transcript_id", "read_id", "begin", "end", F.array_sort("idx").alias("idx")).join(transcripts.select("transcript_id"), "transcript_id", "left_semi")
    rows = heads.unionByName(each, allowMissingColumns=True).withColumn("__read", F.col("begin").isNotNull())
    sorted_ = rows.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "transcript_id").sortWithinPartitions("transcript_id", "__read", "read_id")
    sorted_.select("transcript_id", "sequence", "n_reads", "begin", "end", "idx").write.format("mm").option("path", path).mode("append").save()


def write_file(path: str, entries: list[tuple[str, str, list[tuple[int, int, list[int]]]]], index: bool = True) -> None:
    """A small file from Python values: (id, sequence, reads)."""
    offsets = []
    with open(path, "wb") as f:
        for name, sequence, reads in entries:
            offsets.append((name, f.tell()))
            f.write(encode_header(name, sequence, len(reads)))
            for begin, end, idx in reads:
                f.write(encode_read(begin, end, idx))
        f.write(TRAILER)
    if index:
        with open(path + "i", "wb") as f:
            f.write(encode_index(offsets))
