"""Exact top-k by inner product: ball trees per shard, searched by branch and bound.

Vectors become whole numbers, floor(1024 * x), so scores are exact. The rows are
taken as shards of at most ``shard_rows`` vectors in the partitions they are read
in; each shard's ball tree is built once and written, a row a shard, to the
shared folder. Queries are numbered, written and dealt to groups of about
``block``; they never come to the driver.

Within a shard, a query visits nodes in the order of their upper bounds
q.c + |q| r and stops at the first bound below its current kth score. That score
is shared: it starts from the kth best of a pilot sample (at most about ``pilot``
rows, exact scores, hence a true lower bound), which executors search first for
every query; the root balls of all shards are compared with it, so that groups of
queries meet only shards that can reach it; and each shard carries the scores of
the shards before it in its task on to the next. Shards return only scores that
reach the shared one; the best k of them by query are the answer. On data without
clusters the bounds prune little, and the search is a blocked scan: every group of
queries is sent every shard.

The driver holds the pilot sample and, if there are at most MOST_ROOTS shards,
their root balls; with more shards, groups of queries meet all of them.

Defined results: vectors that are null, empty, or hold null or non-finite
components, and rows with an id that is null or no whole number, take no part; a
vector is compared only with those of its length; a query never meets rows with
its own id; repeated rows are candidates each, and queries each; ties go to the
smaller id; a score beyond 64 bits is held at their ends; extra columns aren't
read and may have any name; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, quoted

SCALE = 1024.0
EXACT = float(1 << 53)
LEAF = 256
#: Shards whose root balls (a vector each) the driver may hold.
MOST_ROOTS = 20_000
#: Shards that one task searches at most, one after another.
IN_TASK = 16


def usable(id_col: str, vector_col: str) -> Column:
    v = F.col(quoted(vector_col))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(quoted(id_col)).try_cast("long").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite


def whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * rows.astype(np.float64))


class BallTree:
    """Nodes as arrays; node i covers order[start[i]:end[i]] and has children left[i] and right[i], or none."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        centres, radii, spans, children, todo = [], [], [], [], [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            at = len(centres)
            if parent is not None:
                children[parent].append(at)
            rows = vectors[order[a:b]]
            centre = rows.mean(axis=0)
            distance = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(float(distance.max()))
            spans.append((a, b))
            children.append([])
            if b - a > leaf and distance.max() > 0:
                far = rows[distance.argmax()]
                other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                half = (b - a) // 2
                split = np.argpartition(rows @ (other - far), half)
                order[a:b] = order[a:b][split]
                todo += [(a, a + half, at), (a + half, b, at)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres, self.radii, self.spans, self.children = np.array(centres), np.array(radii), spans, children
        self.largest = float(np.abs(vectors).max())

    def packed(self) -> tuple[bytes, ...]:
        """ids, vectors, centres, radii, and spans with children (-1: none) as bytes."""
        nodes = np.array([(*span, *(c or (-1, -1))) for span, c in zip(self.spans, self.children, strict=True)], np.int32)
        return tuple(np.ascontiguousarray(x).tobytes() for x in (self.ids.astype(np.int64), self.vectors, self.centres, self.radii, nodes))

    @classmethod
    def unpacked(cls, d: int, ids: bytes, vectors: bytes, centres: bytes, radii: bytes, nodes: bytes) -> BallTree:
        tree = cls.__new__(cls)
        tree.ids, tree.radii = np.frombuffer(ids, np.int64), np.frombuffer(radii, np.float64)
        tree.vectors, tree.centres = (np.frombuffer(x, np.float64).reshape(-1, d) for x in (vectors, centres))
        each = np.frombuffer(nodes, np.int32).reshape(-1, 4).tolist()
        tree.spans, tree.children = [(a, b) for a, b, _, _ in each], [[x, y] if x >= 0 else [] for _, _, x, y in each]
        tree.largest = float(np.abs(tree.vectors).max())
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with each node's vectors, rounding included."""
        size = np.sqrt((queries**2).sum(axis=1))[:, None]
        reach = np.sqrt((self.centres**2).sum(axis=1))[None] + self.radii[None]
        return queries @ self.centres.T + size * self.radii[None] + 1e-9 * size * reach + 1e-6

    def scores(self, a: int, b: int, query: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(query).max()) * len(query) < EXACT:
            return (self.vectors[a:b] @ query).astype(np.int64)
        exact = self.vectors[a:b].astype(object)
        q = [int(x) for x in query]
        return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * y for x, y in zip(row, q)))) for row in exact], dtype=np.int64)

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, best: Best) -> None:
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < best.least:
                return
            if self.children[node]:
                for c in self.children[node]:
                    if bounds[c] >= best.least:
                        heapq.heappush(heap, (-bounds[c], c))
            else:
                a, b = self.spans[node]
                best.add(own, self.ids[a:b], self.scores(a, b, query))


class Best:
    """A query's best k so far; least: what a score must reach to count."""

    __slots__ = ("ids", "k", "least", "scores")

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, own: int, ids: np.ndarray, scores: np.ndarray) -> None:
        take = (scores >= self.least) & (ids != own)
        if not take.any():
            return
        ids, scores = np.concatenate([self.ids, ids[take]]), np.concatenate([self.scores, scores[take]])
        if len(ids) > self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[order], scores[order]
        self.ids, self.scores = ids, scores
        if len(ids) == self.k:
            self.least = max(self.least, float(scores.min()))


def _by_length(batches: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, lists = table.column(0).combine_chunks().to_numpy(zero_copy_only=False), table.column(1).combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], sizes.cumsum()])[:-1]
    return {int(d): (ids[sizes == d], whole(flat[starts[sizes == d][:, None] + np.arange(d)])) for d in np.unique(sizes)}


def _shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if n and n + part.num_rows > rows:
                yield _by_length(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield _by_length(held)


SHARD = "shard long, d int, ids binary, vectors binary, centres binary, radii binary, nodes binary"


def _trees(data: DataFrame, shard_rows: int) -> DataFrame:
    """A row for each shard, with its ball tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for shard in _shards(batches, shard_rows):
            for d, (ids, vectors) in shard.items():
                row = [number, d, *BallTree(ids, vectors).packed()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["shard", "d", "ids", "vectors", "centres", "radii", "nodes"])
                number += 1

    return data.mapInArrow(run, SHARD)


def _started(asked: DataFrame, trees: dict[int, tuple], k: int) -> DataFrame:
    """The queries with least, the kth best score in the pilot's trees (minus infinity without k rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = {d: BallTree.unpacked(d, *x) for d, x in trees.items()}
        for batch in batches:
            least = []
            for own, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best, q = Best(k, -np.inf), whole(np.array(v))
                if tree := built.get(len(v)):
                    tree.search(own, q, tree.bounds(q[None])[0], best)
                least.append(best.least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64())], names=["query_id", "v", "least"])

    return asked.mapInArrow(run, "query_id long, v array<double>, least double")


def _met(asked: DataFrame, roots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """part and shard: which shards can hold a score that a query of a group lacks, by the shards' root balls (numbers, centres, radii by length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            part, least, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.array([len(x) for x in lists])
            for d in np.unique(sizes):
                if d in roots:
                    at = np.flatnonzero(sizes == d)
                    q = whole(np.array([lists[i].as_py() for i in at]))
                    numbers, centres, radii = roots[d]
                    ball = BallTree.__new__(BallTree)
                    ball.centres, ball.radii = centres, radii
                    i, j = np.nonzero(ball.bounds(q) >= least[at][:, None])
                    seen.update(zip(part[at[i]].tolist(), numbers[j].tolist(), strict=True))
        pairs = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int32()), pa.array([s for _, s in pairs], pa.int64())], names=["part", "shard"])

    return asked.select("part", "least", "v").mapInArrow(run, "part int, shard long").distinct()


def _search(shards: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """What one task's shards hold for one group of queries."""
    n, own, least = (asked.column(c).to_numpy() for c in ("n", "query_id", "least"))
    vectors = [whole(np.asarray(x)) for x in asked.column("v").combine_chunks().to_numpy(zero_copy_only=False)]
    best, lengths = [Best(k, x) for x in least], {}
    for i, v in enumerate(vectors):
        lengths.setdefault(len(v), []).append(i)
    for row in range(shards.num_rows):
        d, *parts = (shards.column(c)[row].as_py() for c in ("d", "ids", "vectors", "centres", "radii", "nodes"))
        tree, mine = BallTree.unpacked(d, *parts), lengths.get(d, [])
        for at in range(0, len(mine), 512):
            some = mine[at : at + 512]
            for i, b in zip(some, tree.bounds(np.array([vectors[i] for i in some])), strict=True):
                tree.search(int(own[i]), vectors[i], b, best[i])
    counts = [len(b.ids) for b in best]
    ids, scores = (np.concatenate([getattr(b, x) for b in best] or [np.zeros(0, np.int64)]) for x in ("ids", "scores"))
    return pa.table({"n": np.repeat(n, counts), "query_id": np.repeat(own, counts), "vec_id": ids, "score": scores})


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192, pilot: int = 4096, shard_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query row."""

    def clean(df: DataFrame, name: str) -> DataFrame:
        return df.filter(usable(id_col, vector_col)).select(F.col(quoted(id_col)).try_cast("long").alias(name), F.col(quoted(vector_col)).cast("array<double>").alias("v"))

    data = clean(rows, "vec_id")
    shards = kept(_trees(data, shard_rows))
    # A shard's rows from the size of its ids: the vectors aren't read for it.
    counts = shards.agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0)).alias("rows")).first()
    share = F.pmod(F.xxhash64(F.lit("pilot"), "vec_id"), F.lit(1 << 30)) < int(min(1.0, pilot / max(counts["rows"], 1)) * (1 << 30))
    seed, trees = data.filter(share).limit(2 * pilot).collect(), {}
    for d in {len(r["v"]) for r in seed}:
        own = [r for r in seed if len(r["v"]) == d]
        trees[d] = BallTree(np.array([r["vec_id"] for r in own]), whole(np.array([r["v"] for r in own]))).packed()
    started = kept(_started(clean(queries, "query_id"), trees, k).withColumn("n", F.monotonically_increasing_id()))
    parts = max(1, -(-started.count() // block))
    asked = started.withColumn("part", F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int"))
    tasks = max(-(-counts["shards"] // IN_TASK), min(counts["shards"], 2 * rows.sparkSession.sparkContext.defaultParallelism), 1)
    if counts["shards"] <= MOST_ROOTS:
        roots: dict[int, list] = {}
        for r in shards.select("shard", "d", F.expr("substring(centres, 1, 8 * d)").alias("centre"), F.substring("radii", 1, 8).alias("radius")).collect():
            roots.setdefault(r["d"], []).append((r["shard"], np.frombuffer(r["centre"], np.float64), np.frombuffer(r["radius"], np.float64)[0]))
        met = kept(_met(asked, {d: tuple(np.array(x) for x in zip(*each, strict=True)) for d, each in roots.items()}))
    else:
        met = shards.select("shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = met.withColumn("task", F.pmod(F.xxhash64("shard"), F.lit(tasks)).cast("int"))
    held = met.join(shards, "shard").drop("shard")
    sent = asked.join(met.select("part", "task").distinct(), "part").select("part", "task", "n", "query_id", "v", "least")
    # Columns of their own, as both sides of the cogroup come from one table.
    sent = sent.select(*[F.col(c).alias(f"__{c}") for c in sent.columns]).toDF(*sent.columns)
    found = held.groupBy("part", "task").cogroup(sent.groupBy("part", "task")).applyInArrow(lambda a, b: _search(a, b, k), "n long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def duckdb_sql(every: int = 100, k: int = 10) -> str:
    """top_k() of the table embeddings, queries with ids divisible by ``every``, for DuckDB."""
    return f"""
with v as (select vec_id, [floor(1024 * cast(x as double)) for x in embedding] as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
      from v q join v c on q.vec_id % {every} = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= {k}"""
