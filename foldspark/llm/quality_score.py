"""Quality by ridge regression on random Fourier features, calibrated by isotonic regression.

The statistics of each whole text (text_stats.FEATURES) are standardised over
all documents and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel (Rahimi and Recht, 2007). Ridge regression on them
needs only sums over the labelled rows, their normal equations: each task sums
ROWS_A_TASK labelled rows (a few megabytes of statistics), Spark adds those sums
up cell by cell, and the driver solves one system of fixed size. Every labelled row outside the held-out fold
counts: three quarters of them (by a hash of the id) fit the weights, the rest
the calibration, for which the driver gets counts of at most BINS bins.

Inputs of a score are the text's statistics only.

Defined results: null, empty or white text has all statistics 0 and gets a score
like any other; texts of any length are read whole; null labels are no labels; a
document with several labels is good if one says so; repeated rows score alike
(and count as often when they are labelled); rows with a null id are scored and
never learned from; without both classes among the labels the score is the share
of good ones (0.5 without any); extra columns aren't read and may have any name;
an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, in_fold
from .text_stats import FEATURES, with_features

FOLDS, HELD_OUT = 3, 1
BINS = 1024
#: Labelled rows whose normal equations one task sums.
ROWS_A_TASK = 50_000


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    #: Raw scores and their calibrated values, both rising; empty: a constant.
    raw: np.ndarray
    calibrated: np.ndarray
    constant: float = 0.5

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant 1."""
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        cosines = np.cos(z @ self.frequency + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.column_stack([cosines, np.ones(len(x))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.raw):
            return np.full(len(x), self.constant)
        raw = self.expand(x) @ self.weights
        # A thousandth of the score keeps the order within the calibration's flat parts.
        return 0.999 * np.interp(raw, self.raw, self.calibrated) + 0.001 * np.clip((raw + 1) / 3, 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising sequence closest to values."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(FEATURES)) if len(column) else np.zeros((0, len(FEATURES)))


def normal_equations(rows: DataFrame, model: Model, tasks: int) -> np.ndarray:
    """[Z'Z, Z'y] over rows of __x and __y: one partial sum for each of so many tasks, added up cell by cell."""
    size = len(model.phase) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                z = model.expand(_matrix(batch.column(0)))
                total += z.T @ np.column_stack([z, np.asarray(batch.column(1), dtype=float)])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["cell", "sum"])

    summed = rows.select("__x", "__y").coalesce(tasks).mapInArrow(partial, "cell int, sum double").groupBy("cell").agg(F.sum("sum").alias("sum"))
    out = np.zeros(size * (size + 1))
    for r in summed.collect():
        out[r["cell"]] = r["sum"]
    return out.reshape(size, size + 1)


def score_rows(rows: DataFrame, model: Model, keep: list[str], raw: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(keep)))
            score = model.expand(x) @ model.weights if raw else model.predict(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(score, pa.float64())], names=[*keep, "score"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*keep, "__x").mapInArrow(run, ", ".join([*kinds, "score double"]))


def train(features: DataFrame, labels: DataFrame, size: int = 160, width: float = 1.0, ridge: float = 1e-3, seed: int = 11, id_col: str = "doc_id") -> Model:
    """The model from features (id, __x) and labels (id, quality)."""
    d = len(FEATURES)
    cells = [f(F.col("__x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    moments = features.agg(*cells).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    sd = np.array([max(moments[f"s{i}"] or 0.0, 1e-6) for i in range(d)])
    rng = np.random.default_rng(seed)
    frequency = rng.normal(0, 1 / (width * np.sqrt(d)), (d, size))
    model = Model(mean, sd, frequency, rng.uniform(0, 2 * np.pi, size), np.zeros(size + 1), np.zeros(0), np.zeros(0))
    known = labels.select(F.col(id_col).cast("string").alias("__id"), F.col("quality").cast("int").alias("__y")).dropna().filter(~in_fold(F.col("__id"), FOLDS, HELD_OUT))
    known = known.groupBy("__id").agg((F.max("__y") > 0).cast("int").alias("__y"))
    rows = cached(features.select(F.col(id_col).cast("string").alias("__id"), "__x").join(known, "__id").withColumn("__part", F.pmod(F.xxhash64(F.lit("calibrate"), "__id"), F.lit(4))))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("__y"), F.lit(0.5)).alias("share")).first()
    model.constant = float(total["share"])
    if not total["n"] or model.constant in (0.0, 1.0):
        return model
    sums = normal_equations(rows.filter("__part > 0"), model, -(-total["n"] // ROWS_A_TASK))
    gram, n = sums[:, :-1], max(sums[-1, -2], 1.0)
    model.weights = np.linalg.solve(gram + ridge * n / size * np.eye(size + 1), sums[:, -1])
    bins = score_rows(rows.filter("__part = 0"), model, ["__y"], raw=True)
    cut = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.4999), "score")) + 0.5) * (BINS // 2))
    counts = bins.groupBy(cut.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("at"), F.avg("__y").alias("good")).orderBy("bin").collect()
    if counts:
        model.raw = np.array([r["at"] for r in counts])
        model.calibrated = isotonic(np.array([r["good"] for r in counts]), np.array([float(r["n"]) for r in counts]))
    else:
        model.raw, model.calibrated = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row. Texts are read once."""
    features = cached(with_features(docs, [id_col], text_col))
    model = train(features, labels, id_col=id_col)
    scored = score_rows(features, model, [id_col])
    held_out = in_fold(F.col(id_col), FOLDS, HELD_OUT).alias("held_out")
    return scored.select(id_col, held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
