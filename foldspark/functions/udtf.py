"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.windows import grid


class WindowGrid:
    """Windows of one transcript: SELECT * FROM window_grid(length, size, offset)."""

    def eval(self, length: int, size: int, offset: int):
        g = grid(length, min(size, length), offset)
        for i in range(g.count):
            start = g.start(i)
            yield i, start, start + g.size


def register(spark: SparkSession) -> None:
    spark.udtf.register("window_grid", udtf(WindowGrid, returnType="window_idx int, start int, stop int"))
