"""Gaussian kernel density of a numeric column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bandwidths a kernel reaches: beyond them it is below 2.1e-16 of its height, the rounding of a double.
REACH = 8.5
KERNEL_CELLS = 1 << 20  # kernel values held at once


def kde(df: DataFrame, column: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Density on ``grid`` points from ``cut`` bandwidths below the data to above it.

    The bandwidth is Scott's, sd · n^(-1/5). Nulls and values that are not finite take no
    part; a column without spread has no density. The moments are one scalar subquery. Inside
    a task equal values of a batch are one, and each adds its kernel to the grid points
    within REACH bandwidths; a task hands over one partial sum per grid point.
    """
    values = df.select(F.col(column).cast("double").alias("x"))
    values = values.filter(F.abs("x") < F.lit(float("inf")))  # also false for nulls and NaN
    bandwidth = F.stddev_samp("x") * F.pow(F.count("x").cast("double"), F.lit(-0.2))
    moments = (
        values.agg(
            F.count("x").alias("n"), bandwidth.alias("h"), F.min("x").alias("lo"), F.max("x").alias("hi")
        )
        .filter(F.col("h") > 0)
        .select(
            F.struct(
                F.col("n").cast("double").alias("n"),
                "h",
                (F.col("lo") - cut * F.col("h")).alias("start"),
                ((F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (grid - 1)).alias("step"),
            )
        )
        .scalar()
    )
    placed = values.withColumn("m", moments).filter(F.col("m").isNotNull()).select("x", "m.*")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n, h, start, step = (batch.column(c)[0].as_py() for c in ("n", "h", "start", "step"))
            if sums is None:
                sums = np.zeros(grid)
            x, times = np.unique(batch.column("x").to_numpy(), return_counts=True)
            width = min(grid, int(2 * REACH * h / step) + 2)
            first = np.clip(np.ceil((x - REACH * h - start) / step), 0, grid - width).astype(int)
            rows = max(1, KERNEL_CELLS // width)
            for at in range(0, len(x), rows):
                i = first[at : at + rows, None] + np.arange(width)
                u = (start + i * step - x[at : at + rows, None]) / h
                kernel = times[at : at + rows, None] * np.exp(-0.5 * u * u)
                sums += np.bincount(i.ravel(), weights=kernel.ravel(), minlength=grid)
        if sums is not None:
            points = np.arange(grid, dtype=np.int32)
            parts = [points, start + points * step, sums / (n * h * np.sqrt(2 * np.pi))]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["i", "x", "part"])

    return (
        placed.mapInArrow(add, "i int, x double, part double")
        .groupBy("i")
        .agg(F.max("x").alias("x"), F.sum("part").alias("density"))
    )
