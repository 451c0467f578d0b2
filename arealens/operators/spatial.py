"""Nearest facility and polygon measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import knn
from .relational import first_per_key, join_on

CHUNK_VERTICES = 4096


def nearest_facility(
    points: DataFrame,
    point_id: str,
    point_xy: Sequence[str],
    facilities: DataFrame,
    facility_id: str,
    facility_xy: Sequence[str],
    carry: Sequence[str] = (),
) -> DataFrame:
    """The closest facility of every point by planar distance, ties to the smaller id.

    Facilities without coordinates never win. The search is the exact one of
    ``neighbours.knn`` with k = 1: few facilities are held by every task, many are
    searched by balls, so the product of points and facilities is never formed.
    """
    found = knn(
        points, point_id, list(point_xy), 1, facilities, facility_id, list(facility_xy)
    ).select(
        F.col("query_id").alias(point_id),
        F.col("neighbour_id").alias(facility_id),
        "distance",
    )
    if not carry:
        return found
    payload = first_per_key(facilities.select(facility_id, *carry), [facility_id], list(carry))
    return join_on(found, payload, facility_id)


def polygon_measures(
    vertices: DataFrame,
    unit: str,
    ring: str = "ring",
    seq: str = "seq",
    x: str = "x",
    y: str = "y",
    unit_scale: float = 1.0,
    chunk: int = CHUNK_VERTICES,
) -> DataFrame:
    """Area and centroid per unit from its rings' vertices (shoelace sums).

    Rings close themselves. Holes run in the opposite direction to their outer ring. The
    area is in squared coordinate units divided by ``unit_scale`` (1e6 for m² to km²).

    Edges are formed inside chunks of ``chunk`` sequence numbers, so a ring of any length
    is spread over tasks; only the ends of the chunks are linked ring by ring.
    """
    points = vertices.dropna(subset=[x, y]).select(
        F.col(unit).alias("unit"),
        F.col(ring).alias("ring"),
        F.col(seq).alias("seq"),
        F.floor(F.col(seq) / F.lit(chunk)).alias("chunk"),
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    )
    in_chunk = Window.partitionBy("unit", "ring", "chunk").orderBy("seq")
    rows = points.withColumns(
        {
            "next_x": F.lead("x").over(in_chunk),
            "next_y": F.lead("y").over(in_chunk),
            "head": F.lag("seq").over(in_chunk).isNull(),
        }
    )
    tail = F.col("next_x").isNull()
    moments = ("cross", "mx", "my")

    def edge_sums() -> list[Column]:
        cross = F.col("x") * F.col("next_y") - F.col("next_x") * F.col("y")
        along = [(F.col(c) + F.col(f"next_{c}")) * cross for c in ("x", "y")]
        return [F.coalesce(m, F.lit(0.0)).alias(name) for name, m in zip(moments, [cross, *along])]

    # a chunk is its first and last vertex and the sums over its edges, in the partitioning
    # the window left
    chunks = (
        rows.select("*", *edge_sums())
        .groupBy("unit", "ring", "chunk")
        .agg(
            *[F.max(F.when(F.col("head"), F.col(c))).alias(f"first_{c}") for c in ("x", "y")],
            *[F.max(F.when(tail, F.col(c))).alias(c) for c in ("x", "y")],
            *[F.sum(m).alias(f"inner_{m}") for m in moments],
        )
    )
    in_ring = Window.partitionBy("unit", "ring").orderBy("chunk")
    linked = chunks.withColumns(
        {
            f"next_{c}": F.coalesce(
                F.lead(f"first_{c}").over(in_ring), F.first(f"first_{c}").over(in_ring)
            )
            for c in ("x", "y")
        }
    )
    total = (
        linked.select("unit", *[f"inner_{m}" for m in moments], *edge_sums())
        .groupBy("unit")
        .agg(*[F.sum(F.col(m) + F.col(f"inner_{m}")).alias(m) for m in moments])
    )

    def centre(moment: str) -> Column:
        return F.col(moment) / F.nullif(F.lit(3.0) * F.col("cross"), F.lit(0.0))

    return total.select(
        F.col("unit").alias(unit),
        (F.abs(F.col("cross")) / 2 / F.lit(float(unit_scale))).alias("area"),
        centre("mx").alias("centroid_x"),
        centre("my").alias("centroid_y"),
    )
