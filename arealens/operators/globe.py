"""Nearest facility on the globe, through a tree of cells.

Places become points of the unit sphere in three dimensions, where neither poles nor the
antimeridian are special. Facilities are kept in cubic cells that are divided while they hold
more than a few; every point then descends from the coarse cells to the fine ones and drops, at each
step, the cells that cannot hold its nearest facility. Cells near the point settle near
questions; points far from any facility are settled by coarse cells alone, so the search widens
by itself. All steps are equi-joins on the cell, whose rows per point stay few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealens.functions import haversine_km
from arealens.session import cut

from .relational import first_per_key

#: Distinct places from which a cell is divided, and halvings of an axis a step makes.
CELL_PLACES, STEP = 32, 2
#: Halvings of an axis at most: cells of about a centimetre.
DEEPEST = 30
#: Slack of squared chord lengths, far above the rounding of their parts.
SLACK = 1e-12
AXES = ("x", "y", "z")
POINT = (*AXES, "_plat", "_plong")


def _on_sphere(df: DataFrame, lat: str, long: str) -> DataFrame:
    """Adds unit-sphere coordinates; rows without a valid place are left out."""
    phi, theta = F.radians(F.col(lat).cast("double")), F.radians(F.col(long).cast("double"))
    placed = df.where(F.col(lat).isNotNull() & F.col(long).isNotNull() & F.col(lat).between(-90, 90) & ~F.isnan(F.col(long).cast("double")))
    return placed.withColumns({"x": F.cos(phi) * F.cos(theta), "y": F.cos(phi) * F.sin(theta), "z": F.sin(phi)})


def _cell(level: int) -> Column:
    """Name of the cell of a point when every axis is halved ``level`` times."""
    side = 1 << level
    index = [F.least(F.floor((F.col(a) + 1) / 2 * side), F.lit(side - 1)).cast("string") for a in AXES]
    return F.concat_ws(":", F.lit(str(level)), *index)


def cell_tree(places: DataFrame, most: int = CELL_PLACES) -> tuple[DataFrame, DataFrame]:
    """(cells, leaves): (cell, parent, leaf, bounds) of every cell, and (cell, place) of the leaves.

    ``places`` are distinct (x, y, z). A cell with more than ``most`` of them is divided, so
    crowded places get small cells and a leaf never holds more, save in a spot of a centimetre.
    Bounds are those of the places inside.
    """
    bounds = [f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    level, parent, open_ = 0, F.lit(None).cast("string"), places
    cells, leaves = [], []
    while True:
        rows = open_.withColumns({"parent": parent, "cell": _cell(level)})
        found = rows.groupBy("cell").agg(F.max("parent").alias("parent"), F.count(F.lit(1)).alias("n"), *bounds)
        found = cut(found.withColumn("leaf", (F.col("n") <= most) | F.lit(level >= DEEPEST)).drop("n"))
        cells.append(found)
        marked = _joined(rows, found.select("cell", "leaf"), ["cell"])
        leaves.append(marked.where("leaf").select("cell", *AXES))
        if found.where(~F.col("leaf")).isEmpty():
            break
        open_ = cut(marked.where(~F.col("leaf")).select(*AXES, F.col("cell").alias("_up")))
        level, parent = min(DEEPEST, level + STEP), F.col("_up")
    return _union(cells), _union(leaves)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _bounds_to_cell(cell: Column) -> tuple[Column, Column]:
    """Least and greatest squared chord from a point to the places inside a cell's bounds."""
    near, far = F.lit(0.0), F.lit(0.0)
    for a in AXES:
        lo, hi, at = cell[f"{a}_lo"], cell[f"{a}_hi"], F.col(a)
        out = F.greatest(lo - at, at - hi, F.lit(0.0))
        span = F.greatest(F.abs(at - lo), F.abs(hi - at))
        near, far = near + out * out, far + span * span
    return near, far


def _measured(cell: Column) -> Column:
    near, far = _bounds_to_cell(cell)
    return F.struct(cell["cell"].alias("cell"), cell["leaf"].alias("leaf"), near.alias("near"), far.alias("far"))


def _closer_children(rows: DataFrame, children: Column) -> DataFrame:
    """One row per child, of at most 64 in ``children``, that may hold the point's nearest facility.

    Within the row the children are held against each other before any of them is shuffled.
    """
    rows = rows.withColumn("_m", F.transform(children, _measured))
    rows = rows.withColumn("_best", F.array_min(F.transform("_m", lambda m: m["far"])))
    near = F.filter("_m", lambda m: m["near"] <= F.col("_best") + SLACK)
    return rows.select(*POINT, F.explode(near).alias("_c")).select(*POINT, "_c.*")


def _closer(frontier: DataFrame) -> DataFrame:
    """Cells that may hold a point's nearest facility: no other cell surely holds a closer one."""
    best = F.min("far").over(Window.partitionBy(*AXES))  # few cells per point
    return frontier.withColumn("_best", best).where(F.col("near") <= F.col("_best") + SLACK).drop("_best")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join of tables that both grow with the input, by a shuffle of both.

    Spark sizes points and cells by the columns of the files behind them, which is far too small once
    coordinates and names have been derived; it would pass them through the driver to broadcast them.
    """
    return left.join(right.hint("merge"), list(keys))


def nearest_on_globe(
    points: DataFrame,
    point_id: str,
    point_at: Sequence[str],
    facilities: DataFrame,
    facility_id: str,
    facility_at: Sequence[str],
    carry: Sequence[str] = (),
    most: int = CELL_PLACES,
) -> DataFrame:
    """(point_id, facility_id, distance_km, *carry): the closest facility of every point by great circle.

    ``point_at`` and ``facility_at`` name latitude and longitude in degrees; longitudes may run over
    the antimeridian or beyond 180. Distances are haversine ones; ties go to the smaller id. Rows
    without an id or a valid place take no part, and points have no row when there is no facility.
    Points that share an id each get a row per place. The result is exact; nothing is compared
    with all facilities.
    """
    lat, long = facility_at
    known = _on_sphere(facilities.where(F.col(facility_id).isNotNull()).select(F.col(facility_id).alias("_facility"), F.col(lat).alias("_lat"), F.col(long).alias("_long")), "_lat", "_long")
    # facilities at one place are one, the smallest id: it wins every tie among them
    known = cut(known.groupBy(*AXES).agg(F.min(F.struct("_facility", "_lat", "_long")).alias("_f")))
    cells, leaves = cell_tree(known.select(*AXES), most)
    cells = cut(cells)
    held = _joined(leaves, known, AXES).select("cell", "_f")

    asked = points.where(F.col(point_id).isNotNull())
    asked = _on_sphere(asked.select(F.col(point_id).alias("_id"), F.col(point_at[0]).alias("_plat"), F.col(point_at[1]).alias("_plong")), "_plat", "_plong")
    # points at one place share their way down
    places = asked.groupBy(*AXES).agg(F.first("_plat").alias("_plat"), F.first("_plong").alias("_plong"))

    box = [f"{a}_{n}" for a in AXES for n in ("lo", "hi")]
    child = F.struct("cell", "leaf", *box)
    below = cells.where("parent is not null").groupBy(F.col("parent").alias("cell")).agg(F.collect_list(child).alias("_children"))
    root = cells.where("parent is null").select("cell", "leaf").first()
    frontier = places.select(*POINT, F.lit(root["cell"] if root else None).cast("string").alias("cell"), F.lit(True).alias("leaf"))
    if root and not root["leaf"]:
        # the root is every point's first cell: its children, 64 at most, are an array in the plan, not a join on one key
        few = cells.where(F.col("parent") == root["cell"]).select("cell", "leaf", *box).collect()
        first = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("cell", "leaf", *box)]) for r in few])
        frontier = cut(_closer_children(places, first))
    while not frontier.where(~F.col("leaf")).isEmpty():
        inner = _closer_children(_joined(frontier.where(~F.col("leaf")).select(*POINT, "cell"), below, ["cell"]), F.col("_children"))
        frontier = cut(_closer(inner.unionByName(frontier.where("leaf"))))
    found = _joined(frontier.select(*POINT, "cell"), held, ["cell"])
    away = haversine_km("_plat", "_plong", "_f._lat", "_f._long")
    found = found.withColumn("distance_km", away).groupBy(*AXES).agg(F.min(F.struct("distance_km", "_f._facility")).alias("_n"))
    found = _joined(asked.select("_id", *AXES), found, AXES)
    found = found.select(F.col("_id").alias(point_id), F.col("_n._facility").alias(facility_id), "_n.distance_km")
    if not carry:
        return found
    payload = first_per_key(facilities.select(facility_id, *carry), [facility_id], list(carry))
    return _joined(found, payload, [facility_id])
