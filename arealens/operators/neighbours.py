"""Exact nearest neighbours by Euclidean distance.

Three ways, one result ``(query_id, neighbour_id, rank, distance)``:

* one query row: order by distance and take the first ones;
* few distinct reference vectors (counted first): every task gets them all and searches
  its own query rows, without a shuffle of the queries;
* many: reference vectors are grouped into balls around pivots. A query searches its own
  ball first, which bounds its k-th distance, and then visits exactly the balls that could
  still hold something closer. Large balls are cut into pieces and small ones next to each
  other travel as one lot, so a query is sent once per lot however many balls it visits.
  Lots and their queries are of bounded size.

Equal reference vectors are merged before the search (the smallest ids are kept, as many
as any query can need), so copies of one vector never pile up in a ball. No step emits
candidate pairs: each lot returns at most k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealens.session import cut

SMALL_REFS = 16_384  # distinct reference vectors a task may hold
SPREAD_REFS = 1024  # from here on query rows are spread over all tasks
PIECE_REFS = 8192  # reference vectors per piece of a ball and per lot of balls
PIECE_QUERIES = 8192  # query rows per task that searches a lot
MAX_PIVOTS = 2048  # their distance matrix, shared with every task, takes 32 MB
SLICE_CELLS = 2_000_000  # distance-matrix cells held at once
ROUTE_CELLS = 500_000  # distances to pivots held at once, of which routing has several copies
SENT_CELLS = 2_000_000  # vector components of routed queries handed on at once


def feature_vector(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def as_vectors(df: DataFrame, id_col: str, features: Sequence[str] | str) -> DataFrame:
    """(id, vec) rows; rows with a missing feature have no distance and are left out."""
    known = df.filter(F.col(id_col).isNotNull())
    if isinstance(features, str):
        rows = known.select(F.col(id_col).alias("id"), F.col(features).cast("array<double>").alias("vec"))
        return rows.filter(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    # one plain condition per column: a condition on the array as a whole would make the
    # optimizer try every combination of the columns' definitions
    complete = known.dropna(subset=list(features))
    return complete.select(F.col(id_col).alias("id"), feature_vector(features).alias("vec"))


def distance_to(features: Sequence[str], origin: Column) -> Column:
    """Euclidean distance of plain columns to a constant vector, as one compiled expression."""
    squares = [(F.col(c).cast("double") - origin[i]) * (F.col(c).cast("double") - origin[i]) for i, c in enumerate(features)]
    return F.sqrt(reduce(lambda total, x: total + x, squares))


def distance_between(a: Column, b: Column) -> Column:
    squares = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] - p["b"]) * (p["a"] - p["b"]))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def nearest_to(
    df: DataFrame, id_col: str, features: Sequence[str], target, k: int
) -> DataFrame:
    """The ``k`` rows closest to one row, itself first; a take-ordered plan, no shuffle."""
    rows = df.filter(F.col(id_col).isNotNull()).dropna(subset=list(features))
    rows = rows.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"_f{i}") for i, c in enumerate(features)])
    plain = [f"_f{i}" for i in range(len(features))]
    origin = rows.filter(F.col("id") == F.lit(target)).select(feature_vector(plain).alias("vec")).limit(1).scalar()
    distance = distance_to(plain, F.col("_origin"))
    ranked = (
        rows.withColumn("_origin", origin)
        .select(F.col("id").alias("neighbour_id"), distance.alias("distance"))
        .filter(F.col("distance").isNotNull())
        .orderBy("distance", F.col("neighbour_id") != F.lit(target), "neighbour_id")
        .limit(k)
    )
    order = Window.orderBy("distance", F.col("neighbour_id") != F.lit(target), "neighbour_id")
    # the window sees at most k rows
    return ranked.select(
        F.lit(target).cast(rows.schema["id"].dataType).alias("query_id"),
        "neighbour_id",
        F.row_number().over(order).alias("rank"),
        "distance",
    )


def knn(
    queries: DataFrame,
    id_col: str,
    features: Sequence[str] | str,
    k: int,
    refs: DataFrame | None = None,
    ref_id_col: str | None = None,
    ref_features: Sequence[str] | str | None = None,
    include_self: bool = True,
    strategy: str = "auto",
    probe: int | None = None,
) -> DataFrame:
    """The ``k`` nearest reference rows of every query row, ties broken by id.

    Without ``refs`` a table is matched with itself: the row itself is never counted among
    its ``k`` neighbours, and with ``include_self`` it comes first, at rank 1, so results
    have k + 1 rows. ``strategy`` is "auto", "small" or "balls". ``probe`` limits the
    search to that many closest balls, which is approximate; a query whose balls hold too
    few rows goes on to the next ones, so that it finds as many rows as the exact search.
    """
    is_self = refs is None
    query_rows = as_vectors(queries, id_col, features)
    ref_rows = query_rows if is_self else as_vectors(refs, ref_id_col or id_col, ref_features or features)
    need = k + 1 if is_self else k
    merged = _merge_equal(ref_rows, need)
    result_schema = T.StructType(
        [
            T.StructField("query_id", query_rows.schema["id"].dataType),
            T.StructField("neighbour_id", ref_rows.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    held = merged.limit(SMALL_REFS + 1).collect() if strategy != "balls" else None
    if held is not None and len(held) <= SMALL_REFS:
        best = _search_small(query_rows, held, k, is_self, result_schema)
    elif strategy == "small":
        raise ValueError(f"more than {SMALL_REFS} distinct reference vectors")
    else:
        # both are read several times from here on
        query_rows, merged = cut(query_rows), cut(merged)
        best = _search_balls(query_rows, merged, k, need, is_self, result_schema, probe)
    ranked = best.select(
        "query_id", "neighbour_id", _rank_in_query(best).alias("rank"), "distance"
    ).filter(F.col("rank") <= k)
    if not (is_self and include_self):
        return ranked
    own = query_rows.select(
        F.col("id").alias("query_id"),
        F.col("id").alias("neighbour_id"),
        F.lit(1).alias("rank"),
        F.lit(0.0).alias("distance"),
    )
    return own.unionByName(ranked.withColumn("rank", F.col("rank") + 1))


def _rank_in_query(best: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))


def _merge_equal(rows: DataFrame, need: int) -> DataFrame:
    """One row per distinct vector with its ``need`` smallest ids.

    Only copies beyond the ``need`` smallest ids are dropped, and those can rank in no
    result. The rank limit is applied before the shuffle too.
    """
    position = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.withColumn("_position", position).filter(F.col("_position") <= need)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _top_k(
    query_ids: np.ndarray,
    query_vecs: np.ndarray,
    ref_ids: Sequence[Sequence],
    ref_vecs: np.ndarray,
    k: int,
    drop_self: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the best ``k`` per query row, ordered by (distance, id).

    Both are query x k matrices; a distance is infinite where a query has fewer than k. A
    matrix product preselects with a margin for its rounding; the distances of what is
    left are recomputed directly.
    """
    copies = [len(ids) for ids in ref_ids]
    flat_ids = np.array([rid for ids in ref_ids for rid in ids])
    vecs = np.repeat(ref_vecs, copies, axis=0) if len(ref_vecs) else ref_vecs
    n, width = len(query_vecs), min(k, len(vecs))
    best_ids = np.empty((n, width), dtype=flat_ids.dtype)
    best = np.full((n, width), np.inf)
    if not width:
        return best_ids, best
    id_rank = np.empty(len(flat_ids), dtype=np.int64)
    id_rank[np.argsort(flat_ids, kind="stable")] = np.arange(len(flat_ids))
    # centring keeps the rounding error of the product relative to the spread of the data
    centre = vecs.mean(axis=0)
    refs = vecs - centre
    ref_norms = np.einsum("ij,ij->i", refs, refs)
    want = min(k + 1 if drop_self else k, len(refs))

    def ordered(rows: np.ndarray, chosen: np.ndarray) -> None:
        """Fill the result for these query rows from their chosen reference rows."""
        diff = vecs[chosen] - query_vecs[rows][:, None, :]
        exact = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        if drop_self:
            exact[flat_ids[chosen] == query_ids[rows][:, None]] = np.inf
        order = np.lexsort((id_rank[chosen], exact), axis=-1)[:, :width]
        best[rows] = np.take_along_axis(exact, order, axis=1)
        best_ids[rows] = flat_ids[np.take_along_axis(chosen, order, axis=1)]

    step = max(1, SLICE_CELLS // (len(refs) + 16 * vecs.shape[1]))
    for start in range(0, n, step):
        block = query_vecs[start : start + step] - centre
        norms = np.einsum("ij,ij->i", block, block)
        approx = norms[:, None] + ref_norms[None, :] - 2.0 * (block @ refs.T)
        kth = np.partition(approx, want - 1, axis=1)[:, want - 1]
        near = approx <= (kth + 1e-9 * (norms + ref_norms.max()) + 1e-300)[:, None]
        taken = min(want + 8, len(refs))
        few = near.sum(axis=1) <= taken
        rows = np.flatnonzero(few)
        if len(rows):
            part = approx[rows]
            chosen = (
                np.argpartition(part, taken - 1, axis=1)[:, :taken]
                if taken < len(refs)
                else np.tile(np.arange(len(refs)), (len(rows), 1))
            )
            ordered(start + rows, chosen)
        # many near-equal distances: take all of them
        for row in np.flatnonzero(~few):
            ordered(np.array([start + row]), np.flatnonzero(near[row])[None, :])
    return best_ids, best


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width or 0))
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _search_small(
    query_rows: DataFrame, held: list, k: int, drop_self: bool, schema: T.StructType
) -> DataFrame:
    """Search a reference set whose size was checked, held by every task."""
    spark = query_rows.sparkSession
    shared = spark.sparkContext.broadcast(
        ([list(r["ids"]) for r in held], np.array([r["vec"] for r in held], dtype=float))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref_ids, ref_vecs = shared.value
        for batch in batches:
            ids = batch["id"].to_numpy()
            found, away = _top_k(ids, _matrix(batch["vec"]), ref_ids, ref_vecs, k, drop_self)
            kept = np.isfinite(away)
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(ids, kept.sum(axis=1)),
                    "neighbour_id": found[kept],
                    "distance": away[kept],
                }
            )

    if not held:
        return spark.createDataFrame([], schema)
    if len(held) > SPREAD_REFS:
        # the search of a row then costs far more than moving it
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        query_rows = query_rows.repartition(tasks, "id")
    return query_rows.mapInPandas(search, schema)


def _search_balls(
    query_rows: DataFrame,
    merged: DataFrame,
    k: int,
    need: int,
    drop_self: bool,
    schema: T.StructType,
    probe: int | None,
) -> DataFrame:
    spark = query_rows.sparkSession
    n = merged.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    n_pivots = max(1, min(MAX_PIVOTS, math.isqrt(n)))
    # pivots follow the density of the data, so dense regions get more and smaller balls
    drawn = merged.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(n_pivots).collect()
    pivots = np.array([r["vec"] for r in drawn], dtype=float)
    centre = pivots.mean(axis=0)
    gaps = _distances(pivots - centre, pivots - centre)
    pivots_shared = spark.sparkContext.broadcast((pivots - centre, centre, gaps))

    def to_pivots(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all pivots, and how far off rounding may put each row's."""
        points, middle, _ = pivots_shared.value
        moved = vecs - middle
        reach = np.sqrt(np.einsum("ij,ij->i", points, points).max())
        return _distances(moved, points), 1e-6 * (np.linalg.norm(moved, axis=1) + reach)

    rows_at_once = max(1, ROUTE_CELLS // n_pivots)

    @F.pandas_udf("struct<ball: int, away: double>")
    def assign(vecs: pd.Series) -> pd.DataFrame:
        ball, away = np.zeros(len(vecs), dtype=np.int32), np.zeros(len(vecs))
        for start in range(0, len(vecs), rows_at_once):
            part = slice(start, start + rows_at_once)
            distances, _ = to_pivots(_matrix(vecs.iloc[part]))
            ball[part], away[part] = distances.argmin(axis=1), distances.min(axis=1)
        return pd.DataFrame({"ball": ball, "away": away})

    balls = cut(
        merged.withColumn("_a", assign("vec")).select(
            "vec", "ids", F.col("_a.ball").alias("ball"), F.col("_a.away").alias("away")
        )
    )
    # per ball: size, radii, and the few members nearest the pivot (at most pivots x need)
    summary = balls.groupBy("ball").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.size("ids")).alias("held"), F.min("away").alias("inner"), F.max("away").alias("outer")
    ).collect()
    member = F.row_number().over(Window.partitionBy("ball").orderBy("away"))
    closest = (
        balls.select("ball", "away", member.alias("_m")).filter(F.col("_m") <= need).collect()
    )
    size, held = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots), dtype=np.int64)
    inner, outer = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in summary:
        size[r["ball"]], held[r["ball"]] = r["size"], r["held"]
        inner[r["ball"]], outer[r["ball"]] = r["inner"], r["outer"]
    nearest_members = np.full((len(pivots), need), np.inf)
    for r in closest:
        nearest_members[r["ball"], r["_m"] - 1] = r["away"]
    pieces = np.maximum(1, -(-size // PIECE_REFS))
    lot = _lots(size, pieces, gaps)
    units = np.cumsum(pieces) - pieces  # number of a ball's first piece
    geometry = spark.sparkContext.broadcast((inner, outer, nearest_members, pieces, held, units, lot))

    def place_of(ball: Column, piece: Column | None = None) -> list[Column]:
        """Lot and unit (piece of a ball) by ball and piece."""
        def listed(numbers: np.ndarray) -> Column:
            return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")  # a constant of the plan

        unit = F.get(listed(units), ball) + (F.lit(0) if piece is None else piece)
        return [F.get(listed(lot), unit).alias("lot"), unit.alias("unit")]

    large = [F.lit(int(x)) for b in np.flatnonzero(pieces > 1) for x in (b, pieces[b])]
    piece_count = F.coalesce(F.try_element_at(F.create_map(*large), F.col("ball")), F.lit(1)) if large else F.lit(1)
    piece = F.pmod(F.xxhash64("vec"), piece_count).cast("int")
    lots = balls.select(*place_of(F.col("ball"), piece), "vec", "ids")

    id_type = schema["query_id"].dataType.simpleString()
    ref_type = schema["neighbour_id"].dataType.simpleString()

    # first visit: one piece of the query's own ball, enough for a bound on the k-th distance
    homes = cut(query_rows.withColumn("ball", assign("vec")["ball"]))
    own = place_of(F.col("ball"))
    homes = homes.select("id", "vec", "ball", own[0], F.array(own[1]).alias("units"), F.lit(math.inf).alias("bound"))
    loads = homes.groupBy("lot").agg(F.count(F.lit(1)).alias("n"))
    first_schema = f"id {id_type}, vec array<double>, ball int, kth double"
    first = cut(_visit(homes, loads, lots, k, drop_self, first_schema, keep_query=True))

    def wanted(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(balls to visit, as a mask by row; bounds of the k-th distance)."""
        inner, outer, nearest_members, pieces, held, _, _ = geometry.value
        gaps = pivots_shared.value[2]
        away, slack = to_pivots(_matrix(part["vec"]))
        home = part["ball"].to_numpy()
        allowed = np.isfinite(outer)[None, :].repeat(len(part), axis=0)
        if probe is not None:
            # balls by distance: the first ones, and more until they hold enough
            order = np.argsort(np.where(allowed, away, np.inf), axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            early = (np.arange(len(outer)) < probe)[None, :] | (before < need)
            np.put_along_axis(allowed, order, early & np.take_along_axis(allowed, order, axis=1), axis=1)
        bound = part["kth"].to_numpy().copy()
        # where the first piece held too few, any `need` known members give a bound
        for i in np.flatnonzero(np.isinf(bound)):
            through = (away[i][:, None] + nearest_members)[allowed[i]].ravel()
            if len(through) < need:
                continue
            bound[i] = np.partition(through, need - 1)[need - 1] + slack[i]
        own = away[np.arange(len(part)), home]
        least = np.maximum(away - outer[None, :], inner[None, :] - away)
        gap = gaps[home]
        # members of another ball lie beyond the bisector of the two pivots; rounding
        # of the distances weighs more the closer the pivots are
        beyond = (away**2 - own[:, None] ** 2) / 2 - slack[:, None] * (away + own[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            bisector = beyond / (gap + slack[:, None])
        least = np.maximum(least, np.where(gap > 0, bisector, -np.inf))
        return (least <= (bound + slack)[:, None]) & allowed, bound

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(query rows, their bounds, rows and units of the visits, ordered by row and lot)."""
        _, outer, _, pieces, _, units, lot = geometry.value
        for batch in batches:
            for start in range(0, len(batch), rows_at_once):
                part = batch.iloc[start : start + rows_at_once]
                visit, bound = wanted(part)
                home = part["ball"].to_numpy()
                rows = np.arange(len(part))
                visit[rows, home] |= np.isfinite(outer[home])  # its first visit only gave the bound
                q, b = np.nonzero(visit)
                times = pieces[b]
                q, unit = np.repeat(q, times), np.repeat(units[b], times)
                unit = unit + np.arange(len(unit)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((lot[unit], q))
                yield part, bound, q[order], unit[order]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lot = geometry.value[-1]
        counts = np.zeros(int(lot.max()) + 1, dtype=np.int64)
        for _, _, q, unit in visits(batches):
            counts += np.bincount(lot[unit][_starts(q, lot[unit])], minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pd.DataFrame({"lot": found.astype(np.int32), "n": counts[found]})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lot = geometry.value[-1]
        for part, bound, q, unit in visits(batches):
            ids, vecs = part["id"].to_numpy(), part["vec"].to_numpy()
            starts = np.flatnonzero(_starts(q, lot[unit]))
            step = max(1, SENT_CELLS // max(1, len(vecs[0])))
            for s in range(0, len(starts), step):
                at = starts[s : s + step]
                end = starts[s + step] if s + step < len(starts) else len(q)
                yield pd.DataFrame(
                    {
                        "id": ids[q[at]],
                        "vec": vecs[q[at]],
                        "lot": lot[unit[at]].astype(np.int32),
                        "units": np.split(unit[at[0] : end].astype(np.int32), at[1:] - at[0]),
                        "bound": bound[q[at]],
                    }
                )

    routed = first.mapInPandas(route, f"id {id_type}, vec array<double>, lot int, units array<int>, bound double")
    loads = first.mapInPandas(tally, "lot int, n long").groupBy("lot").agg(F.sum("n").alias("n"))
    later_schema = f"id {id_type}, found array<{ref_type}>, distances array<double>"
    later = _visit(routed, loads, lots, k, drop_self, later_schema, whole=probe is None)
    return later.select(
        F.col("id").alias("query_id"), F.explode(F.arrays_zip("found", "distances")).alias("_f")
    ).select(
        "query_id", F.col("_f.found").alias("neighbour_id"), F.col("_f.distances").alias("distance")
    )


def _starts(q: np.ndarray, lot: np.ndarray) -> np.ndarray:
    """Where a run of equal (query, lot) begins."""
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (lot[1:] != lot[:-1])
    return new


def _lots(size: np.ndarray, pieces: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Lot of every unit: small balls near each other share one, a piece of a large ball has its own."""
    units = np.cumsum(pieces) - pieces
    lot = np.full(int(pieces.sum()), -1)
    n_lots = 0
    for ball in np.flatnonzero(pieces > 1):
        lot[units[ball] : units[ball] + pieces[ball]] = n_lots + np.arange(pieces[ball])
        n_lots += pieces[ball]
    for ball in np.flatnonzero(pieces == 1):
        if lot[units[ball]] >= 0:
            continue
        near = np.argsort(gaps[ball], kind="stable")
        near = near[(pieces[near] == 1) & (near != ball)]
        near = np.r_[ball, near[lot[units[near]] < 0]]
        filled = np.cumsum(size[near])
        lot[units[near[(filled <= PIECE_REFS) | (near == ball)]]] = n_lots
        n_lots += 1
    return lot


def _visit(
    routed: DataFrame,
    loads: DataFrame,
    lots: DataFrame,
    k: int,
    drop_self: bool,
    schema: str,
    keep_query: bool = False,
    whole: bool = False,
) -> DataFrame:
    """Search each routed query in its units of a lot; crowded lots are copied to several tasks.

    ``loads`` has the number of queries of every lot, one row per lot, that is about distinct
    reference vectors / PIECE_REFS rows. With ``whole`` a lot may be searched as one where its
    queries want most of it.
    """
    load = loads.select("lot", F.ceil(F.col("n") / F.lit(PIECE_QUERIES)).cast("int").alias("copies"))
    spread_queries = routed.join(load, "lot").withColumn(
        "copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")
    )
    spread_refs = (
        lots.join(load, "lot")
        .withColumn("r_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select(F.col("lot").alias("r_lot"), "r_copy", "unit", F.col("vec").alias("r_vec"), "ids")
    )

    def search(query_part: pd.DataFrame, ref_part: pd.DataFrame) -> pd.DataFrame:
        ids = query_part["id"].to_numpy()
        n = len(ids)
        if not n:
            return pd.DataFrame({part.split()[0]: [] for part in schema.split(", ")}, dtype=object)
        width = len(query_part["vec"].iloc[0])
        vecs = _matrix(query_part["vec"], width)
        names, codes, own = _coded(ref_part["ids"].tolist(), ids)
        ref_vecs, ref_units = _matrix(ref_part["r_vec"], width), ref_part["unit"].to_numpy()
        q = np.repeat(np.arange(n), [len(u) for u in query_part["units"]])
        unit = np.concatenate(query_part["units"].tolist())
        present, sizes = np.unique(ref_units, return_counts=True)
        asked = dict(zip(*np.unique(unit, return_counts=True)))
        cells = sum(int(asked.get(u, 0)) * int(s) for u, s in zip(present, sizes))
        best_codes, best = np.full((n, k), -1), np.full((n, k), np.inf)
        if whole and 2 * cells >= n * len(ref_vecs):
            searches = [(np.arange(n), np.arange(len(ref_vecs)))]
        else:
            searches = ((q[unit == u], np.flatnonzero(ref_units == u)) for u in present if u in asked)
        for rows, refs in searches:
            found, away = _top_k(own[rows], vecs[rows], [codes[r] for r in refs], ref_vecs[refs], k, drop_self)
            # the best k of those found so far and these
            both_codes = np.concatenate([best_codes[rows], found], axis=1)
            both = np.concatenate([best[rows], away], axis=1)
            order = np.lexsort((both_codes, both), axis=-1)[:, :k]
            best_codes[rows] = np.take_along_axis(both_codes, order, axis=1)
            best[rows] = np.take_along_axis(both, order, axis=1)
        if keep_query:
            return pd.DataFrame({"id": ids, "vec": query_part["vec"], "ball": query_part["ball"], "kth": best[:, k - 1]})
        limit = query_part["bound"].to_numpy() * (1 + 1e-9) + 1e-12
        close = np.isfinite(best) & (best <= limit[:, None])
        hit = np.flatnonzero(close.any(axis=1))
        found = pd.Series([names[best_codes[i][close[i]]] for i in hit], dtype=object)
        distances = pd.Series([best[i][close[i]] for i in hit], dtype=object)
        return pd.DataFrame({"id": ids[hit], "found": found, "distances": distances})

    return (
        spread_queries.groupBy("lot", "copy")
        .cogroup(spread_refs.groupBy("r_lot", "r_copy"))
        .applyInPandas(search, schema)
    )


def _coded(ref_ids: list, query_ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(ids in order, numbers of the reference ids in it, numbers of the query ids; -1 for others)."""
    if not ref_ids:
        return np.zeros(0, int), [], np.full(len(query_ids), -1)
    names, numbers = np.unique(np.concatenate(ref_ids), return_inverse=True)
    at = np.searchsorted(names, query_ids).clip(max=len(names) - 1)
    own = np.where(names[at] == query_ids, at, -1)
    return names, np.split(numbers, np.cumsum([len(x) for x in ref_ids])[:-1]), own


def neighbour_recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact neighbours, self left out, that another search returned."""
    truth = exact.filter(F.col("query_id") != F.col("neighbour_id")).select("query_id", "neighbour_id")
    hit = found.select("query_id", "neighbour_id", F.lit(1).alias("hit"))
    joined = truth.join(hit, ["query_id", "neighbour_id"], "left")
    return joined.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("pairs"))


def pca_scores(
    df: DataFrame, id_col: str, features: Sequence[str], components: int
) -> tuple[DataFrame, list[float]]:
    """Scores on the first components of standardised features, and the variance ratios.

    The fit sums a features x features matrix over the partitions. Signs of components are
    arbitrary; distances are not affected.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(
        df.dropna(subset=list(features))
    )
    model = PCA(k=components, inputCol="_features", outputCol="_scores").fit(assembled)
    scores = model.transform(assembled).select(
        F.col(id_col), vector_to_array("_scores").alias("scores")
    )
    return scores, model.explainedVariance.toArray().tolist()


def pca_is_useful(features: Sequence[str]) -> bool:
    """A reduced space is only offered from four features on."""
    return len(features) >= 4


def neighbour_report(
    neighbours: DataFrame, raw: DataFrame, scaled: DataFrame, id_col: str, columns: Sequence[str]
) -> DataFrame:
    """Raw and normalised values of each query's neighbours, side by side, with distances."""
    raw_part = raw.select(F.col(id_col).alias("neighbour_id"), *columns)
    scaled_part = scaled.select(
        F.col(id_col).alias("neighbour_id"), *[F.col(c).alias(f"{c}_norm") for c in columns]
    )
    return neighbours.join(raw_part, "neighbour_id").join(scaled_part, "neighbour_id")


def neighbour_sentence(
    neighbours: DataFrame, names: DataFrame, id_col: str, name_col: str, on_noise: bool = False
) -> DataFrame:
    """One sentence per query naming its neighbours in rank order.

    The collected list holds the k neighbours of one query. With three or more of them the
    last name is joined by "and". A match on noise is said to be one.
    """
    label = names.select(F.col(id_col).alias("neighbour_id"), F.col(name_col).alias("_name"))
    listed = (
        neighbours.join(label, "neighbour_id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "_name"))).alias("_ranked"))
    )
    all_names = F.transform("_ranked", lambda r: r["_name"])
    others = F.slice(all_names, 2, F.size(all_names))
    n = F.size(others)
    text = F.when(
        n > 2,
        F.concat(
            F.array_join(F.slice(others, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(others, -1)
        ),
    ).otherwise(F.array_join(others, ", "))
    end = F.lit(". But we are fitting on noise!" if on_noise else ".")
    return listed.select(
        "query_id",
        F.concat(
            F.lit("The "), n.cast("string"), F.lit(" neighbours for "), all_names[0], F.lit(" are: "), text, end
        ).alias("sentence"),
    )
