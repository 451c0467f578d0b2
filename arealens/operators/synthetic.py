"""Synthetic controls: donor pools, non-negative elastic-net weights, trajectories.

The weights of one target minimise

    1/(2n) |y - X w|² + a r |w|₁ + a (1 - r)/2 |w|²,   w >= 0, no intercept,

over n feature rows, with (a, r) chosen by contiguous cross-validation (Zou and Hastie
2005; Friedman, Hastie and Tibshirani 2010).

A donor pool whose size was checked is shared with all tasks, and targets are fitted in
parallel, one row each. A pool beyond that stays distributed: targets are fitted in parallel on
the donors a screening leaves, and every fit is checked against the whole pool until none is
wanted that was left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealens.session import cut
from arealens.sources import fixed

from .allocation import share_of_total
from .neighbours import knn, nearest_to

MAX_DONOR_CELLS = 4_000_000  # donors x features a task may hold, 32 MB
STEPS = 10_000  # active-set steps per fit
TOLERANCE = 1e-9  # of the optimality conditions, relative to the largest |x'y|/n
POOL_PIECE = 8192  # donors of a distributed pool in a task
TARGETS_AT_ONCE, FIT_CELLS = 512, 8_000_000  # targets that meet them there; residuals of all their fits, 64 MB
SURVIVORS, ADDED_DONORS = 256, 64  # donors a target starts with, and takes in per pass

WEIGHT_SCHEMA = (
    "target {id}, donor {id}, weight double, alpha double, l1_ratio double, "
    "cv_mse double, kkt double, capped boolean"
)


def donor_pool(
    units: DataFrame, unit: str, lat: str, long: str, target, exclude: int
) -> DataFrame:
    """All units but the target and its ``exclude`` geographically nearest ones."""
    near = nearest_to(units, unit, [lat, long], target, exclude + 1)
    return units.join(
        near.select(F.col("neighbour_id").alias(unit)), unit, "left_anti"
    )


def exclusions(
    units: DataFrame, unit: str, lat: str, long: str, exclude: int, targets: DataFrame | None = None
) -> DataFrame:
    """(target, excluded) for every unit, or the listed ones: itself and its ``exclude`` nearest ones.

    With ``targets`` only their own neighbourhoods are searched. A unit is nearest to itself;
    where units share a place it may not be among the first, so it is always listed.
    """
    if targets is None:
        found = knn(units, unit, [lat, long], exclude)
        return found.select(F.col("query_id").alias("target"), F.col("neighbour_id").alias("excluded"))
    asked = units.join(targets.select(F.col("unit").alias(unit)).distinct(), unit, "left_semi")
    near = knn(asked, unit, [lat, long], exclude + 1, refs=units)
    near = near.select(F.col("query_id").alias("target"), F.col("neighbour_id").alias("excluded"), "rank")
    near = near.filter(F.col("excluded") != F.col("target"))
    order = Window.partitionBy("target").orderBy("rank")  # exclude + 1 rows at most
    others = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= exclude).select("target", "excluded")
    own = asked.select(F.col(unit).alias("target"), F.col(unit).alias("excluded"))
    return own.unionByName(others)


def unit_vectors(
    features: DataFrame, unit: str, order: Sequence[str], value: str, n_features: int | None = None
) -> DataFrame:
    """(unit, vec): the features of each unit as one array, in the given order.

    The features are all that occur in the table. A unit that misses one is left out, as no
    distance to it is defined (``target_status`` tells which): cells of one position always
    belong to the same feature. ``n_features`` states the number of features instead.
    """
    known = features.dropna(subset=[value])
    packed = known.dropDuplicates([unit, *order]).groupBy(unit).agg(
        F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))).alias("_p")
    )
    vectors = packed.select(F.col(unit).alias("unit"), F.transform("_p", lambda p: p["_v"]).alias("vec"))
    if n_features is None:
        n_features = known.select(*order).distinct().count()
    return vectors.filter(F.size("vec") == n_features)


def fit_weights(
    vectors: DataFrame,
    targets: DataFrame,
    excluded: DataFrame | None = None,
    l1_ratios: Sequence[float] = fixed.L1_RATIOS,
    n_alphas: int = fixed.N_ALPHAS,
    folds: int = fixed.N_FOLDS,
    strategy: str = "auto",
) -> DataFrame:
    """Positive donor weights of each target, with the chosen penalty and diagnostics.

    ``targets`` holds the wanted units in a column ``unit``; ``excluded`` lists
    (target, excluded) pairs, and a target is never its own donor. ``kkt`` is the largest
    violation of the optimality conditions, measured, relative to the largest |x'y|/n, and ``capped``
    tells whether a fit stopped at the step limit.

    ``strategy`` is "shared" (every task holds the donor matrix), "distributed", or "auto",
    which shares a pool only after checking its size.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["unit"].dataType.simpleString()
    schema = WEIGHT_SCHEMA.format(id=id_type)
    width = vectors.select(F.size("vec").alias("n")).first()
    if width is None:
        return spark.createDataFrame([], schema)
    wanted = targets.select("unit").distinct().join(vectors, "unit")
    if excluded is not None:
        listed = excluded.groupBy(F.col("target").alias("unit")).agg(
            F.collect_set("excluded").alias("excluded")
        )
        wanted = wanted.join(listed, "unit", "left")
    else:
        wanted = wanted.withColumn("excluded", F.array().cast(f"array<{id_type}>"))
    grid = tuple(l1_ratios)
    bound = max(1, MAX_DONOR_CELLS // max(1, width["n"]))
    held = vectors.limit(bound + 1).collect() if strategy != "distributed" else None
    if held is not None and len(held) <= bound:
        return _fit_shared(held, wanted, grid, n_alphas, folds, schema)
    if strategy == "shared":
        raise ValueError(f"more than {bound} donors of {width['n']} features")
    return _fit_distributed(cut(vectors), wanted, grid, n_alphas, folds, schema)


def target_status(targets: DataFrame, vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per wanted target: what came of it, and how exact its fit is.

    ``status`` is "fitted", "features missing" (no complete vector), or "no weight" (all weights
    are zero, or no donor is left).
    """
    fits = weights.groupBy("target").agg(
        F.count(F.lit(1)).alias("donors"), F.max("kkt").alias("kkt"), F.max("capped").alias("capped")
    )
    known = vectors.select(F.col("unit").alias("target"), F.lit(True).alias("_known")).distinct()
    rows = targets.select(F.col("unit").alias("target")).distinct().join(known, "target", "left").join(fits, "target", "left")
    status = F.when(F.col("donors") > 0, "fitted").when(F.col("_known"), "no weight").otherwise("features missing")
    return rows.select("target", status.alias("status"), F.coalesce("donors", F.lit(0)).alias("donors"), "kkt", "capped")


def _fit_shared(
    held: list, wanted: DataFrame, grid: tuple, n_alphas: int, folds: int, schema: str
) -> DataFrame:
    spark = wanted.sparkSession
    held = sorted(held, key=lambda r: r["unit"])
    shared = spark.sparkContext.broadcast(
        ([r["unit"] for r in held], np.array([r["vec"] for r in held], dtype=float))
    )
    # a fit takes seconds, so targets are spread over all cores
    tasks = max(1, min(wanted.count(), 4 * spark.sparkContext.defaultParallelism))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, donors = shared.value
        for batch in batches:
            for unit, vec, out in zip(batch["unit"], batch["vec"], batch["excluded"]):
                barred = {unit, *(out if out is not None else ())}
                keep = [i for i, name in enumerate(names) if name not in barred]
                if not keep:
                    continue
                found = cross_validated_weights(
                    donors[keep].T, np.asarray(vec, dtype=float), grid, n_alphas, folds
                )
                positive = np.flatnonzero(found["weights"] > 0)
                if not len(positive):
                    continue
                yield pd.DataFrame(
                    {
                        "target": [unit] * len(positive),
                        "donor": [names[keep[i]] for i in positive],
                        "weight": found["weights"][positive],
                        "alpha": found["alpha"],
                        "l1_ratio": found["l1_ratio"],
                        "cv_mse": found["cv_mse"],
                        "kkt": found["kkt"],
                        "capped": found["capped"],
                    }
                )

    return wanted.repartition(tasks).mapInPandas(fit, schema)


def _fit_distributed(
    donors: DataFrame, wanted: DataFrame, grid: tuple, n_alphas: int, folds: int, schema: str
) -> DataFrame:
    """Fits against pools of any size: survivors of a screening, fitted in tasks, checked on the whole pool.

    A first pass over the donors gives every target its most promising ones. Each target's whole grid is
    then fitted in one task on those, and a pass over all donors looks, for every fit of the
    grid and every fold, for donors whose gradient would let them in. A fit that no donor wants
    to enter is the fit on the whole pool: the optimality conditions hold for all of it. Donors
    that want to enter join the target's survivors, and only those targets are fitted again.
    """
    id_type = donors.schema["unit"].dataType.simpleString()
    pair = f"target {id_type}, unit {id_type}, vec array<double>, score double"
    wanted = cut(wanted.select("unit", "vec", "excluded"))
    n = donors.select(F.size("vec").alias("n")).first()["n"]
    at_once = max(1, FIT_CELLS // (n * (len(grid) * n_alphas * max(1, min(folds, n)) + 1)))
    held = max(SURVIVORS, 2 * n)
    promising = _against_pool(donors, wanted, TARGETS_AT_ONCE, _promising(held), pair)
    survivors = cut(_first_by_score(promising, held).select("target", "unit", "vec"))
    open_, fits = wanted, None
    while True:
        found = cut(_fitted_on_survivors(open_, survivors, grid, n_alphas, folds, id_type))
        settled = found if fits is None else fits.join(found.select("target"), "target", "left_anti").unionByName(found)
        settled = cut(settled)
        asked = found.join(wanted.select(F.col("unit").alias("target"), "excluded"), "target")
        known = survivors.groupBy("target").agg(F.collect_set("unit").alias("known"))  # bounded by what fits took in
        asked = asked.join(known, "target").select(
            F.col("target").alias("unit"), "residuals", "levels", "tolerance", F.array_union(F.coalesce("excluded", F.array().cast(f"array<{id_type}>")), "known").alias("excluded")
        )
        entering = _against_pool(donors, asked, at_once, _entering(ADDED_DONORS), pair)
        entering = cut(_first_by_score(entering, ADDED_DONORS).select("target", "unit", "vec"))
        fits = settled
        if entering.isEmpty():
            break
        survivors = cut(survivors.unionByName(entering))
        open_ = wanted.join(entering.select(F.col("target").alias("unit")).distinct(), "unit", "left_semi")
    kept = fits.select("target", F.explode("donors").alias("d"), "alpha", "l1_ratio", "cv_mse", "kkt", "capped")
    named = kept.select("target", F.col("d.donor").alias("donor"), F.col("d.weight").alias("weight"), "alpha", "l1_ratio", "cv_mse", "kkt", "capped")
    return named


def _first_by_score(pairs: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "unit"))
    return pairs.withColumn("_place", place).filter(F.col("_place") <= most)


def _against_pool(donors: DataFrame, asked: DataFrame, at_once: int, compare: Callable, schema: str) -> DataFrame:
    """Blocks of ``asked`` rows against all donors, piece by piece, in tasks of bounded size."""
    n_donors, n_asked = donors.count(), asked.count()
    pieces, blocks = max(1, -(-n_donors // POOL_PIECE)), max(1, -(-n_asked // at_once))
    deal = lambda n: F.pmod(F.xxhash64("unit"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = donors.select(deal(pieces).alias("piece"), every(blocks).alias("block"), "unit", "vec")
    right = asked.select(every(pieces).alias("piece"), deal(blocks).alias("block"), *asked.columns)
    return left.groupBy("piece", "block").cogroup(right.groupBy("piece", "block")).applyInPandas(compare, schema)


def _allowed(units: pd.Series, unit, excluded) -> np.ndarray:
    barred = {unit, *(excluded if excluded is not None else ())}
    return ~units.isin(barred).to_numpy()


def _promising(most: int) -> Callable:
    """Tasks: the piece's donors that pull hardest on each target, and the one of largest |x'y|."""

    def run(pool: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        x = np.stack(pool["vec"].tolist()) if len(pool) else np.zeros((0, 0))
        for unit, vec, excluded in zip(asked["unit"], asked["vec"], asked["excluded"]) if len(pool) else ():
            pull = x @ np.asarray(vec, dtype=float)
            free = np.flatnonzero(_allowed(pool["unit"], unit, excluded))
            if not len(free):
                continue
            best = free[np.argsort(-pull[free], kind="stable")[:most]]
            score = pull[best]
            # the largest |x'y| sets the penalties' path, whatever its sign; it comes first
            top = free[np.abs(pull[free]).argmax()]
            best, score = np.append(best[best != top], top), np.append(score[best != top], np.abs(pull[top]) + np.abs(score).max())
            out.append(pd.DataFrame({"target": unit, "unit": pool["unit"].to_numpy()[best], "vec": pool["vec"].to_numpy()[best], "score": score}))
        return pd.concat(out) if out else pd.DataFrame(columns=["target", "unit", "vec", "score"], dtype=object)

    return run


def _entering(most: int) -> Callable:
    """Tasks: the piece's donors whose gradient lets them into some fit of a target's grid."""

    def run(pool: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        x = np.stack(pool["vec"].tolist()) if len(pool) else np.zeros((0, 0))
        for unit, raw, levels, tolerance, excluded in (
            zip(asked["unit"], asked["residuals"], asked["levels"], asked["tolerance"], asked["excluded"]) if len(pool) else ()
        ):
            slack = np.frombuffer(levels) + tolerance
            residuals = np.frombuffer(raw).reshape(len(slack), -1)
            over = np.full(len(x), -np.inf)
            for start in range(0, len(slack), 512):
                over = np.maximum(over, (x @ residuals[start : start + 512].T - slack[start : start + 512]).max(axis=1))
            over[~_allowed(pool["unit"], unit, excluded)] = -np.inf
            best = np.argsort(-over, kind="stable")[:most]
            best = best[over[best] > 0]
            out.append(pd.DataFrame({"target": unit, "unit": pool["unit"].to_numpy()[best], "vec": pool["vec"].to_numpy()[best], "score": over[best]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["target", "unit", "vec", "score"], dtype=object)

    return run


def _fitted_on_survivors(
    wanted: DataFrame, survivors: DataFrame, grid: tuple, n_alphas: int, folds: int, id_type: str
) -> DataFrame:
    """One row per target: its donors, diagnostics, and the residuals of every fit of its grid."""
    schema = (
        f"target {id_type}, donors array<struct<donor:{id_type},weight:double>>, alpha double, l1_ratio double, "
        "cv_mse double, kkt double, capped boolean, residuals binary, levels binary, tolerance double"
    )
    packed = survivors.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("unit", "vec"))).alias("pool"))
    rows = wanted.join(packed, F.col("unit") == F.col("target")).select("target", "vec", "pool")
    tasks = max(1, min(rows.count(), 4 * wanted.sparkSession.sparkContext.defaultParallelism))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for target, vec, pool in zip(batch["target"], batch["vec"], batch["pool"]):
                names = [r["unit"] for r in pool]
                x = np.array([r["vec"] for r in pool], dtype=float).T
                trace: list[tuple[np.ndarray, float]] = []
                found = cross_validated_weights(x, np.asarray(vec, dtype=float), grid, n_alphas, folds, trace)
                positive = np.flatnonzero(found["weights"] > 0)
                scale = max(float(np.abs(x.T @ np.asarray(vec, dtype=float)).max()) / len(vec), np.finfo(float).tiny)
                yield pd.DataFrame(
                    {
                        "target": [target],
                        "donors": [[{"donor": names[i], "weight": float(found["weights"][i])} for i in positive]],
                        **{c: [found[c]] for c in ("alpha", "l1_ratio", "cv_mse", "kkt", "capped")},
                        "residuals": [np.concatenate([r for r, _ in trace]).astype(float).tobytes()],
                        "levels": [np.array([l for _, l in trace], dtype=float).tobytes()],
                        "tolerance": [TOLERANCE * scale],
                    }
                )

    return rows.repartition(tasks).mapInPandas(fit, schema)


def alpha_path(x: np.ndarray, y: np.ndarray, l1_ratio: float, n_alphas: int) -> np.ndarray:
    """Log-spaced penalties from the smallest that zeroes all weights down to a thousandth."""
    top = np.abs(x.T @ y).max() / (len(y) * l1_ratio)
    if top <= 0:
        top = np.finfo(float).tiny * 1e3
    return np.geomspace(top, top * 1e-3, n_alphas)


def nonnegative_weights(
    x: np.ndarray, y: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None
) -> tuple[np.ndarray, bool]:
    """Minimiser of 1/(2n)|y - xw|² + l1 Σw + l2/2 |w|² over w >= 0, and whether it converged.

    An active-set method: exact on the weights in use, which grow by the most promising
    ones and shrink where a weight would turn negative. A start near the solution, such as
    that of the neighbouring penalty, saves most steps. The systems solved are no larger
    than the number of rows or of weights in use, whichever is smaller.
    """
    n, p = x.shape
    w = np.zeros(p) if start is None else start.copy()
    used = w > 0
    scale = max(float(np.abs(x.T @ y).max()) / n, np.finfo(float).tiny)
    batch = 64 if l2 > 0 else 1
    for _ in range(STEPS):
        while used.any():
            columns = np.flatnonzero(used)
            goal = _unconstrained(x[:, columns], y, l1, l2, w[columns])
            negative = goal <= 0
            if not negative.any():
                w[:] = 0.0
                w[columns] = goal
                break
            now = w[columns]
            steps = now[negative] / np.maximum(now[negative] - goal[negative], 1e-300)
            moved = now + min(1.0, float(steps.min())) * (goal - now)
            gone = negative & (moved <= 1e-14 * max(1.0, float(moved.max())))
            moved[gone] = 0.0
            w[:] = 0.0
            w[columns] = moved
            used[columns[gone]] = False
        else:
            w[:] = 0.0
        slope = x.T @ (y - x @ w) / n - l1 - l2 * w
        slope[used] = -np.inf
        wanting = np.flatnonzero(slope > TOLERANCE * scale)
        if not len(wanting):
            return w, True
        best = wanting[np.argsort(-slope[wanting], kind="stable")]
        # several at once at first, one at a time later, which cannot cycle; without a ridge
        # always one, as columns in use must stay independent
        used[best[: max(1, batch)]] = True
        batch //= 2
    return w, False


def _unconstrained(
    x: np.ndarray, y: np.ndarray, l1: float, l2: float, now: np.ndarray
) -> np.ndarray:
    """Minimiser without the sign condition.

    Dependent columns without a ridge have none; the result then lies beyond the point
    where the first weight on the way down reaches zero.
    """
    n, p = x.shape
    pull = x.T @ y / n - l1
    if l2 > 0:
        if p <= n:
            return np.linalg.solve(x.T @ x / n + l2 * np.eye(p), pull)
        inner = np.eye(n) * (n * l2) + x @ x.T
        return (pull - x.T @ np.linalg.solve(inner, x @ pull)) / l2
    _, sizes, axes = np.linalg.svd(x, full_matrices=True)
    if p <= n and sizes[-1] > 1e-9 * sizes[0]:
        return axes.T @ ((axes @ pull) * n / sizes**2)
    free = axes[-1]
    slope = x.T @ (y - x @ now) / n - l1
    free = free if free @ slope >= 0 else -free
    falling = free < -1e-12
    if not falling.any():
        return now
    return now + 2 * (now[falling] / -free[falling]).min() * free


def cross_validated_weights(
    x: np.ndarray, y: np.ndarray, l1_ratios: Sequence[float], n_alphas: int, folds: int, trace: list | None = None
) -> dict:
    """Weights at the penalty with the smallest mean squared error over the folds.

    ``trace`` receives, for every fit made, the residuals divided by their number (0 where a row
    is held out) and the l1 level a column's product with them must pass to enter.
    """

    def note(rows: np.ndarray, w: np.ndarray, l1: float) -> None:
        if trace is not None:
            trace.append((np.where(rows, y - x @ w, 0.0) / rows.sum(), l1))

    n = len(y)
    folds = min(folds, n)
    errors = np.zeros((len(l1_ratios), n_alphas))
    paths = [alpha_path(x, y, ratio, n_alphas) for ratio in l1_ratios]
    capped = False
    for held_out in np.array_split(np.arange(n), folds) if folds > 1 else [np.arange(n)]:
        train = np.ones(n, dtype=bool)
        train[held_out] = folds <= 1
        for i, ratio in enumerate(l1_ratios):
            w = None
            for step, alpha in enumerate(paths[i]):
                w, done = nonnegative_weights(x[train], y[train], alpha * ratio, alpha * (1 - ratio), w)
                capped |= not done
                note(train, w, alpha * ratio)
                errors[i, step] += np.mean((y[held_out] - x[held_out] @ w) ** 2) / folds
    # ties go to the earlier ratio and the larger penalty
    i, step = np.unravel_index(np.argmin(errors), errors.shape)
    alpha, ratio = float(paths[i][step]), float(l1_ratios[i])
    w, done = nonnegative_weights(x, y, alpha * ratio, alpha * (1 - ratio))
    note(np.ones(n, dtype=bool), w, alpha * ratio)
    slope = x.T @ (y - x @ w) / n - alpha * ratio - alpha * (1 - ratio) * w
    worst = np.where(w > 0, np.abs(slope), np.maximum(slope, 0.0)).max()
    return {
        "weights": w,
        "alpha": alpha,
        "l1_ratio": ratio,
        "cv_mse": float(errors[i, step]),
        "kkt": float(worst / max(np.abs(x.T @ y).max() / n, np.finfo(float).tiny)),
        "capped": bool(capped or not done),
    }


def synthetic_trajectory(
    weights: DataFrame, series: DataFrame, unit: str, date: str, value: str
) -> DataFrame:
    """Observed and synthetic value per target and date.

    The synthetic value is null on dates a weighted donor misses; donors without weight
    play no part.
    """
    used = weights.filter(F.col("weight") > 0).select("target", "donor", "weight")
    donors = used.groupBy("target").agg(F.count(F.lit(1)).alias("_donors"))
    values = series.select(F.col(unit).alias("donor"), F.col(date).alias("date"), F.col(value).alias("_y"))
    summed = (
        used.join(values, "donor")
        .groupBy("target", "date")
        .agg(F.sum(F.col("weight") * F.col("_y")).alias("_sum"), F.count("_y").alias("_present"))
    )
    observed = values.select(F.col("donor").alias("target"), "date", F.col("_y").alias("observed"))
    synthetic = summed.join(donors, "target").select(
        "target",
        "date",
        F.when(F.col("_present") == F.col("_donors"), F.col("_sum")).alias("synthetic"),
    )
    return observed.join(donors.select("target"), "target", "left_semi").join(
        synthetic, ["target", "date"], "left"
    )


def normalised_weights(weights: DataFrame) -> DataFrame:
    """Each donor's share of its target's total weight, largest first."""
    positive = weights.filter(F.col("weight") > 0).select("target", "donor", "weight")
    return share_of_total(positive, ["target"], "weight", "normalised_weight").orderBy(
        "target", F.desc("normalised_weight"), "donor"
    )
