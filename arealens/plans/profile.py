"""Profile of every unit at a chosen level of the hierarchy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions import density, proportion, rate_per, spread
from arealens.operators.quantiles import HEAVY_ROWS, quantile_specs
from arealens.operators.rollup import rollup_units
from arealens.operators.scaling import gaussian
from arealens.sources import fixed

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


@dataclass(frozen=True)
class ProfileSpec:
    """Which columns of the small-area table play which part."""

    area: str = "area"
    place: Sequence[str] = ("lati", "long")
    population: str = "pop_all_ages"
    population_parts: Sequence[str] = tuple(name for _, name, _ in fixed.AGE_BANDS)
    means: Sequence[str] = ("approx_mean_age", "imd_full", "imd_health", "imd_employ", "imd_living")
    group_total: str | None = "eth_all"
    groups: Sequence[str] = ("white", "asian", "mixed", "black", "other")
    cases: Sequence[str] = ("nc_sprng_2021", "nc_smmr_2021", "nc_atmn_2021")
    levels: Mapping[str, Sequence[str]] = field(default_factory=lambda: fixed.LEVELS)


def level_columns(level: str, levels: Mapping[str, Sequence[str]] = fixed.LEVELS) -> list[str]:
    """Code and name column of a level; both are grouped by, as names may repeat."""
    if level not in levels:
        raise ValueError(f"unknown level {level!r}; choose from {sorted(levels)}")
    return list(levels[level])


def unit_profile(
    areas: DataFrame,
    level: str,
    spec: ProfileSpec = ProfileSpec(),
    noise_seed: int | None = 420,
    strategy: str = "auto",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Sums, means, medians, case quartiles, rates, spreads, density and proportions.

    One shuffle of the small-area table; everything derived is added to the few rows that
    remain. Under "auto" the units are sized first, from their keys alone.
    """
    return _profile(areas, level_columns(level, spec.levels), spec, noise_seed, strategy, heavy_rows)


def level_profiles(
    areas: DataFrame,
    levels: Sequence[str] | None = None,
    spec: ProfileSpec = ProfileSpec(),
    noise_seed: int | None = 420,
    strategy: str = "auto",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """(level, code, name, ...): the profiles of several levels of the hierarchy from one pass.

    Every area counts towards one unit of each level, so its row is handed to all of them where it is
    read, and one aggregation serves all: the sums combine map-side, and medians and quartiles
    are as exact as those of a single level. Codes and names are strings here, as levels may differ
    in type. Areas without a code at a level take no part in that level.
    """
    levels = list(spec.levels if levels is None else levels)
    units = [
        F.struct(F.lit(level).alias("level"), *[F.col(c).cast("string").alias(n) for c, n in zip(level_columns(level, spec.levels), ("code", "name"))])
        for level in levels
    ]
    placed = areas.withColumn("_unit", F.explode(F.array(*units)))
    held = [*_aggregates(spec), *spec.cases]
    placed = placed.select("_unit.*", *dict.fromkeys(held))
    return _profile(placed, ["level", "code", "name"], spec, noise_seed, strategy, heavy_rows, ["level", "code"])


def _aggregates(spec: ProfileSpec) -> dict[str, str]:
    sums = [spec.area, spec.population, *spec.population_parts, *spec.groups]
    sums += [spec.group_total] if spec.group_total else []
    return (
        {spec.area: "sum"}
        | {c: "median" for c in spec.place}
        | {c: "sum" for c in sums}
        | {c: "mean" for c in spec.means}
    )


def _profile(
    areas: DataFrame,
    keys: Sequence[str],
    spec: ProfileSpec,
    noise_seed: int | None,
    strategy: str,
    heavy_rows: int,
    noise_key: Sequence[str] = (),
) -> DataFrame:
    profile = rollup_units(
        areas, keys, _aggregates(spec), quantile_specs(spec.cases, QUARTILES), strategy, heavy_rows
    )
    rates = {
        f"{c}_{q}_rate": rate_per(f"{c}_{q}", spec.population) for c in spec.cases for q in QUARTILES
    }
    profile = profile.withColumns(rates)
    derived = {f"{c}_iqr_rate": spread(f"{c}_q75_rate", f"{c}_q25_rate") for c in spec.cases}
    derived["pop_density"] = density(spec.population, spec.area, 1)
    for part in spec.population_parts:
        derived[f"{part}_prop"] = proportion(part, spec.population, 3)
    for group in spec.groups:
        derived[f"pop_{group}_prop"] = proportion(group, spec.group_total, 3)
    profile = profile.withColumns(derived)
    if noise_seed is not None:
        profile = profile.withColumn("noise", gaussian(F.concat_ws(":", *(noise_key or keys[:1])), noise_seed))
    return profile
