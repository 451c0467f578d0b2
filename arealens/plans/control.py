"""Synthetic control of one or many units, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions import in_period
from arealens.operators.columns import quoted
from arealens.operators.relational import only_in, sample_units
from arealens.operators.series import complete_days, features_long, monthly_features, rolling_rate
from arealens.operators.synthetic import (
    exclusions,
    fit_weights,
    normalised_weights,
    synthetic_trajectory,
    target_status,
    unit_vectors,
)
from arealens.session import cut
from arealens.sources import fixed

from .districts import lower_tier_table


@dataclass(frozen=True)
class Control:
    weights: DataFrame
    donors: DataFrame
    trajectory: DataFrame
    background: DataFrame
    status: DataFrame


def district_rates(cases: DataFrame, population: DataFrame, start: str = fixed.CONTROL_SERIES_FROM) -> DataFrame:
    """(unit, date, rolling_rate) of the lower-tier rows of the case table."""
    daily = cases.filter(quoted("Area type") == "ltla").select(
        quoted("Area code").alias("unit"),
        quoted("Specimen date").cast("date").alias("date"),
        quoted("Daily lab-confirmed cases").alias("cases"),
    )
    return rolling_rate(
        daily, population.select("Code", "pop_total"), {"unit": "Code"}, "date", "cases", "pop_total", start=start
    )


def donor_places(
    places: DataFrame, unit: str = "unit", prefix: str | None = "E", leave_out: Sequence[str] = fixed.TINY_DISTRICTS
) -> DataFrame:
    """The units a control may be built from: one country by code prefix, without the listed ones."""
    known = places.filter(F.col(unit).isNotNull())
    kept = known if prefix is None else known.filter(F.col(unit).startswith(prefix))
    return kept.filter(~F.col(unit).isin(list(leave_out)))


def district_places(
    location: DataFrame,
    population: DataFrame,
    prefix: str | None = "E",
    leave_out: Sequence[str] = fixed.TINY_DISTRICTS,
) -> DataFrame:
    """The donor table: unit, lat, long and what the district files say of every donor.

    ``population`` has bands (``districts.population_bands``). Districts without a population
    are no donors.
    """
    table = lower_tier_table(location, population).withColumnRenamed("lad19cd", "unit")
    return donor_places(table, "unit", prefix, leave_out)


def district_control(
    cases: DataFrame,
    location: DataFrame,
    population: DataFrame,
    targets: DataFrame,
    prefix: str | None = "E",
    leave_out: Sequence[str] = fixed.TINY_DISTRICTS,
    series_from: str = fixed.CONTROL_SERIES_FROM,
    **options,
) -> Control:
    """Synthetic control straight from the case, location and population files.

    Days on which a district has no row count no cases. ``options`` go to ``synthetic_control``.
    """
    places = cut(district_places(location, population, prefix, leave_out).select("unit", "lat", "long"))
    daily = cases.filter(quoted("Area type") == "ltla").select(
        quoted("Area code").alias("unit"),
        quoted("Specimen date").cast("date").alias("date"),
        quoted("Daily lab-confirmed cases").alias("cases"),
    )
    full = complete_days(only_in(daily, places.select("unit"), "unit"), "unit", "cases")
    people = population.select("Code", "pop_total")
    rates = rolling_rate(full, people, {"unit": "Code"}, "date", "cases", "pop_total", start=series_from)
    return synthetic_control(rates, places, targets, **options)


def pre_period_features(
    rates: DataFrame,
    value: str = "rolling_rate",
    start: str | None = None,
    end: str | None = None,
    months_of_year: Sequence[int] | None = None,
) -> DataFrame:
    """Monthly quartiles before the intervention, long, ordered by quantile then month.

    The period is a date range; ``months_of_year`` instead merges all years and keeps the
    listed months.
    """
    if months_of_year is None:
        period = rates.filter(in_period("date", start, end))
        monthly = monthly_features(period, "unit", "date", value)
    else:
        monthly = monthly_features(rates, "unit", "date", value, month_of_year=True).filter(
            F.col("month").isin(list(months_of_year))
        )
    return features_long(monthly, "unit", [f"{value}_{q}" for q in ("q25", "q50", "q75")])


def synthetic_control(
    rates: DataFrame,
    places: DataFrame,
    targets: DataFrame,
    exclude: int = 5,
    value: str = "rolling_rate",
    start: str | None = None,
    end: str | None = None,
    months_of_year: Sequence[int] | None = None,
    l1_ratios: Sequence[float] = fixed.L1_RATIOS,
    n_alphas: int = fixed.N_ALPHAS,
    folds: int = fixed.N_FOLDS,
    background: int = 12,
    seed: int = 4,
) -> Control:
    """Fit every target from the donors outside its geographic neighbourhood.

    ``places`` is (unit, lat, long), ``targets`` holds the column unit.
    """
    # read by the features, the trajectories and the background
    series = cut(only_in(rates, places.select("unit"), "unit"))
    features = pre_period_features(series, value, start, end, months_of_year)
    vectors = cut(unit_vectors(features, "unit", ["feature", "month"], "value"))
    barred = exclusions(places, "unit", "lat", "long", exclude, targets)
    weights = cut(fit_weights(vectors, targets, barred, l1_ratios, n_alphas, folds))
    shown = sample_units(series, "unit", background, seed)
    return Control(
        weights=weights,
        donors=normalised_weights(weights),
        trajectory=synthetic_trajectory(weights, series, "unit", "date", value),
        background=only_in(series, shown, "unit").select("unit", "date", value),
        status=target_status(targets, vectors, weights),
    )
