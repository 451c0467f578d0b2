"""Similarity search: the units most like a given one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.operators.columns import numeric_columns
from arealens.operators.neighbours import (
    knn,
    neighbour_report,
    neighbour_sentence,
    pca_is_useful,
    pca_scores,
)
from arealens.operators.scaling import percent_explained, resolve_features, zscore
from arealens.session import cut
from arealens.sources import fixed


@dataclass(frozen=True)
class Neighbours:
    """Outcome of a search; every table is lazy."""

    table: DataFrame
    report: DataFrame
    sentences: DataFrame
    centres: DataFrame | None
    features: list[str]
    variance_kept: float | None
    on_noise: bool

    def of(self, unit) -> DataFrame:
        return self.table.filter(F.col("query_id") == F.lit(unit)).orderBy("rank")


def unit_by_name(units: DataFrame, id_col: str, name_col: str, name: str) -> DataFrame:
    """The unit of a display name; of several with one name, the smallest id."""
    return units.filter(F.col(name_col) == F.lit(name)).agg(F.min(id_col).alias(id_col))


def find_neighbours(
    profile: DataFrame,
    id_col: str,
    name_col: str,
    groups: Sequence[str] = (),
    nn: int = 3,
    components: int | None = None,
    feature_groups: Mapping[str, Sequence[str]] = fixed.FEATURE_GROUPS,
    weights: Mapping[str, float] | None = None,
    scale: Sequence[str] | None = None,
    place: Sequence[str] = (),
) -> Neighbours:
    """The ``nn`` nearest units of every unit in the space of the chosen feature groups.

    Every numeric column, or those in ``scale``, is standardised first. With ``components``
    the distance is taken between that many principal components; this is ignored below
    four features. Without a group the match is on noise. ``place`` names coordinate
    columns whose median over each neighbourhood is returned as its centre.
    """
    features = resolve_features(groups, feature_groups)
    # read by the moments, the search and the report: roll the areas up only once
    profile = cut(profile)
    scaled = zscore(profile, scale or numeric_columns(profile, [id_col, name_col]), weights)
    kept = None
    if components is not None and pca_is_useful(features):
        if not 2 <= components <= len(features):
            raise ValueError(f"components must be between 2 and {len(features)}")
        space, ratios = pca_scores(scaled, id_col, features, components)
        kept = percent_explained(ratios, components)
        table = knn(space, id_col, "scores", nn)
    else:
        table = knn(scaled, id_col, features, nn)
    return Neighbours(
        table=table,
        report=neighbour_report(table, profile, scaled, id_col, features),
        sentences=neighbour_sentence(table, profile, id_col, name_col, features == ["noise"]),
        centres=neighbourhood_centres(table, profile, id_col, place) if place else None,
        features=features,
        variance_kept=kept,
        on_noise=features == ["noise"],
    )


def neighbourhood_centres(
    table: DataFrame, units: DataFrame, id_col: str, place: Sequence[str]
) -> DataFrame:
    """Median coordinates of each unit and its neighbours (k + 1 rows per group)."""
    located = table.join(units.select(F.col(id_col).alias("neighbour_id"), *place), "neighbour_id")
    return located.groupBy("query_id").agg(*[F.median(c).alias(c) for c in place])


def city_neighbours(
    cities: DataFrame, k: int, country: str = "GBR", more_than: float = 100_000.0
) -> DataFrame:
    """The ``k`` nearest large cities of each, the city itself being the first of them."""
    large = cities.filter((F.col("iso3") == country) & (F.col("population") > more_than))
    found = knn(large, "city_ascii", ["lat", "lng"], k - 1)
    place = large.select(
        F.col("city_ascii").alias("neighbour_id"), "iso3", "lat", F.col("lng").alias("lon")
    )
    return found.join(place, "neighbour_id")
