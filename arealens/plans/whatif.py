"""Scenario analysis of mobility changes, end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions import in_period
from arealens.operators.density import kde
from arealens.operators.scenario import (
    daily_panel,
    feature_importances,
    fit_forest,
    mean_effect,
    predict,
    regression_metrics,
    scenario_effect,
)
from arealens.sources import fixed


@dataclass(frozen=True)
class WhatIf:
    model: RandomForestRegressionModel
    features: list[str]
    panel: DataFrame
    metrics: DataFrame
    importances: DataFrame
    effects: DataFrame

    def effect_density(self, start: str | None = None, units: Sequence[str] | None = None) -> DataFrame:
        """Kernel density of the mean effect per area, for chosen dates and areas."""
        rows = self.effects.filter(in_period("date", start))
        if units is not None:
            rows = rows.filter(F.col("la_name").isin(list(units)))
        return kde(mean_effect(rows, "la_name"), "effect")


def scenario_features(
    groups: Sequence[str] = (), feature_groups: Mapping[str, Sequence[str]] = fixed.FEATURE_GROUPS
) -> list[str]:
    chosen = [c for name, members in feature_groups.items() if name in groups for c in members]
    return [*fixed.SCENARIO_MOBILITY, *fixed.SCENARIO_CALENDAR, *chosen]


def what_if(
    mobility: DataFrame,
    rt: DataFrame,
    profile: DataFrame,
    shifts: Mapping[str, float],
    groups: Sequence[str] = (),
    trees: int = 20,
    depth: int = 6,
    seed: int = 0,
) -> WhatIf:
    """Model Rt from mobility and static features, then re-predict at shifted mobility.

    ``profile`` is a unit profile keyed by LAD21CD. Rows with any missing value are left
    out, as the model cannot use them.
    """
    panel = daily_panel(
        mobility, rt.select("date", "la_name", "Rt"), ["date", "la_name"], "date", profile, {"lad19cd": "LAD21CD"}
    ).na.drop("any")
    features = scenario_features(groups)
    model = fit_forest(panel, features, "Rt", trees, depth, seed)
    return WhatIf(
        model=model,
        features=features,
        panel=panel,
        metrics=regression_metrics(predict(model, panel, features, "expected"), "Rt", "expected"),
        importances=feature_importances(model, features, panel),
        effects=scenario_effect(model, panel, features, "Rt", shifts, ["date", "la_name"]),
    )
