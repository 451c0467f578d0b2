"""Built tables in a folder: read when they are there, rebuilt from raw input on request."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from arealens.sources.writers import materialize, write_csv

from . import areas

Raw = Mapping[str, DataFrame]


def _builders(raw: Raw, built: Callable[[str], DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """How each table is made from raw input and from the other tables."""

    def locations() -> DataFrame:
        return areas.area_location(raw["outlines"], raw.get("centroids"))

    def trust_map() -> DataFrame:
        trusts = areas.trust_locations(raw["admissions"], raw["trust_register"], raw["postcodes"])
        return areas.trust_map(built("locations"), trusts)

    def lexicon() -> DataFrame:
        return areas.spatial_lexicon(raw["area_lookup"], built("locations"), raw["tier_lookup"], built("trust_map"))

    def cases(grain: str) -> DataFrame:
        bridge = areas.area_bridge(built("lexicon"), built("ages"))
        return areas.seasonal_cases(raw["cases"], bridge, grain)

    return {
        "locations": locations,
        "trust_map": trust_map,
        "lexicon": lexicon,
        "ages": lambda: areas.age_table(raw["ages"]),
        "deprivation": lambda: areas.deprivation_table(raw["deprivation"]),
        "ethnicity": lambda: areas.ethnicity_table(raw["ethnicity"]),
        "cases_by_season": lambda: areas.seasonal_cases_wide(cases("season")),
        "cases_by_date": lambda: cases("date"),
        "rt": lambda: areas.rt_table(raw["rt"]),
        "mobility": lambda: areas.mobility_table(raw["mobility"], raw["mobility_lookup"]),
    }


class AreaTables:
    """The area tables below ``folder``, on any file system the executors share.

    ``tables["ages"]`` reads the stored table, and builds and stores it first when it is
    missing or ``refresh`` is set; tables it depends on are built the same way, once.
    """

    def __init__(self, spark: SparkSession, folder: str, raw: Raw | None = None, refresh: bool = False):
        self._spark, self._folder, self._refresh = spark, folder.rstrip("/"), refresh
        self._builders = _builders(raw or {}, self.__getitem__)
        self._ready: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._ready:
            self._ready[name] = materialize(
                self._spark, f"{self._folder}/{name}", self._builders[name], self._refresh
            )
        return self._ready[name]

    def names(self) -> list[str]:
        return list(self._builders)

    def full(self, with_cases: bool = True) -> DataFrame:
        """One row per small area with everything known about it."""
        return areas.full_area_table(
            self["deprivation"],
            self["ages"],
            self["lexicon"],
            self["ethnicity"],
            self["cases_by_season"] if with_cases else None,
        )

    def export_csv(self, name: str, path: str) -> None:
        write_csv(self[name], path)
