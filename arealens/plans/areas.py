"""Cleaning and integration of the small-area tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealens.functions import (
    drop_last_char,
    in_period,
    null_safe_sum,
    recode,
    round_even,
    season_of,
    short_key,
    weighted_row_mean,
)
from arealens.operators.allocation import allocate_to_children
from arealens.operators.columns import columns_where, quoted, rename, sum_columns_where
from arealens.operators.globe import nearest_on_globe
from arealens.operators.intervals import label_by_interval
from arealens.operators.relational import first_per_key, join_on, star_join
from arealens.operators.rollup import pivot_unique
from arealens.operators.spatial import nearest_facility, polygon_measures
from arealens.sources import fixed


def area_location(vertices: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """(lsoa11cd, area, lati, long): km² from the outlines, and their centre.

    ``centroids`` gives (lsoa11cd, lati, long) in degrees when the outlines are in metres;
    without it the outline coordinates are taken as they are.
    """
    measured = polygon_measures(vertices, "lsoa11cd", unit_scale=1e6)
    if centroids is None:
        return measured.select("lsoa11cd", "area", F.col("centroid_y").alias("lati"), F.col("centroid_x").alias("long"))
    return join_on(measured.select("lsoa11cd", "area"), centroids, "lsoa11cd")


def trust_locations(
    admissions: DataFrame,
    register: DataFrame,
    postcodes: DataFrame,
    extra_postcodes: Mapping[str, str] = fixed.TRUST_POSTCODES,
) -> DataFrame:
    """(areaCode, areaName, latitude, longitude) per trust; unknown places stay null."""
    catalogue = first_per_key(admissions.select("areaCode", "areaName"), ["areaCode"], ["areaName"])
    listed = join_on(catalogue, register.select("area_code", "post_code"), {"areaCode": "area_code"}, "left")
    filled = listed.withColumn(
        "postcode", F.coalesce("post_code", recode("areaCode", extra_postcodes, otherwise="null"))
    )
    located = join_on(filled, postcodes.select("postcode", "latitude", "longitude"), "postcode", "left")
    return located.select("areaCode", "areaName", "latitude", "longitude")


def trust_map(locations: DataFrame, trusts: DataFrame, prefix: str = "E", great_circle: bool = False) -> DataFrame:
    """(lsoa11cd, nhstrustcd, nhstrustnm): the trust nearest to each area.

    Distances are planar between degrees, or those on the globe with ``great_circle``.
    """
    areas = locations.filter(F.col("lsoa11cd").startswith(prefix))
    search = nearest_on_globe if great_circle else nearest_facility
    nearest = search(
        areas, "lsoa11cd", ["lati", "long"], trusts, "areaCode", ["latitude", "longitude"], carry=["areaName"]
    )
    return nearest.select("lsoa11cd", F.col("areaCode").alias("nhstrustcd"), F.col("areaName").alias("nhstrustnm"))


def with_approximate_msoa(df: DataFrame, name: str = "LSOA11NM") -> DataFrame:
    """Middle-layer name (the area name less its last letter) and a key made from it."""
    return df.withColumn("MSOA11NM_APPX", drop_last_char(name)).withColumn(
        "MSOA11CD_APPX", short_key("MSOA11NM_APPX")
    )


def spatial_lexicon(
    lookup: DataFrame, locations: DataFrame, upper_tier: DataFrame, trusts_by_area: DataFrame
) -> DataFrame:
    """One row per area with every level it belongs to, its place and its trust."""
    joined = star_join(
        lookup.drop("FID", "CCG21CDH"),
        (locations, {"LSOA11CD": "lsoa11cd"}),
        (upper_tier.select("LTLA21CD", "UTLA21CD", "UTLA21NM"), {"LAD21CD": "LTLA21CD"}),
        (trusts_by_area, {"LSOA11CD": "lsoa11cd"}),
    )
    return with_approximate_msoa(joined)


def age_table(
    raw: DataFrame,
    code: str = "LSOA Code",
    total: str = "All Ages",
    bands: Sequence[tuple[str, str, float]] = fixed.AGE_BANDS,
    prefix: str | None = "E",
) -> DataFrame:
    """Band populations and an approximate mean age from the band mid-points."""
    rows = raw if prefix is None else raw.filter(quoted(code).startswith(prefix))
    mean_age = weighted_row_mean([quoted(b) for b, _, _ in bands], [m for _, _, m in bands], quoted(total))
    return rows.select(
        quoted(total).alias("pop_all_ages"),
        *[quoted(source).alias(name) for source, name, _ in bands],
        round_even(mean_age, 2).alias("approx_mean_age"),
        quoted(code).alias("LSOA Code"),
    )


def deprivation_table(raw: DataFrame, columns: Mapping[str, str] = fixed.IMD_COLUMNS) -> DataFrame:
    return raw.select(*[quoted(source).alias(name) for source, name in columns.items()])


def ethnicity_table(
    raw: DataFrame,
    code: str = "geography code",
    prefix: str = fixed.ETHNICITY_PREFIX,
    total: str = fixed.ETHNICITY_TOTAL,
    groups: Mapping[str, str] = fixed.ETHNIC_GROUPS,
    marker: str = ": Total",
) -> DataFrame:
    """Counts per group, summed over the columns whose name holds group and marker."""
    kept = raw.select(quoted(code), *[quoted(c) for c in columns_where(raw, prefix)])
    summed = sum_columns_where(kept, {name: (text, marker) for name, text in groups.items()})
    return rename(summed, {code: "LSOA Code", total: "eth_all"}).select("LSOA Code", *groups, "eth_all")


def seasonal_cases(
    cases: DataFrame,
    bridge: DataFrame,
    grain: str = "season",
    prefix: str | None = "E",
    seasons: Sequence[tuple[str, str, str]] | DataFrame = fixed.CASE_SEASONS,
    codes: Mapping[str, str] = fixed.DISTRICT_RECODES,
    other: str = "other_season",
) -> DataFrame:
    """Cases per small area and season or date, spread by population; long format.

    ``cases`` is (areaCode, date, newCasesBySpecimenDate); ``bridge`` has one row per small
    area, (LSOA Code, LAD21CD, pop_all_ages). The parent population is that of the bridge.
    ``seasons`` are (name, from, to) in a list, or a table (name, start, end) of any length, whose
    seasons must not overlap.
    """
    if grain not in ("season", "date"):
        raise ValueError("grain must be season or date")
    rows = cases if prefix is None else cases.filter(F.col("areaCode").startswith(prefix))
    day = F.col("date").cast("date")
    if isinstance(seasons, DataFrame):
        named = label_by_interval(rows.withColumn("_day", day), "_day", seasons, "name", "season", other=other)
    else:
        # the span of all seasons is a plain range, which the scan can use to skip data
        span = in_period(day, min(s for _, s, _ in seasons), max(e for _, _, e in seasons))
        named = rows.filter(span).withColumn("season", season_of(day, seasons, other))
    kept = named.filter(F.col("season") != other)
    totals = (
        kept.withColumn("LAD21CD", recode("areaCode", codes))
        .dropna(subset=["LAD21CD"])
        .groupBy("LAD21CD", grain)
        .agg(null_safe_sum("newCasesBySpecimenDate").alias("cases"))
    )
    spread = allocate_to_children(totals, bridge, "LAD21CD", "cases", "pop_all_ages", "approx_lsoa_cases")
    return spread.select("LSOA Code", grain, "approx_lsoa_cases")


def seasonal_cases_wide(
    long: DataFrame, columns: Mapping[str, str] = fixed.SEASON_COLUMNS
) -> DataFrame:
    """One column per season."""
    wide = pivot_unique(long, ["LSOA Code"], "season", list(columns), "approx_lsoa_cases")
    return rename(wide, columns)


def area_bridge(lexicon: DataFrame, ages: DataFrame) -> DataFrame:
    """(LSOA Code, LAD21CD, pop_all_ages) for ``seasonal_cases``."""
    return join_on(
        lexicon.select(F.col("LSOA11CD").alias("LSOA Code"), "LAD21CD"),
        ages.select("LSOA Code", "pop_all_ages"),
        "LSOA Code",
    )


def rt_table(raw: DataFrame) -> DataFrame:
    return rename(raw, {"area": "la_name"}).withColumn("date", F.col("date").cast("date")).drop(
        "CIlow", "CIup", "coverage"
    )


def mobility_table(
    raw: DataFrame,
    lookup: DataFrame,
    country: str = "GB",
    start: str = fixed.MOBILITY_FROM,
    prefix: str | None = None,
    columns: Mapping[str, str] = fixed.MOBILITY_COLUMNS,
) -> DataFrame:
    """Daily mobility per area: one region's rows serve every area it maps to."""
    wanted: Column = (F.col("country_region_code") == country) & (
        F.col("date").cast("date") >= F.lit(start).cast("date")
    )
    rows = raw.filter(wanted).select("sub_region_1", F.col("date").cast("date").alias("date"), *[quoted(c) for c in columns])
    places = lookup.filter(F.col("lad19cd").isNotNull()).select("sub_region_1", "lad19cd", "la_name")
    joined = rename(join_on(rows, places, "sub_region_1").drop("sub_region_1"), columns)
    return joined if prefix is None else joined.filter(F.col("lad19cd").startswith(prefix))


def full_area_table(
    imd: DataFrame, ages: DataFrame, lexicon: DataFrame, ethnicity: DataFrame, cases: DataFrame | None = None
) -> DataFrame:
    """Star join of the small-area tables on the area code."""
    places = rename(lexicon, {"LSOA11CD": "LSOA Code"})
    tables = [ages, places, ethnicity] + ([cases] if cases is not None else [])
    return star_join(imd, *[(table, "LSOA Code") for table in tables])
