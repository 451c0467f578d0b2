"""District tables at two tiers: population, deprivation, location."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions import density, proportion, row_sum, weighted_row_mean
from arealens.operators.columns import quoted
from arealens.operators.relational import join_on, star_join
from arealens.operators.rollup import rollup_through, sum_all_numeric, weighted_means
from arealens.operators.scaling import gaussian, zscore
from arealens.sources import fixed
from arealens.sources.readers import cast_columns, promote_header

AGES = [f"age_{a}" for a in range(90)]
OLDEST = "age_90_plus"


def age_column(name: str) -> str:
    """Column name for an age header cell: "7" -> age_7, "90+" -> age_90_plus."""
    text = name.strip().removesuffix(".0")
    if text.isdigit():
        return f"age_{int(text)}"
    return OLDEST if text == "90+" else text


def population_sheet(raw: DataFrame, prefix: str | None = None) -> DataFrame:
    """Single-year populations from the landed sheet: header inside, footnotes below."""
    table = promote_header(raw, F.col(raw.columns[0]) == "Code", fixed.AREA_CODE_PATTERN, age_column)
    counts = [c for c in ["All ages", *AGES, OLDEST] if c in table.columns]
    typed = cast_columns(table, {c: "double" for c in counts})
    return typed if prefix is None else typed.filter(F.col("Code").startswith(prefix))


def population_bands(
    df: DataFrame, mean_weights: Sequence[float] = tuple(range(1, 91))
) -> DataFrame:
    """Three bands, their total and shares, and the mean age.

    The mean age weighs age a by a + 1 and leaves the open last age out of the numerator
    only; pass other weights for another convention.
    """
    bands = {
        "pop_00_15": AGES[:16],
        "pop_16_75": AGES[16:76],
        "pop_76_90": [OLDEST, *AGES[76:]],
    }
    summed = df.withColumns({name: row_sum(ages) for name, ages in bands.items()})
    total = summed.withColumn("pop_total", F.col("pop_00_15") + F.col("pop_16_75") + F.col("pop_76_90"))
    return total.withColumns(
        {f"{name}_prop": proportion(name, "pop_total") for name in bands}
        | {"age_mean": weighted_row_mean([F.coalesce(a, F.lit(0)) for a in AGES], mean_weights, "pop_total")}
    )


def upper_tier_population(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Every numeric column summed to the upper tier."""
    joined = join_on(df.drop("Name", "Geography1"), lookup.select("ltla19cd", "utla19cd", "utla19nm"), {"Code": "ltla19cd"})
    return sum_all_numeric(joined.drop("Code"), ["utla19cd", "utla19nm"])


def upper_tier_location(location: DataFrame, lookup: DataFrame) -> DataFrame:
    """Mean coordinates and summed area per upper-tier unit."""
    return rollup_through(
        location,
        lookup.select("ltla19cd", "utla19cd", "utla19nm"),
        {"lad19cd": "ltla19cd"},
        ["utla19cd", "utla19nm"],
        {"long": "mean", "lat": "mean", "st_areashape": "sum"},
    )


def deprivation_sheets(sheets: Mapping[str, DataFrame]) -> list[DataFrame]:
    """Average score and most-deprived share of each domain, under short names."""
    tables = []
    for sheet, (title, short) in fixed.DEPRIVATION_SHEETS.items():
        tables.append(
            sheets[sheet].select(
                quoted("Local Authority District code (2019)").alias("lad_cd_19"),
                quoted(f"{title} - Average score ").alias(f"{short}_average_score"),
                quoted(f"{title} - Proportion of LSOAs in most deprived 10% nationally ").alias(
                    f"{short}_prop_lsoa_10perc"
                ),
            )
        )
    return tables


def lower_tier_deprivation(domains: Sequence[DataFrame]) -> DataFrame:
    first, *others = domains
    return star_join(first, *[(d, "lad_cd_19") for d in others])


def upper_tier_deprivation(
    domains: Sequence[DataFrame], lookup: DataFrame, population: DataFrame, weight: str = "All ages"
) -> DataFrame:
    """Population-weighted mean of the scores per upper-tier unit."""
    lower = lower_tier_deprivation(domains)
    weighted = star_join(
        lower,
        (lookup.select("ltla19cd", "utla19cd"), {"lad_cd_19": "ltla19cd"}),
        (population.select("Code", quoted(weight).alias("_weight")), {"lad_cd_19": "Code"}),
    )
    scores = [c for c in lower.columns if c != "lad_cd_19"]
    return weighted_means(weighted, ["utla19cd"], scores, "_weight")


POPULATION_COLUMNS = [
    "age_mean",
    "pop_total",
    "pop_00_15",
    "pop_16_75",
    "pop_76_90",
    "pop_00_15_prop",
    "pop_16_75_prop",
    "pop_76_90_prop",
]


def lower_tier_table(location: DataFrame, population: DataFrame, deprivation: DataFrame | None = None) -> DataFrame:
    """Districts with population, deprivation and density (area in m²)."""
    slim = location.drop("st_lengthshape", "bng_n", "bng_e", "lad19nmw", "objectid")
    table = join_on(slim, population.select("Code", *POPULATION_COLUMNS), {"lad19cd": "Code"})
    if deprivation is not None:
        table = join_on(table, deprivation, {"lad19cd": "lad_cd_19"})
    return table.withColumn("pop_density", density("pop_total", "st_areashape", area_units_per_km2=1e6))


def upper_tier_table(location: DataFrame, population: DataFrame, deprivation: DataFrame) -> DataFrame:
    """Upper-tier units; density uses the unit's own population."""
    table = star_join(
        location, (population.select("utla19cd", *POPULATION_COLUMNS), "utla19cd"), (deprivation, "utla19cd")
    )
    return table.withColumn("pop_density", density("pop_total", "st_areashape", area_units_per_km2=1e6))


def scaled_district_space(
    table: DataFrame, id_col: str, seed: int = 420, weights: Mapping[str, float] = fixed.DISTRICT_WEIGHTS
) -> DataFrame:
    """Standardised, partly down-weighted features, with a noise column added afterwards."""
    groups = fixed.DISTRICT_FEATURE_GROUPS
    listed = [*POPULATION_COLUMNS, *groups["spatial"], *groups["deprivation"]]
    columns = [c for c in dict.fromkeys(listed) if c in table.columns]
    present = {c: w for c, w in weights.items() if c in columns}
    return zscore(table, columns, present).withColumn("noise", gaussian(id_col, seed))
