"""Schemas of the input tables, as Spark DDL."""

from __future__ import annotations

from .fixed import (
    AGE_BANDS,
    DEPRIVATION_SHEETS,
    ETHNIC_GROUPS,
    ETHNICITY_TOTAL,
    IMD_COLUMNS,
    MOBILITY_COLUMNS,
)


def _ddl(types: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in types.items())


LTLA_UTLA = "FID INT, LTLA19CD STRING, LTLA19NM STRING, UTLA19CD STRING, UTLA19NM STRING"
LTLA_UTLA_2021 = "LTLA21CD STRING, UTLA21CD STRING, UTLA21NM STRING"
LAD_LOCATION = (
    "objectid INT, lad19cd STRING, lad19nm STRING, lad19nmw STRING, bng_e INT, bng_n INT, "
    "long DOUBLE, lat DOUBLE, st_areashape DOUBLE, st_lengthshape DOUBLE"
)
WORLD_CITIES = (
    "city_ascii STRING, lat DOUBLE, lng DOUBLE, iso3 STRING, capital STRING, population DOUBLE"
)
VERTICES = "lsoa11cd STRING, ring INT, seq INT, x DOUBLE, y DOUBLE"
LSOA_LOCATION = "lsoa11cd STRING, area DOUBLE, lati DOUBLE, long DOUBLE"
LSOA_LOOKUP = (
    "FID INT, LSOA11CD STRING, LSOA11NM STRING, CCG21CD STRING, CCG21CDH STRING, "
    "CCG21NM STRING, STP21CD STRING, STP21NM STRING, CAL21CD STRING, CAL21NM STRING, "
    "LAD21CD STRING, LAD21NM STRING"
)
TRUST_API = "areaCode STRING, areaName STRING, date STRING, newAdmissions LONG"
POSTCODES = "postcode STRING, latitude DOUBLE, longitude DOUBLE"
TRUST_MAP = "lsoa11cd STRING, nhstrustcd STRING, nhstrustnm STRING"
AGE_RAW = _ddl(
    {"LSOA Code": "STRING", "All Ages": "LONG"} | {source: "LONG" for source, _, _ in AGE_BANDS}
)
IMD_RAW = _ddl({name: "STRING" if new == "LSOA Code" else "INT" for name, new in IMD_COLUMNS.items()})
ETHNICITY_RAW = _ddl(
    {"geography code": "STRING", ETHNICITY_TOTAL: "LONG"}
    | {
        ETHNICITY_TOTAL.replace("Ethnic Group: All categories: Ethnic group", f"{prefix}: Total"): "LONG"
        for prefix in ETHNIC_GROUPS.values()
    }
)
CASES = "areaCode STRING, date DATE, newCasesBySpecimenDate LONG"
CASES_LEGACY = (
    "`Area type` STRING, `Area code` STRING, `Specimen date` DATE, "
    "`Daily lab-confirmed cases` LONG"
)
RT_RAW = "area STRING, date DATE, Rt DOUBLE, CIlow DOUBLE, CIup DOUBLE, coverage DOUBLE"
MOBILITY_RAW = "country_region_code STRING, sub_region_1 STRING, date DATE, " + _ddl(
    {name: "DOUBLE" for name in MOBILITY_COLUMNS}
)
MOBILITY_LOOKUP = "sub_region_1 STRING, lad19cd STRING, la_name STRING"
DEPRIVATION_SHEET = {
    sheet: _ddl(
        {
            "Local Authority District code (2019)": "STRING",
            f"{title} - Average score ": "DOUBLE",
            f"{title} - Proportion of LSOAs in most deprived 10% nationally ": "DOUBLE",
        }
    )
    for sheet, (title, _) in DEPRIVATION_SHEETS.items()
}
