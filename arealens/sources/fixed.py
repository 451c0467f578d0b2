"""Fixed values the results depend on: code lists, calendars, band mid-points, names.

These are data, not logic. Every function that uses one takes it as a parameter, so other
editions of the same lists can be passed in.
"""

from __future__ import annotations

# Retired district codes and the unitary codes that replaced them.
DISTRICT_RECODES = {
    # Buckinghamshire
    "E07000004": "E06000060",
    "E07000005": "E06000060",
    "E07000006": "E06000060",
    "E07000007": "E06000060",
    # North Northamptonshire
    "E07000156": "E06000061",
    "E07000153": "E06000061",
    "E07000152": "E06000061",
    "E07000150": "E06000061",
    # West Northamptonshire
    "E07000155": "E06000062",
    "E07000154": "E06000062",
    "E07000151": "E06000062",
}

# Postcodes of trusts the published register leaves blank.
TRUST_POSTCODES = {
    "TAD": "BD18 3LA",
    "TAE": "M21 9UN",
    "TAF": "NW1 0PE",
    "TAH": "S10 3TH",
    "TAJ": "B70 9PL",
    "NRRK": "B40 1NT",
    "NR1H": "E16 1XL",
    "N4H3U": "E16 1XL",
    "NR0A": "M3 4LP",
    "NRH8": "EX2 7JG",
    "NRR8": "HG1 5LA",
}

# Case seasons, half-open [from, to). February is in no season.
CASE_SEASONS = [
    ("spring_2021", "2021-03-01", "2021-06-01"),
    ("summer_2021", "2021-06-01", "2021-09-01"),
    ("autumn_2021", "2021-09-01", "2021-12-01"),
    ("winter_2021", "2020-12-01", "2021-02-01"),
    ("winter_2022", "2021-12-01", "2022-02-01"),
]

# The shorter season list of the older page.
CASE_SEASONS_SHORT = CASE_SEASONS[:2]

# Column name per season.
SEASON_COLUMNS = {
    "spring_2021": "nc_sprng_2021",
    "summer_2021": "nc_smmr_2021",
    "autumn_2021": "nc_atmn_2021",
    "winter_2021": "nc_wntr_2021",
    "winter_2022": "nc_wntr_2022",
}

# Broad age bands, as (source column, result column, mid-point age).
AGE_BANDS = [
    ("0-15", "pop_00_15", 7.5),
    ("16-29", "pop_16_29", 22.5),
    ("30-44", "pop_30_44", 37.0),
    ("45-64", "pop_45_64", 54.5),
    ("65+", "pop_65_plus", 72.0),
]

# Deprivation deciles, as source column to result column.
_DECILE = "Decile (where 1 is most deprived 10% of LSOAs)"
IMD_COLUMNS = {
    "LSOA code (2011)": "LSOA Code",
    f"Index of Multiple Deprivation (IMD) {_DECILE}": "imd_full",
    f"Health Deprivation and Disability {_DECILE}": "imd_health",
    f"Employment {_DECILE}": "imd_employ",
    f"Living Environment {_DECILE}": "imd_living",
}

# Census column naming for ethnic groups.
ETHNICITY_PREFIX = "Sex: All persons; Age: All categories"
ETHNICITY_TOTAL = (
    "Sex: All persons; Age: All categories: Age; "
    "Ethnic Group: All categories: Ethnic group; measures: Value"
)
ETHNIC_GROUPS = {
    "other": "Ethnic Group: Other",
    "black": "Ethnic Group: Black",
    "mixed": "Ethnic Group: Mixed",
    "asian": "Ethnic Group: Asian",
    "white": "Ethnic Group: White",
}

# Mobility columns, as source column to result column.
MOBILITY_COLUMNS = {
    "retail_and_recreation_percent_change_from_baseline": "retail_mob",
    "transit_stations_percent_change_from_baseline": "transit_mob",
    "workplaces_percent_change_from_baseline": "workplace_mob",
    "residential_percent_change_from_baseline": "residential_mob",
    "grocery_and_pharmacy_percent_change_from_baseline": "grocery_mob",
    "parks_percent_change_from_baseline": "parks_mob",
}
MOBILITY_FROM = "2021-08-01"

# Sheets of the district deprivation summaries and their columns.
DEPRIVATION_SHEETS = {
    "IMD": ("IMD", "imd"),
    "Health": ("Health Deprivation and Disability", "health"),
    "Employment": ("Employment", "employment"),
}

# Hierarchy levels, as (code column, name column).
LEVELS = {
    "LAD": ("LAD21CD", "LAD21NM"),
    "UTLA": ("UTLA21CD", "UTLA21NM"),
    "CCG": ("CCG21CD", "CCG21NM"),
    "STP": ("STP21CD", "STP21NM"),
    "MSOA": ("MSOA11CD_APPX", "MSOA11NM_APPX"),
    "CAL": ("CAL21CD", "CAL21NM"),
    "NHST": ("nhstrustcd", "nhstrustnm"),
}

# Feature groups of the area profile.
FEATURE_GROUPS = {
    "Age Proportions": [
        "pop_00_15_prop",
        "pop_16_29_prop",
        "pop_30_44_prop",
        "pop_45_64_prop",
        "pop_65_plus_prop",
    ],
    "IMD": ["imd_full", "imd_health", "imd_employ", "imd_living"],
    "Space": ["area", "lati", "long", "pop_density"],
    "Population Sizes": [
        "pop_00_15",
        "pop_16_29",
        "pop_30_44",
        "pop_45_64",
        "pop_65_plus",
        "pop_all_ages",
    ],
    "Ethnicity Proportions": [
        "pop_white_prop",
        "pop_asian_prop",
        "pop_mixed_prop",
        "pop_black_prop",
        "pop_other_prop",
    ],
    "New Cases Rate (Daily)": [
        "nc_sprng_2021_iqr_rate",
        "nc_sprng_2021_q50_rate",
        "nc_smmr_2021_iqr_rate",
        "nc_smmr_2021_q50_rate",
        "nc_atmn_2021_iqr_rate",
        "nc_atmn_2021_q50_rate",
    ],
}

# Feature groups of the district tables, and their down-weighted columns.
DISTRICT_FEATURE_GROUPS = {
    "age": ["pop_total", "age_mean", "pop_00_15_prop", "pop_16_75_prop", "pop_76_90_prop"],
    "deprivation": [
        "imd_average_score",
        "imd_prop_lsoa_10perc",
        "health_average_score",
        "health_prop_lsoa_10perc",
        "employment_average_score",
        "employment_prop_lsoa_10perc",
    ],
    "spatial": ["long", "lat", "st_areashape", "pop_density"],
}
DISTRICT_WEIGHTS = {"pop_total": 0.5, "long": 0.5, "lat": 0.5, "st_areashape": 0.5}

# Districts left out of synthetic controls, and its window and seeds.
TINY_DISTRICTS = ["E06000053", "E09000001"]
CONTROL_SERIES_FROM = "2020-09-01"
L1_RATIOS = [0.01, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0]
N_ALPHAS = 101
N_FOLDS = 10

# Model columns of the scenario page.
SCENARIO_MOBILITY = ["retail_mob", "transit_mob", "workplace_mob", "residential_mob"]
SCENARIO_CALENDAR = ["is_weekend"]

# Shape of area, population-centre and trust codes.
AREA_CODE_PATTERN = "^[A-Z][0-9]{8}$"
