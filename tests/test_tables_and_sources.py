"""Area and district tables on small frames in their published shapes, and the readers."""

import pytest
from pyspark.sql import functions as F

from arealens.plans import areas, districts
from arealens.plans.profile import level_columns, unit_profile
from arealens.session import scratch_path, shared_dir
from arealens.sources import fixed, schemas
from arealens.sources.readers import (
    cast_columns,
    promote_header,
    read_csv,
    read_headerless_csv,
    read_sheets,
    read_text_table,
)
from arealens.sources.writers import is_complete, materialize, write_csv


def test_byte_order_mark_and_quoted_commas(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    path.write_bytes(
        b"\xef\xbb\xbfFID,LTLA19CD,LTLA19NM,UTLA19CD,UTLA19NM\r\n"
        b'10,E06000010,"Kingston upon Hull, City of",E06000010,"Kingston upon Hull, City of"\r\n'
    )
    df = read_csv(spark, str(path), schemas.LTLA_UTLA)
    assert df.first()["LTLA19NM"] == "Kingston upon Hull, City of" and df.columns[0] == "FID"
    inferred = read_csv(spark, str(path))
    assert inferred.columns[0] == "FID" and inferred.schema["FID"].dataType.simpleString() == "int"


def test_preamble_header_and_footnotes(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(
        "Mid-2019,,,,\n,,,,\nCode,Name,All ages,0,90+\nE06000001,Hartlepool,11,5,6\nW06000001,Mon,3,1,2\n"
        "Notes,,,,\nSource: office,,,,\n"
    )
    raw = read_text_table(spark, str(path))
    df = districts.population_sheet(raw, "E")
    assert df.columns == ["Code", "Name", "All ages", "age_0", "age_90_plus"]
    assert [tuple(r) for r in df.collect()] == [("E06000001", "Hartlepool", 11.0, 5.0, 6.0)]
    with pytest.raises(ValueError):
        promote_header(raw, F.col("_c0") == "missing")
    plain = promote_header(raw, F.col("_c0") == "Code")
    assert plain.filter(F.col("Code") == "Code").count() == 0
    assert cast_columns(plain, {"All ages": "int"}, strict=False).filter("`All ages` is null").count() >= 2


def test_headerless_and_sheets(spark, tmp_path):
    (tmp_path / "etrust.csv").write_text("R1,One,a,b,c,d,e,f,g,LS1 1AA\nR2,Two,a,b,c,d,e,f,g,\n")
    got = read_headerless_csv(spark, str(tmp_path / "etrust.csv"), {0: "area_code", 1: "area_name", 9: "post_code"})
    assert [tuple(r) for r in got.orderBy("area_code").collect()] == [("R1", "One", "LS1 1AA"), ("R2", "Two", None)]
    for sheet, (title, _) in fixed.DEPRIVATION_SHEETS.items():
        header = f"Local Authority District code (2019),{title} - Average score ,{title} - Proportion of LSOAs in most deprived 10% nationally "
        (tmp_path / f"{sheet}.csv").write_text(header + "\nE1,10.5,0.25\nE2,20.0,0.5\n")
    sheets = read_sheets(spark, str(tmp_path), schemas.DEPRIVATION_SHEET)
    table = districts.lower_tier_deprivation(districts.deprivation_sheets(sheets))
    assert set(table.columns) == {"lad_cd_19", *fixed.DISTRICT_FEATURE_GROUPS["deprivation"]}
    assert table.count() == 2


def test_write_and_materialise(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), "k int, v string").collect()), key=str) == [(1, "a,b"), (2, None)]
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "cached")
    assert not is_complete(spark, path)
    assert [materialize(spark, path, build).count() for _ in range(3)] == [1, 1, 1] and len(calls) == 1
    assert materialize(spark, path, build, refresh=True).count() == 2


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert folder is None or shared_dir(spark) == folder
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


# ---------------------------------------------------------------- areas
def lookup(spark):
    rows = [
        (i, f"E0100000{i}", f"Leeds 00{1 + i // 3}{'ABC'[i % 3]}", "C1", "h", "Ccg", "S1", "Stp", "A1", "Cal", f"E0800000{i % 2}", f"Lad{i % 2}")
        for i in range(6)
    ]
    return spark.createDataFrame(rows, schemas.LSOA_LOOKUP)


def squares(spark):
    rows = [
        (f"{'W' if i == 5 else 'E'}0100000{i}", 0, s, 1000.0 * (i + dx), 1000.0 * dy)
        for i in range(6)
        for s, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])
    ]
    return spark.createDataFrame(rows, schemas.VERTICES)


def test_trusts_and_lexicon(spark):
    admissions = spark.createDataFrame(
        [("T1", "One", "d1", 3), ("T1", "One", "d2", 4), ("TAD", "Patched", "d1", 1), ("T9", "Lost", "d1", 1)], schemas.TRUST_API
    )
    register = spark.createDataFrame([("T1", "One", "P1"), ("T9", "Lost", None)], "area_code string, area_name string, post_code string")
    postcodes = spark.createDataFrame([("P1", 500.0, 0.0), ("BD18 3LA", 500.0, 5000.0)], schemas.POSTCODES)
    trusts = areas.trust_locations(admissions, register, postcodes)
    assert {(r["areaCode"], r["longitude"]) for r in trusts.collect()} == {("T1", 0.0), ("TAD", 5000.0), ("T9", None)}
    locations = areas.area_location(squares(spark))
    assert locations.filter("area <> 1.0").count() == 0
    mapped = areas.trust_map(locations, trusts)
    assert {r["lsoa11cd"][-1]: r["nhstrustcd"] for r in mapped.collect()} == {"0": "T1", "1": "T1", "2": "T1", "3": "TAD", "4": "TAD"}
    upper = spark.createDataFrame([("E08000000", "U0", "Upper"), ("E08000001", "U0", "Upper")], schemas.LTLA_UTLA_2021)
    lexicon = areas.spatial_lexicon(lookup(spark), locations, upper, mapped)
    assert lexicon.count() == 5 and not {"FID", "CCG21CDH", "lsoa11cd", "LTLA21CD"} & set(lexicon.columns)
    row = lexicon.filter("LSOA11CD = 'E01000004'").first()
    assert (row["MSOA11NM_APPX"], row["UTLA21CD"], row["nhstrustcd"]) == ("Leeds 002", "U0", "TAD")
    assert len(row["MSOA11CD_APPX"]) == 13
    degrees = spark.createDataFrame([("E01000000", 53.0, -1.5)], "lsoa11cd string, lati double, long double")
    assert areas.area_location(squares(spark), degrees).first()["lati"] == 53.0


def test_attribute_tables(spark):
    raw = spark.createDataFrame([("E1", 10, 2, 2, 2, 2, 2), ("W1", 1, 1, 0, 0, 0, 0), ("E0", 0, 0, 0, 0, 0, 0)], schemas.AGE_RAW)
    ages = {r["LSOA Code"]: r for r in areas.age_table(raw).collect()}
    assert set(ages) == {"E1", "E0"} and ages["E1"]["approx_mean_age"] == 38.7 and ages["E0"]["approx_mean_age"] is None
    imd = areas.deprivation_table(spark.createDataFrame([("E1", 1, 2, 3, 4)], schemas.IMD_RAW))
    assert imd.columns == ["LSOA Code", "imd_full", "imd_health", "imd_employ", "imd_living"]
    eth = areas.ethnicity_table(spark.createDataFrame([("E1", 15, 1, 2, 3, 4, None)], schemas.ETHNICITY_RAW)).first()
    assert (eth["other"], eth["black"], eth["mixed"], eth["asian"], eth["white"], eth["eth_all"]) == (1, 2, 3, 4, 0, 15)


def test_rt_and_mobility(spark):
    import datetime

    day = datetime.date(2021, 8, 1)
    rt = areas.rt_table(spark.createDataFrame([("Bolton", day, 1.1, 1.0, 1.2, 0.9)], schemas.RT_RAW))
    assert rt.columns == ["la_name", "date", "Rt"]
    raw = spark.createDataFrame(
        [("GB", "Kent", day, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), ("GB", "Kent", datetime.date(2021, 7, 31), *[0.0] * 6), ("US", "Kent", day, *[0.0] * 6)],
        schemas.MOBILITY_RAW,
    )
    places = spark.createDataFrame([("Kent", "E1", "Ashford"), ("Kent", "W2", "Dover"), ("Kent", None, "Nowhere")], schemas.MOBILITY_LOOKUP)
    table = areas.mobility_table(raw, places)
    assert {(r["la_name"], r["retail_mob"], r["parks_mob"]) for r in table.collect()} == {("Ashford", 1.0, 6.0), ("Dover", 1.0, 6.0)}
    assert areas.mobility_table(raw, places, prefix="E").count() == 1


def cases_frame(spark):
    import datetime

    rows = [
        ("E07000004", datetime.date(2021, 3, 1), 60), ("E07000005", datetime.date(2021, 5, 31), 40), ("E06000060", datetime.date(2021, 6, 1), 7),
        ("E06000060", datetime.date(2021, 2, 10), 1000), ("S1", datetime.date(2021, 3, 1), 5), ("E06000060", datetime.date(2022, 1, 31), 10),
    ]
    return spark.createDataFrame(rows, schemas.CASES)


def test_seasonal_and_daily_cases(spark):
    bridge = spark.createDataFrame([("a", "E06000060", 30), ("b", "E06000060", 10)], "`LSOA Code` string, LAD21CD string, pop_all_ages long")
    wide = {r["LSOA Code"]: r for r in areas.seasonal_cases_wide(areas.seasonal_cases(cases_frame(spark), bridge)).collect()}
    assert (wide["a"]["nc_sprng_2021"], wide["b"]["nc_sprng_2021"]) == (75.0, 25.0)
    assert (wide["a"]["nc_smmr_2021"], wide["b"]["nc_smmr_2021"]) == (5.25, 1.75)
    assert wide["a"]["nc_atmn_2021"] is None and wide["b"]["nc_wntr_2022"] == 2.5
    daily = areas.seasonal_cases(cases_frame(spark), bridge, "date")
    assert daily.count() == 8 and daily.agg(F.sum("approx_lsoa_cases")).first()[0] == 117.0
    short = areas.seasonal_cases(cases_frame(spark), bridge, seasons=fixed.CASE_SEASONS_SHORT)
    assert {r["season"] for r in short.collect()} == {"spring_2021", "summer_2021"}
    with pytest.raises(ValueError):
        areas.seasonal_cases(cases_frame(spark), bridge, "week")


def test_profile_at_every_level(spark):
    n = 12
    base = [(f"L{i}", i % 10 + 1) for i in range(n)]
    imd = spark.createDataFrame([(c, d, d, d, d) for c, d in base], "`LSOA Code` string, imd_full int, imd_health int, imd_employ int, imd_living int")
    ages = spark.createDataFrame([(c, 100, 20, 20, 20, 20, 20, 38.7) for c, _ in base], "`LSOA Code` string, pop_all_ages long, pop_00_15 long, pop_16_29 long, pop_30_44 long, pop_45_64 long, pop_65_plus long, approx_mean_age double")
    eth = spark.createDataFrame([(c, 1, 2, 3, 4, 40, 50) for c, _ in base], "`LSOA Code` string, other long, black long, mixed long, asian long, white long, eth_all long")
    cases = spark.createDataFrame([(c, float(i), 2.0 * i, 3.0) for i, (c, _) in enumerate(base)], "`LSOA Code` string, nc_sprng_2021 double, nc_smmr_2021 double, nc_atmn_2021 double")
    names = [c for pair in fixed.LEVELS.values() for c in pair]
    lexicon = spark.createDataFrame(
        [(c, 0.5, float(i), -float(i), *[f"{n}{i % 2}" for n in names]) for i, (c, _) in enumerate(base)],
        "LSOA11CD string, area double, lati double, long double, " + ", ".join(f"{n} string" for n in names),
    )
    full = areas.full_area_table(imd, ages, lexicon, eth, cases)
    for level in fixed.LEVELS:
        profile = unit_profile(full, level)
        assert profile.count() == 2 and profile.columns[:2] == level_columns(level)
        assert {c for group in fixed.FEATURE_GROUPS.values() for c in group} <= set(profile.columns)
    even = unit_profile(full, "LAD", strategy="split").filter("LAD21CD = 'LAD21CD0'").first()
    assert even["pop_density"] == 200.0 and even["pop_00_15_prop"] == 0.2 and even["pop_white_prop"] == 0.8
    assert even["lati"] == 5.0 and even["nc_sprng_2021_iqr_rate"] == pytest.approx(100_000 * 5 / 600)
    with pytest.raises(ValueError):
        level_columns("WARD")


# ---------------------------------------------------------------- districts
def population(spark):
    names = [*districts.AGES, districts.OLDEST]
    rows = [(f"E{i}", f"N{i}", "District", 182.0 * (i + 1), *[2.0 * (i + 1)] * 91) for i in range(3)]
    return spark.createDataFrame(rows, "Code string, Name string, Geography1 string, `All ages` double, " + ", ".join(f"{n} double" for n in names))


def tier_lookup(spark):
    return spark.createDataFrame([("E0", "U1", "Upper"), ("E1", "U1", "Upper"), ("E2", "E2", "Same")], "ltla19cd string, utla19cd string, utla19nm string")


def test_population_bands_at_both_tiers(spark):
    lower = districts.population_bands(population(spark)).filter("Code = 'E0'").first()
    assert (lower["pop_00_15"], lower["pop_16_75"], lower["pop_76_90"], lower["pop_total"]) == (32.0, 120.0, 30.0, 182.0)
    assert lower["age_mean"] == pytest.approx(2 * sum(range(1, 91)) / 182)
    upper = districts.population_bands(districts.upper_tier_population(population(spark), tier_lookup(spark)))
    got = {r["utla19cd"]: r["pop_total"] for r in upper.collect()}
    assert got == {"U1": 546.0, "E2": 546.0}
    assert districts.age_column("7") == "age_7" and districts.age_column("90+") == "age_90_plus" and districts.age_column("Code") == "Code"


def test_district_tables(spark):
    bands = districts.population_bands(population(spark))
    place = spark.createDataFrame(
        [(i, f"E{i}", f"N{i}", "w", 1, 2, float(i), 50.0 + i, 2e6, 9.0) for i in range(3)], schemas.LAD_LOCATION
    )
    domains = [
        spark.createDataFrame([(f"E{i}", 10.0 * (i + 1), 0.1 * i) for i in range(3)], f"lad_cd_19 string, {s}_average_score double, {s}_prop_lsoa_10perc double")
        for _, s in fixed.DEPRIVATION_SHEETS.values()
    ]
    lower = districts.lower_tier_table(place, bands, districts.lower_tier_deprivation(domains))
    assert lower.filter("lad19cd = 'E0'").first()["pop_density"] == 91.0
    deprivation = districts.upper_tier_deprivation(domains, tier_lookup(spark), population(spark))
    got = {r["utla19cd"]: r["imd_average_score"] for r in deprivation.collect()}
    assert got == {"U1": pytest.approx((10 * 1 + 20 * 2) / 3), "E2": pytest.approx(30.0)}
    upper_bands = districts.population_bands(districts.upper_tier_population(population(spark), tier_lookup(spark)))
    upper = districts.upper_tier_table(districts.upper_tier_location(place, tier_lookup(spark)), upper_bands, deprivation)
    row = upper.filter("utla19cd = 'U1'").first()
    assert (row["long"], row["st_areashape"], row["pop_density"]) == (0.5, 4e6, 136.5)
    space = districts.scaled_district_space(lower, "lad19cd")
    spread = space.agg(F.stddev_pop("long").alias("w"), F.stddev_pop("imd_average_score").alias("u")).first()
    assert (spread["w"], spread["u"]) == (pytest.approx(0.5), pytest.approx(1.0))
    assert "noise" in space.columns


# ---------------------------------------------------------------- stored tables
def raw_tables(spark):
    import datetime

    codes = [f"E0100000{i}" for i in range(5)]
    day = datetime.date(2021, 3, 5)
    return {
        "outlines": squares(spark),
        "area_lookup": lookup(spark),
        "tier_lookup": spark.createDataFrame([(f"E0800000{i}", f"U{i}", f"Upper{i}") for i in range(2)], schemas.LTLA_UTLA_2021),
        "admissions": spark.createDataFrame([("T1", "One", "d1", 3)], schemas.TRUST_API),
        "trust_register": spark.createDataFrame([("T1", "One", "P1")], "area_code string, area_name string, post_code string"),
        "postcodes": spark.createDataFrame([("P1", 500.0, 0.0)], schemas.POSTCODES),
        "ages": spark.createDataFrame([(c, 100 + i, 20, 20, 20, 20, 20 + i) for i, c in enumerate(codes)], schemas.AGE_RAW),
        "deprivation": spark.createDataFrame([(c, i + 1, 2, 3, 4) for i, c in enumerate(codes)], schemas.IMD_RAW),
        "ethnicity": spark.createDataFrame([(c, 50, 1, 2, 3, 4, 40 + i) for i, c in enumerate(codes)], schemas.ETHNICITY_RAW),
        "cases": spark.createDataFrame([(f"E0800000{i}", day, 100) for i in range(2)], schemas.CASES),
        "rt": spark.createDataFrame([("Lad0", day, 1.1, 1.0, 1.2, 0.9)], schemas.RT_RAW),
        "mobility": spark.createDataFrame([("GB", "Kent", datetime.date(2021, 9, 1), *[1.0] * 6)], schemas.MOBILITY_RAW),
        "mobility_lookup": spark.createDataFrame([("Kent", "E08000000", "Lad0")], schemas.MOBILITY_LOOKUP),
    }


def test_tables_are_built_once_stored_and_used(spark, tmp_path):
    from arealens.plans.search import find_neighbours
    from arealens.plans.store import AreaTables

    folder = str(tmp_path / "store")
    first = AreaTables(spark, folder, raw_tables(spark))
    assert {n: first[n].count() for n in first.names()} == {
        "locations": 6, "trust_map": 5, "lexicon": 5, "ages": 5, "deprivation": 5, "ethnicity": 5,
        "cases_by_season": 5, "cases_by_date": 5, "rt": 1, "mobility": 1,
    }
    assert first["cases_by_season"].agg(F.sum("nc_sprng_2021")).first()[0] == pytest.approx(200, abs=0.05)
    # without raw input everything still comes from the folder
    again = AreaTables(spark, folder)
    full = again.full()
    assert full.count() == 5 and again.full(with_cases=False).count() == 5
    found = find_neighbours(unit_profile(full, "MSOA"), "MSOA11CD_APPX", "MSOA11NM_APPX", ["Space", "IMD"], nn=1)
    assert found.table.count() == 4
    again.export_csv("rt", str(tmp_path / "rt.csv"))
    assert read_csv(spark, str(tmp_path / "rt.csv")).count() == 1
    with pytest.raises(KeyError):
        AreaTables(spark, str(tmp_path / "empty"))["ages"]
