"""The area and district tables, built from the test tables in the shapes they expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.operators.relational import join_on
from arealens.operators.neighbours import knn
from arealens.operators.scaling import resolve_features
from arealens.plans import areas, control, districts
from arealens.session import cut
from arealens.sources import fixed

from .registry import Tables, query
from .views import BANDS, knn_sql, rounded, zscore_sql


def area_code(column: str):
    return F.concat(F.lit("E"), F.lpad(F.col(column).cast("string"), 8, "0"))


def area_sql(column: str) -> str:
    return f"'E' || lpad({column}::varchar, 8, '0')"


def trust_code(column: str):
    return F.concat(F.lit("T"), F.col(column).cast("string"))


# ---------------------------------------------------------------- areas and trusts
EXTRA = {"T7": "PC1", "T14": "PC2", "T21": "PC3"}


def trusts(t: Tables) -> DataFrame:
    """Trusts seen in order lines; some lack a postcode, a few of those are patched."""
    admissions = join_on(t.lineitem.select("l_suppkey"), t.supplier, {"l_suppkey": "s_suppkey"}).select(
        trust_code("l_suppkey").alias("areaCode"), F.col("s_name").alias("areaName")
    )
    code = F.concat(F.lit("PC"), F.col("s_suppkey").cast("string"))
    register = t.supplier.select(
        trust_code("s_suppkey").alias("area_code"),
        F.col("s_name").alias("area_name"),
        F.when(F.col("s_suppkey") % 7 != 0, code).alias("post_code"),
    )
    postcodes = t.supplier.select(
        code.alias("postcode"), F.col("s_acctbal").alias("latitude"), F.col("s_nationkey").cast("double").alias("longitude")
    )
    return areas.trust_locations(admissions, register, postcodes, EXTRA)


TRUSTS_SQL = f"""trusts as (
  select 'T' || s.s_suppkey as "areaCode", s.s_name as "areaName", p.s_acctbal as latitude, p.s_nationkey::double as longitude
  from (select *, coalesce(case when s_suppkey % 7 <> 0 then 'PC' || s_suppkey end,
      case 'T' || s_suppkey {" ".join(f"when '{k}' then '{v}'" for k, v in EXTRA.items())} end) as postcode
    from supplier where s_suppkey in (select l_suppkey from lineitem)) s
  left join supplier p on 'PC' || p.s_suppkey = postcode)"""


@query(f"with {TRUSTS_SQL} select * from trusts")
def trust_locations(t: Tables) -> DataFrame:
    """First row per trust, its postcode patched from a list, its coordinates by lookup."""
    return trusts(t)


def customer_locations(t: Tables) -> DataFrame:
    return t.customer.select(
        area_code("c_custkey").alias("lsoa11cd"),
        F.lit(1.0).alias("area"),
        F.col("c_acctbal").alias("lati"),
        F.col("c_nationkey").cast("double").alias("long"),
    )


TRUST_MAP_SQL = f"""{TRUSTS_SQL}, trust_map as (select lsoa11cd, "areaCode" as nhstrustcd, "areaName" as nhstrustnm from (
  select {area_sql('c_custkey')} as lsoa11cd, "areaCode", "areaName", row_number() over (partition by c_custkey
    order by sqrt((c_acctbal - latitude) ^ 2 + (c_nationkey - longitude) ^ 2), "areaCode") as rn
  from customer cross join trusts where latitude is not null) where rn = 1)"""


@query(f"with {TRUST_MAP_SQL} select * from trust_map")
def trust_of_every_area(t: Tables) -> DataFrame:
    """Nearest located trust of every area."""
    return areas.trust_map(customer_locations(t), trusts(t))


@query(
    f"""with {TRUST_MAP_SQL} select {area_sql('c_custkey')} as "LSOA11CD", c_name as "LSOA11NM", 'N' || c_nationkey as "LAD21CD", n_name as "LAD21NM",
      1.0::double as area, c_acctbal as lati, c_nationkey::double as long, 'R' || r_regionkey as "UTLA21CD", r_name as "UTLA21NM",
      nhstrustcd, nhstrustnm, c_name[:-2] as "MSOA11NM_APPX", md5(c_name[:-2])[:13] as "MSOA11CD_APPX"
    from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
    join trust_map on lsoa11cd = {area_sql('c_custkey')}"""
)
def spatial_lexicon(t: Tables) -> DataFrame:
    """Every area with all levels it belongs to, its place and its trust."""
    lookup = join_on(t.customer, t.nation, {"c_nationkey": "n_nationkey"}).select(
        F.lit(1).alias("FID"),
        area_code("c_custkey").alias("LSOA11CD"),
        F.col("c_name").alias("LSOA11NM"),
        F.lit("-").alias("CCG21CDH"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("LAD21CD"),
        F.col("n_name").alias("LAD21NM"),
    )
    upper = join_on(t.nation, t.region, {"n_regionkey": "r_regionkey"}).select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("LTLA21CD"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("UTLA21CD"),
        F.col("r_name").alias("UTLA21NM"),
    )
    locations = customer_locations(t)
    return areas.spatial_lexicon(lookup, locations, upper, areas.trust_map(locations, trusts(t)))


# ---------------------------------------------------------------- attribute tables
@query(
    f"""select count(*) as pop_all_ages, {", ".join(f"count(*) filter (o_orderpriority = '{v}') as {n}" for v, (_, n, _) in zip(BANDS.values(), fixed.AGE_BANDS))},
      round_even(({" + ".join(f"{m} * count(*) filter (o_orderpriority = '{v}')" for v, (_, _, m) in zip(BANDS.values(), fixed.AGE_BANDS))}) / count(*) * 100, 0) / 100 as approx_mean_age,
      {area_sql('o_custkey')} as "LSOA Code" from orders group by o_custkey"""
)
def age_table(t: Tables) -> DataFrame:
    """Bands and approximate mean age of every area."""
    raw = t.orders.groupBy(area_code("o_custkey").alias("LSOA Code")).agg(
        F.count(F.lit(1)).alias("All Ages"),
        *[F.count_if(F.col("o_orderpriority") == v).alias(s) for v, (s, _, _) in zip(BANDS.values(), fixed.AGE_BANDS)],
    )
    return areas.age_table(raw)


@query(
    f"""select {area_sql('c_custkey')} as "LSOA Code", (c_custkey % 10 + 1)::int as imd_full, (c_nationkey % 10 + 1)::int as imd_health,
      (length(c_mktsegment) % 10 + 1)::int as imd_employ, (floor(c_acctbal / 1000)::int) as imd_living from customer"""
)
def deprivation_table(t: Tables) -> DataFrame:
    """Long-named decile columns under short names."""
    values = [
        area_code("c_custkey"),
        (F.col("c_custkey") % 10 + 1).cast("int"),
        (F.col("c_nationkey") % 10 + 1).cast("int"),
        (F.length("c_mktsegment") % 10 + 1).cast("int"),
        F.floor(F.col("c_acctbal") / 1000).cast("int"),
    ]
    raw = t.customer.select(*[v.alias(name) for v, name in zip(values, fixed.IMD_COLUMNS)])
    return areas.deprivation_table(raw)


@query(
    f"""select {area_sql('o_custkey')} as "LSOA Code", {", ".join(f"count(*) filter (o_orderpriority = '{v}') as {g}" for v, g in zip(BANDS.values(), fixed.ETHNIC_GROUPS))},
      count(*) as eth_all from orders group by o_custkey"""
)
def ethnicity_table(t: Tables) -> DataFrame:
    """Groups summed over the census columns whose names say so."""
    name = fixed.ETHNICITY_TOTAL.replace("Ethnic Group: All categories: Ethnic group", "{}: Total")
    raw = t.orders.groupBy(area_code("o_custkey").alias("geography code")).agg(
        F.count(F.lit(1)).alias(fixed.ETHNICITY_TOTAL),
        *[
            F.count_if((F.col("o_orderpriority") == v) & (F.col("o_orderstatus") == s)).alias(
                name.format(prefix).replace(": Total", f"/{s}: Total")
            )
            for v, prefix in zip(BANDS.values(), fixed.ETHNIC_GROUPS.values())
            for s in ("F", "O", "P")
        ],
        F.lit("ignored").alias("Sex: Males; note"),
    )
    return areas.ethnicity_table(raw)


@query(
    """select c_nationkey as la_name, o_orderdate::date as date, round(avg(o_totalprice), 6) as "Rt" from orders join customer on c_custkey = o_custkey group by all"""
)
def rt_table(t: Tables) -> DataFrame:
    """Renamed and stripped of its interval columns."""
    raw = (
        join_on(t.orders, t.customer, {"o_custkey": "c_custkey"})
        .groupBy(F.col("c_nationkey").alias("area"), F.col("o_orderdate").alias("date"))
        .agg(F.avg("o_totalprice").alias("Rt"), F.min("o_totalprice").alias("CIlow"), F.max("o_totalprice").alias("CIup"))
        .withColumn("coverage", F.lit(0.9))
    )
    return rounded(areas.rt_table(raw), ["Rt"])


MOBILITY_SOURCE = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber", "l_partkey"]


@query(
    f"""with raw as (select l_returnflag as country, r_name as sub_region_1, l_shipdate::date as date,
        {", ".join(f"round(avg({c}), 6) as {n}" for c, n in zip(MOBILITY_SOURCE, fixed.MOBILITY_COLUMNS.values()))}
      from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by all)
    select date, {", ".join(fixed.MOBILITY_COLUMNS.values())}, case when n_nationkey % 4 > 0 then 'E' || n_nationkey end as lad19cd, n_name as la_name
    from raw join nation on r_name_of = sub_region_1 where country = 'R' and date >= date '1997-06-01' and n_nationkey % 4 > 0""".replace(
        "join nation on r_name_of = sub_region_1", "join (select n_nationkey, n_name, r_name from nation join region on r_regionkey = n_regionkey) n on r_name = sub_region_1"
    )
)
def mobility_table(t: Tables) -> DataFrame:
    """Filtered by country and date, then one region's row for each of its areas."""
    regions = join_on(t.nation, t.region, {"n_regionkey": "r_regionkey"})
    raw = (
        join_on(
            join_on(t.lineitem, t.supplier.select("s_suppkey", "s_nationkey"), {"l_suppkey": "s_suppkey"}),
            regions.select("n_nationkey", "r_name"),
            {"s_nationkey": "n_nationkey"},
        )
        .groupBy(
            F.col("l_returnflag").alias("country_region_code"),
            F.col("r_name").alias("sub_region_1"),
            F.col("l_shipdate").cast("date").alias("date"),
        )
        .agg(*[F.avg(c).alias(n) for c, n in zip(MOBILITY_SOURCE, fixed.MOBILITY_COLUMNS)])
    )
    lookup = regions.select(
        F.col("r_name").alias("sub_region_1"),
        F.when(F.col("n_nationkey") % 4 > 0, F.concat(F.lit("E"), F.col("n_nationkey").cast("string"))).alias("lad19cd"),
        F.col("n_name").alias("la_name"),
    )
    table = areas.mobility_table(raw, lookup, country="R", start="1997-06-01", prefix="E")
    return rounded(table, list(fixed.MOBILITY_COLUMNS.values()))


@query(
    f"""with b as (select o_custkey, count(*) as pop from orders group by 1)
    select {area_sql('c_custkey')} as "LSOA Code", (c_custkey % 10 + 1)::int as imd_full, pop as pop_all_ages, n_name as "LAD21NM", done, pop - done as rest
    from customer join b on o_custkey = c_custkey join nation on n_nationkey = c_nationkey
    join (select o_custkey as k, count(*) filter (o_orderstatus = 'F') as done from orders group by 1) on k = c_custkey"""
)
def joined_area_table(t: Tables) -> DataFrame:
    """Star join of deprivation, age, place and group tables on the area code."""
    imd = t.customer.select(area_code("c_custkey").alias("LSOA Code"), (F.col("c_custkey") % 10 + 1).cast("int").alias("imd_full"))
    by_area = t.orders.groupBy(area_code("o_custkey").alias("LSOA Code"))
    ages = by_area.agg(F.count(F.lit(1)).alias("pop_all_ages"))
    place = join_on(t.customer, t.nation, {"c_nationkey": "n_nationkey"}).select(
        area_code("c_custkey").alias("LSOA11CD"), F.col("n_name").alias("LAD21NM")
    )
    status = F.col("o_orderstatus") == "F"
    groups = by_area.agg(F.count_if(status).alias("done"), F.count_if(~status).alias("rest"))
    return areas.full_area_table(imd, ages, place, groups)


# ---------------------------------------------------------------- districts
def district_population(t: Tables) -> DataFrame:
    """Orders per customer segment and nation, by an age made from the order key."""
    age = F.concat(F.lit("age_"), (F.col("o_orderkey") % 90).cast("string"))
    column = F.when(F.col("o_orderkey") % 91 == 90, F.lit(districts.OLDEST)).otherwise(age)
    counted = (
        join_on(t.orders, t.customer, {"o_custkey": "c_custkey"})
        .withColumn("age", column)
        .groupBy(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("Code"), F.col("c_nationkey").alias("parent"))
        .pivot("age", [*districts.AGES, districts.OLDEST])
        .count()
    )
    return counted.withColumns({"Name": F.col("Code"), "Geography1": F.lit("District")})


DISTRICT_ORDERS_SQL = """d as (select c_nationkey || '-' || c_mktsegment as code, c_nationkey, case when o_orderkey % 91 = 90 then 90 else o_orderkey % 90 end as age
  from orders join customer on c_custkey = o_custkey)"""
BANDS_SQL = """count(*) filter (age < 16) as pop_00_15, count(*) filter (age between 16 and 75) as pop_16_75, count(*) filter (age > 75) as pop_76_90,
  count(*) as pop_total, round(count(*) filter (age < 16) / count(*), 6) as pop_00_15_prop, round(count(*) filter (age between 16 and 75) / count(*), 6) as pop_16_75_prop,
  round(count(*) filter (age > 75) / count(*), 6) as pop_76_90_prop, round(coalesce(sum(age + 1) filter (age < 90), 0) / count(*), 6) as age_mean"""
BAND_MEASURES = ["pop_00_15_prop", "pop_16_75_prop", "pop_76_90_prop", "age_mean"]


@query(f"""with {DISTRICT_ORDERS_SQL} select code as "Code", {BANDS_SQL} from d group by 1""")
def lower_tier_population(t: Tables) -> DataFrame:
    """Three bands, shares and mean age from 91 single-year columns."""
    table = districts.population_bands(district_population(t)).select("Code", *districts.POPULATION_COLUMNS)
    return rounded(table, BAND_MEASURES)


@query(
    f"""with {DISTRICT_ORDERS_SQL} select c_nationkey::varchar as utla19cd, n_name as utla19nm, {BANDS_SQL} from d join nation on n_nationkey = c_nationkey group by 1, 2"""
)
def upper_tier_population(t: Tables) -> DataFrame:
    """Every single-year column summed to the upper tier, then banded."""
    population = district_population(t)
    lookup = join_on(population.select("Code", "parent"), t.nation, {"parent": "n_nationkey"}).select(
        F.col("Code").alias("ltla19cd"), F.col("parent").cast("string").alias("utla19cd"), F.col("n_name").alias("utla19nm")
    )
    summed = districts.upper_tier_population(population.drop("parent"), lookup)
    table = districts.population_bands(summed).select("utla19cd", "utla19nm", *districts.POPULATION_COLUMNS)
    return rounded(table, BAND_MEASURES)


def deprivation_domains(t: Tables) -> list[DataFrame]:
    """Three score tables by segment and nation, in the shape of the published sheets."""
    sheets = {}
    for i, (sheet, (title, _)) in enumerate(fixed.DEPRIVATION_SHEETS.items(), start=1):
        sheets[sheet] = t.customer.groupBy(
            F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("Local Authority District code (2019)")
        ).agg(
            (F.avg("c_acctbal") * i).alias(f"{title} - Average score "),
            F.avg(F.when(F.col("c_acctbal") < 1000 * i, 1.0).otherwise(0.0)).alias(
                f"{title} - Proportion of LSOAs in most deprived 10% nationally "
            ),
        )
    return districts.deprivation_sheets(sheets)


DOMAIN_SQL = ", ".join(
    f"avg(c_acctbal) * {i} as {s}_average_score, avg(case when c_acctbal < {1000 * i} then 1.0 else 0.0 end) as {s}_prop_lsoa_10perc"
    for i, (_, s) in enumerate(fixed.DEPRIVATION_SHEETS.values(), start=1)
)
SCORES = [f"{s}_{m}" for _, s in fixed.DEPRIVATION_SHEETS.values() for m in ("average_score", "prop_lsoa_10perc")]
DISTRICTS_SQL = f"domains as (select c_nationkey || '-' || c_mktsegment as code, c_nationkey, count(*) as w, {DOMAIN_SQL} from customer group by all)"


@query(f"with {DISTRICTS_SQL} select code as lad_cd_19, {', '.join(f'round({s}, 5) as {s}' for s in SCORES)} from domains")
def lower_tier_deprivation(t: Tables) -> DataFrame:
    """Three score tables joined per district."""
    return rounded(districts.lower_tier_deprivation(deprivation_domains(t)), SCORES, 5)


@query(
    f"with {DISTRICTS_SQL} select c_nationkey::varchar as utla19cd, {', '.join(f'round(sum({s} * w) / sum(w), 5) as {s}' for s in SCORES)} from domains group by 1"
)
def upper_tier_deprivation(t: Tables) -> DataFrame:
    """Population-weighted scores one tier up."""
    by_district = t.customer.groupBy(
        F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("Code"), F.col("c_nationkey").cast("string").alias("utla19cd")
    ).agg(F.count(F.lit(1)).alias("All ages"))
    lookup = by_district.select(F.col("Code").alias("ltla19cd"), "utla19cd")
    table = districts.upper_tier_deprivation(deprivation_domains(t), lookup, by_district)
    return rounded(table, SCORES, 5)


@query(
    """select c_nationkey as utla19cd, n_name as utla19nm, round(avg(long), 6) as long, round(avg(lat), 6) as lat, sum(a)::bigint as st_areashape from
      (select c_nationkey, c_mktsegment, avg(c_acctbal) as long, avg(c_custkey) as lat, count(*) as a from customer group by all)
    join nation on n_nationkey = c_nationkey group by all"""
)
def upper_tier_location(t: Tables) -> DataFrame:
    """Mean coordinates and summed area one tier up."""
    location = t.customer.groupBy(
        F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("lad19cd"), "c_nationkey"
    ).agg(F.avg("c_acctbal").alias("long"), F.avg("c_custkey").alias("lat"), F.count(F.lit(1)).alias("st_areashape"))
    lookup = join_on(location.select("lad19cd", "c_nationkey"), t.nation, {"c_nationkey": "n_nationkey"}).select(
        F.col("lad19cd").alias("ltla19cd"), F.col("c_nationkey").alias("utla19cd"), F.col("n_name").alias("utla19nm")
    )
    table = districts.upper_tier_location(location.drop("c_nationkey"), lookup)
    return rounded(table, ["long", "lat"])


DISTRICT_SPACE = resolve_features(["age", "deprivation", "spatial"], fixed.DISTRICT_FEATURE_GROUPS)


@query(
    f"""with {DISTRICT_ORDERS_SQL}, {DISTRICTS_SQL},
    pop as (select code, count(*) as pop_total, count(*) filter (age < 16) / count(*) as pop_00_15_prop, count(*) filter (age between 16 and 75) / count(*) as pop_16_75_prop,
      count(*) filter (age > 75) / count(*) as pop_76_90_prop, coalesce(sum(age + 1) filter (age < 90), 0) / count(*) as age_mean from d group by 1),
    place as (select c_nationkey || '-' || c_mktsegment as code, avg(c_acctbal) as long, avg(c_custkey) as lat, count(*) * 1e6::double as st_areashape from customer group by 1),
    whole as (select *, pop_total / (st_areashape / 1e6) as pop_density from pop join domains using (code) join place using (code)),
    {zscore_sql('whole', ['code'], DISTRICT_SPACE, 'plain')},
    scaled as (select code, {", ".join(f"{c} * {fixed.DISTRICT_WEIGHTS.get(c, 1.0)} as {c}" for c in DISTRICT_SPACE)} from plain),
    {knn_sql('scaled', 'code', DISTRICT_SPACE, 5)}
    select query_id, neighbour_id, rank, round(distance, 6) as distance from near"""
)
def district_neighbours(t: Tables) -> DataFrame:
    """Districts matched on age, deprivation and space, with some features halved."""
    location = t.customer.groupBy(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("lad19cd")).agg(
        F.avg("c_acctbal").alias("long"),
        F.avg("c_custkey").alias("lat"),
        (F.count(F.lit(1)) * 1e6).alias("st_areashape"),
    )
    bands = districts.population_bands(district_population(t))
    table = cut(
        districts.lower_tier_table(location, bands, districts.lower_tier_deprivation(deprivation_domains(t)))
    )
    space = districts.scaled_district_space(table, "lad19cd")
    return rounded(knn(space, "lad19cd", DISTRICT_SPACE, 5), ["distance"])


@query(
    f"""with {DISTRICT_ORDERS_SQL}, {DISTRICTS_SQL},
    pop as (select c_nationkey, count(*) as pop_total, count(*) filter (age < 16) / count(*) as pop_00_15_prop, count(*) filter (age between 16 and 75) / count(*) as pop_16_75_prop,
      count(*) filter (age > 75) / count(*) as pop_76_90_prop, coalesce(sum(age + 1) filter (age < 90), 0) / count(*) as age_mean from d group by 1),
    place as (select c_nationkey, avg(long) as long, avg(lat) as lat, sum(a) as st_areashape from
      (select c_nationkey, c_mktsegment, avg(c_acctbal) as long, avg(c_custkey) as lat, count(*) * 1e6::double as a from customer group by all) group by 1),
    score as (select c_nationkey, {', '.join(f'sum({s} * w) / sum(w) as {s}' for s in SCORES)} from domains group by 1),
    whole as (select *, c_nationkey::varchar as code, pop_total / (st_areashape / 1e6) as pop_density from pop join score using (c_nationkey) join place using (c_nationkey)),
    {zscore_sql('whole', ['code'], DISTRICT_SPACE, 'plain')},
    scaled as (select code, {", ".join(f"{c} * {fixed.DISTRICT_WEIGHTS.get(c, 1.0)} as {c}" for c in DISTRICT_SPACE)} from plain),
    {knn_sql('scaled', 'code', DISTRICT_SPACE, 5)}
    select query_id, neighbour_id, rank, round(distance, 6) as distance from near"""
)
def upper_tier_neighbours(t: Tables) -> DataFrame:
    """Upper-tier units matched on age, deprivation and space, with some features halved."""
    segment = F.concat_ws("-", "c_nationkey", "c_mktsegment")
    by_district = t.customer.groupBy(segment.alias("Code"), F.col("c_nationkey").alias("parent")).agg(
        F.avg("c_acctbal").alias("long"), F.avg("c_custkey").alias("lat"), F.count(F.lit(1)).alias("All ages")
    )
    lookup = join_on(by_district.select("Code", "parent"), t.nation, {"parent": "n_nationkey"}).select(
        F.col("Code").alias("ltla19cd"), F.col("parent").cast("string").alias("utla19cd"), F.col("n_name").alias("utla19nm")
    )
    location = by_district.select(
        F.col("Code").alias("lad19cd"), "long", "lat", (F.col("All ages") * 1e6).alias("st_areashape")
    )
    population = districts.population_bands(
        districts.upper_tier_population(district_population(t).drop("parent"), lookup)
    )
    deprivation = districts.upper_tier_deprivation(
        deprivation_domains(t), lookup.select("ltla19cd", "utla19cd"), by_district.select("Code", "All ages")
    )
    table = cut(districts.upper_tier_table(districts.upper_tier_location(location, lookup), population, deprivation))
    space = districts.scaled_district_space(table, "utla19cd")
    return rounded(knn(space, "utla19cd", DISTRICT_SPACE, 5), ["distance"])


# ---------------------------------------------------------------- control from the district files
LEFT_OUT = ["E1-BUILDING", "E2-MACHINERY"]


def country_code():
    """District codes of two countries; every fifth nation is in the second."""
    country = F.when(F.col("c_nationkey") % 5 == 0, F.lit("W")).otherwise(F.lit("E"))
    return F.concat(country, F.concat_ws("-", "c_nationkey", "c_mktsegment"))


def district_files(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases per day, location and population, in the shape of the published files."""
    located = join_on(t.orders, t.customer, {"o_custkey": "c_custkey"}).withColumn("code", country_code())
    cases = (
        located.groupBy("code", F.col("o_orderdate").cast("date").alias("Specimen date"))
        .agg(F.count(F.lit(1)).alias("Daily lab-confirmed cases"))
        .select(F.col("code").alias("Area code"), F.lit("ltla").alias("Area type"), "Specimen date", "Daily lab-confirmed cases")
    )
    location = t.customer.groupBy(country_code().alias("lad19cd")).agg(
        F.avg("c_acctbal").alias("long"), F.avg("c_custkey").alias("lat"), (F.count(F.lit(1)) * 1e6).alias("st_areashape")
    )
    country = F.when(F.col("parent") % 5 == 0, F.lit("W")).otherwise(F.lit("E"))
    population = district_population(t).withColumn("Code", F.concat(country, "Code"))
    return cases, location, districts.population_bands(population)


@query(
    f"""with {DISTRICT_ORDERS_SQL},
    pop as (select (case when c_nationkey % 5 = 0 then 'W' else 'E' end) || code as unit, {BANDS_SQL} from d group by 1),
    place as (select (case when c_nationkey % 5 = 0 then 'W' else 'E' end) || c_nationkey || '-' || c_mktsegment as unit, avg(c_acctbal) as long, avg(c_custkey) as lat, count(*) as a from customer group by 1)
    select unit, round(lat, 6) as lat, round(long, 6) as long, pop_total, pop_00_15_prop, age_mean, round(pop_total / a, 6) as pop_density
    from pop join place using (unit) where unit like 'E%' and unit not in ({', '.join(f"'{u}'" for u in LEFT_OUT)})"""
)
def donor_table_of_districts(t: Tables) -> DataFrame:
    """The districts a control may be built from, straight from the location and population files."""
    _, location, population = district_files(t)
    table = control.district_places(location, population, "E", LEFT_OUT)
    kept = table.select("unit", "lat", "long", "pop_total", "pop_00_15_prop", "age_mean", "pop_density")
    return rounded(kept, ["lat", "long", "pop_00_15_prop", "age_mean", "pop_density"])


@query(
    f"""select distinct 'E' || c_nationkey || '-' || c_mktsegment as target, true as exact, true as apart
    from customer join orders on o_custkey = c_custkey where c_nationkey = 3"""
)
def control_from_district_files(t: Tables) -> DataFrame:
    """Every district of one nation as a target, months of all years merged: fits meet the
    optimality conditions and no donor is a near, foreign or listed district."""
    cases, location, population = (cut(part) for part in district_files(t))
    places = cut(control.district_places(location, population, "E", LEFT_OUT))
    targets = places.filter(F.col("unit").startswith("E3-")).select("unit")
    fitted = control.district_control(
        cases, location, population, targets, "E", LEFT_OUT, "1993-01-01",
        exclude=5, months_of_year=[1, 5, 6, 7, 8, 9, 10, 11, 12], l1_ratios=(0.1, 0.5, 0.9), n_alphas=21, folds=5,
    )
    near = knn(targets.join(places, "unit"), "unit", ["lat", "long"], 6, places, "unit", ["lat", "long"])
    barred = near.select(F.col("query_id").alias("target"), F.col("neighbour_id").alias("donor"), F.lit(True).alias("_near"))
    known = places.select(F.col("unit").alias("donor"), F.lit(True).alias("_known"))
    donors = fitted.donors.join(barred, ["target", "donor"], "left").join(known, "donor", "left")
    apart = donors.groupBy("target").agg(F.bool_and(F.col("_near").isNull() & F.col("_known").isNotNull()).alias("apart"))
    exact = F.when(F.col("status") == "fitted", F.coalesce((F.col("kkt") < 1e-7) & ~F.col("capped"), F.lit(False)))
    judged = fitted.status.select("target", exact.otherwise(F.col("status") == "no weight").alias("exact"))
    return judged.join(apart, "target", "left").select("target", "exact", F.coalesce("apart", F.lit(True)).alias("apart"))
