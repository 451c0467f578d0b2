"""The test tables in the roles of area tables, in Spark and in SQL.

Customers play small areas, nations and regions the levels above them, orders per customer
the population, order priorities its age bands, order status its groups, order values by
season the cases, suppliers the facilities, and user events the daily series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions import in_period, null_safe_sum, recode
from arealens.operators.relational import star_join
from arealens.plans.profile import ProfileSpec
from arealens.session import cut

from .registry import Tables

SEASONS = [
    ("spring_1997", "1997-03-01", "1997-06-01"),
    ("summer_1997", "1997-06-01", "1997-09-01"),
    ("autumn_1997", "1997-09-01", "1997-12-01"),
    ("winter_1997", "1996-12-01", "1997-02-01"),
    ("winter_1998", "1997-12-01", "1998-02-01"),
]
BANDS = {
    "pop_a": "1-URGENT",
    "pop_b": "2-HIGH",
    "pop_c": "3-MEDIUM",
    "pop_d": "4-NOT SPECIFIED",
    "pop_e": "5-LOW",
}
GROUPS = {"done": "F", "open": "O", "part": "P"}
CASES = {"nc_y1": ("1995-01-01", "1997-01-01"), "nc_y2": ("1997-01-01", "1999-01-01"), "nc_y3": ("1999-01-01", "2002-01-01")}
CODES = {"N03": "N60", "N04": "N60", "N05": "N60"}

SPEC = ProfileSpec(
    population="pop_all",
    population_parts=tuple(BANDS),
    means=("balance", "mean_price"),
    group_total="group_all",
    groups=tuple(GROUPS),
    cases=tuple(CASES),
    levels={"nation": ("nation_code", "nation_name"), "region": ("region_code", "region_name")},
)
FEATURES = {
    "age": [f"{b}_prop" for b in BANDS],
    "wealth": ["balance", "mean_price"],
    "space": ["area", "lati", "long", "pop_density"],
    "sizes": [*BANDS, "pop_all"],
    "status": [f"pop_{g}_prop" for g in GROUPS],
    "cases": [f"{c}_{kind}_rate" for c in CASES for kind in ("iqr", "q50")],
}


def order_summary(t: Tables) -> DataFrame:
    """Per customer: order counts by priority and status, mean value, value by period.

    The order table is read once and aggregated map-side.
    """
    day = F.col("o_orderdate").cast("date")
    one = F.lit(1)
    return t.orders.groupBy("o_custkey").agg(
        F.count(one).alias("pop_all"),
        *[F.count_if(F.col("o_orderpriority") == v).alias(c) for c, v in BANDS.items()],
        *[F.count_if(F.col("o_orderstatus") == v).alias(c) for c, v in GROUPS.items()],
        F.count("o_orderstatus").alias("group_all"),
        F.avg("o_totalprice").alias("mean_price"),
        *[
            null_safe_sum(F.when(in_period(day, *period), F.col("o_totalprice").cast("decimal(18,2)")))
            .cast("double")
            .alias(c)
            for c, period in CASES.items()
        ],
    )


def small_areas(t: Tables) -> DataFrame:
    """Star join of customers with their orders, nation and region."""
    return star_join(
        t.customer,
        (order_summary(t), {"c_custkey": "o_custkey"}),
        (t.nation, {"c_nationkey": "n_nationkey"}),
        (t.region, {"n_regionkey": "r_regionkey"}),
    ).select(
        F.col("c_custkey").alias("area_id"),
        F.col("c_name").alias("area_name"),
        F.col("c_nationkey").alias("nation_code"),
        F.col("n_name").alias("nation_name"),
        F.col("n_regionkey").alias("region_code"),
        F.col("r_name").alias("region_name"),
        (F.col("c_custkey") % 97 + 1).cast("double").alias("area"),
        F.col("c_acctbal").alias("lati"),
        (F.col("c_custkey") % 1009).cast("double").alias("long"),
        F.col("c_acctbal").alias("balance"),
        "mean_price",
        "pop_all",
        *BANDS,
        *GROUPS,
        "group_all",
        *CASES,
    )


SMALL_AREAS_SQL = f"""
order_summary as (
  select o_custkey, count(*) as pop_all,
    {", ".join(f"count(*) filter (o_orderpriority = '{v}') as {c}" for c, v in BANDS.items())},
    {", ".join(f"count(*) filter (o_orderstatus = '{v}') as {c}" for c, v in GROUPS.items())},
    count(o_orderstatus) as group_all, avg(o_totalprice) as mean_price,
    {", ".join(
        f"coalesce(sum(case when o_orderdate >= date '{a}' and o_orderdate < date '{b}'"
        f" then cast(o_totalprice as decimal(18,2)) end), 0)::double as {c}"
        for c, (a, b) in CASES.items())}
  from orders group by o_custkey),
small_areas as (
  select c_custkey as area_id, c_name as area_name, n_nationkey as nation_code,
    n_name as nation_name, r_regionkey as region_code, r_name as region_name,
    (c_custkey % 97 + 1)::double as area, c_acctbal as lati, (c_custkey % 1009)::double as long,
    c_acctbal as balance, order_summary.* exclude (o_custkey)
  from customer join order_summary on o_custkey = c_custkey
  join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)
"""


def profile_sql(level: str) -> str:
    """CTE ``profile`` at a level, on top of SMALL_AREAS_SQL."""
    code, name = SPEC.levels[level]
    sums = [SPEC.area, SPEC.population, *BANDS, *GROUPS, SPEC.group_total]
    cells = [f"sum({c}) as {c}" for c in sums]
    cells += [f"avg({c}) as {c}" for c in SPEC.means]
    cells += [f"quantile_cont({c}, 0.5) as {c}" for c in SPEC.place]
    cells += [f"quantile_cont({c}, 0.{q[1:]}) as {c}_{q}" for c in CASES for q in ("q25", "q50", "q75")]
    rates = [f"100000 * {c}_{q} / pop_all as {c}_{q}_rate" for c in CASES for q in ("q25", "q50", "q75")]
    spreads = [f"{c}_q75_rate - {c}_q25_rate as {c}_iqr_rate" for c in CASES]
    shares = [f"round_even(({b}::double / pop_all) * 1000, 0) / 1000 as {b}_prop" for b in BANDS]
    shares += [f"round_even(({g}::double / group_all) * 1000, 0) / 1000 as pop_{g}_prop" for g in GROUPS]
    return f"""
rolled as (select {code}, {name}, {", ".join(cells)} from small_areas group by {code}, {name}),
rated as (select *, {", ".join(rates)} from rolled),
profile as (select *, {", ".join(spreads)},
  round_even((pop_all / area) * 10, 0) / 10 as pop_density, {", ".join(shares)} from rated)
"""


def zscore_sql(table: str, ids: list[str], columns: list[str], name: str = "scaled") -> str:
    """CTE with standardised columns."""
    cells = [
        f"({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1) as {c}"
        for c in columns
    ]
    return f"{name} as (select {', '.join([*ids, *cells])} from {table})"


def knn_sql(table: str, id_col: str, columns: list[str], k: int, name: str = "near") -> str:
    """CTE (query_id, neighbour_id, rank, distance) with the row itself at rank 1."""
    squares = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in columns)
    return f"""
pairs as (select a.{id_col} as query_id, b.{id_col} as neighbour_id, sqrt({squares}) as distance
  from {table} a cross join {table} b),
{name} as (select * from (select query_id, neighbour_id,
    row_number() over (partition by query_id
      order by query_id <> neighbour_id, distance, neighbour_id)::int as rank, distance
  from pairs) where rank <= {k + 1})
"""


def nation_code(column: str):
    return F.concat(F.lit("N"), F.lpad(F.col(column).cast("string"), 2, "0"))


NATION_CODE_SQL = "'N' || lpad({}::varchar, 2, '0')"


def nation_cases(t: Tables) -> DataFrame:
    """(areaCode, date, newCasesBySpecimenDate): whole order values by nation and day."""
    located = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return located.groupBy(
        nation_code("c_nationkey").alias("areaCode"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(F.sum(F.floor("o_totalprice")).alias("newCasesBySpecimenDate"))


NATION_CASES_SQL = f"""
nation_cases as (
  select {NATION_CODE_SQL.format('c_nationkey')} as "areaCode", o_orderdate::date as date,
    sum(floor(o_totalprice)::bigint)::bigint as cases
  from orders join customer on c_custkey = o_custkey group by all)
"""


def customer_bridge(t: Tables) -> DataFrame:
    """(LSOA Code, LAD21CD, pop_all_ages): customers with their recoded nation and orders."""
    orders = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("pop_all_ages"))
    bridge = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("LSOA Code"),
        recode(nation_code("c_nationkey"), CODES).alias("LAD21CD"),
        "pop_all_ages",
    )
    # read for the children and for their parents' totals
    return cut(bridge)


def recode_sql(expression: str) -> str:
    cases = " ".join(f"when '{old}' then '{new}'" for old, new in CODES.items())
    return f"(case {expression} {cases} else {expression} end)"


CUSTOMER_BRIDGE_SQL = f"""
bridge as (
  select c_custkey as area, {recode_sql(NATION_CODE_SQL.format('c_nationkey'))} as code, count(*) as pop
  from customer join orders on o_custkey = c_custkey group by all)
"""


def season_sql(column: str) -> str:
    cases = " ".join(
        f"when {column} >= date '{a}' and {column} < date '{b}' then '{name}'" for name, a, b in SEASONS
    )
    return f"(case {cases} else 'other_season' end)"


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
