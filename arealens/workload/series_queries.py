"""Series, allocation, nearest facility, polygons and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions import recode
from arealens.operators.allocation import allocate_to_children
from arealens.operators.density import kde
from arealens.operators.globe import nearest_on_globe
from arealens.operators.intervals import interval_join, label_by_interval, overlapping
from arealens.operators.relational import join_on, only_in, sample_units
from arealens.operators.series import complete_days, daily_totals, features_long, monthly_features, rolling_mean, rolling_rate
from arealens.operators.spatial import nearest_facility, polygon_measures
from arealens.plans.areas import seasonal_cases, seasonal_cases_wide

from .registry import Tables, query
from .views import (
    CODES,
    CUSTOMER_BRIDGE_SQL,
    NATION_CASES_SQL,
    SEASONS,
    customer_bridge,
    nation_cases,
    nation_code,
    recode_sql,
    rounded,
    season_sql,
)

DAILY_EVENTS_SQL = "daily as (select user_id, ts::date as date, count(*) as value from events group by all)"
FRAME = "rows between 6 preceding and current row"


@query(
    f"""with {DAILY_EVENTS_SQL} select user_id, date, value,
      case when count(value) over w = 7 then round(avg(value) over w, 6) end as rolling
    from daily window w as (partition by user_id order by date {FRAME})"""
)
def rolling_week_per_user(t: Tables) -> DataFrame:
    """Seven-row trailing mean; null until seven rows are there."""
    daily = daily_totals(t.events, "user_id", "ts")
    return rounded(rolling_mean(daily, "user_id", "date", "value", "rolling"), ["rolling"])


NATION_RATES_SQL = f"""seen as (select c_nationkey as unit, o_orderdate::date as date, count(*) as cases
    from orders join customer on c_custkey = o_custkey group by all),
  days as (select unnest(generate_series(min(date), max(date), interval 1 day))::date as date from seen),
  daily as (select unit, date, coalesce(cases, 0) as cases
    from (select distinct unit from seen) cross join days left join seen using (unit, date)),
  pop as (select c_nationkey as code, count(*) as pop_total from customer group by 1),
  rated as (select unit, date, cases, pop_total, case when count(cases) over w = 7 then avg(cases) over w end as rolling_mean
    from daily join pop on code = unit window w as (partition by unit order by date {FRAME})),
  rates as (select *, 100000 * rolling_mean / pop_total as rolling_rate from rated where date >= date '1996-01-01')"""


def nation_rates(t: Tables) -> DataFrame:
    """Rolling order rate per 100k customers by nation and day."""
    located = join_on(t.orders, t.customer.select("c_custkey", F.col("c_nationkey").alias("unit")), {"o_custkey": "c_custkey"})
    daily = complete_days(daily_totals(located, "unit", "o_orderdate", name="cases"), "unit", "cases")
    population = t.customer.groupBy(F.col("c_nationkey").alias("code")).agg(F.count(F.lit(1)).alias("pop_total"))
    return rolling_rate(daily, population, {"unit": "code"}, "date", "cases", "pop_total", start="1996-01-01")


@query(
    f"""with {NATION_RATES_SQL} select unit, date, cases, pop_total, round(rolling_mean, 6) as rolling_mean,
      round(rolling_rate, 4) as rolling_rate from rates"""
)
def rolling_rates_by_nation(t: Tables) -> DataFrame:
    return rounded(rounded(nation_rates(t), ["rolling_mean"]), ["rolling_rate"], 4)


@query(
    f"""with {NATION_RATES_SQL}, monthly as (select unit, date_trunc('month', date)::date as month,
      quantile_cont(rolling_rate, 0.25) as rolling_rate_q25, quantile_cont(rolling_rate, 0.5) as rolling_rate_q50,
      quantile_cont(rolling_rate, 0.75) as rolling_rate_q75, avg(rolling_rate) as rolling_rate_mean
    from rates group by all)
    select unit, month, round(rolling_rate_q25, 4) as rolling_rate_q25, round(rolling_rate_q50, 4) as rolling_rate_q50,
      round(rolling_rate_q75, 4) as rolling_rate_q75, round(rolling_rate_mean, 4) as rolling_rate_mean from monthly"""
)
def monthly_rate_features(t: Tables) -> DataFrame:
    """Quartiles and mean of the rolling rate per nation and calendar month."""
    monthly = monthly_features(nation_rates(t), "unit", "date", "rolling_rate", with_mean=True)
    return rounded(monthly, [c for c in monthly.columns if c.startswith("rolling")], 4)


@query(
    f"""with {NATION_RATES_SQL}, monthly as (select unit, month(date)::int as month,
      quantile_cont(rolling_rate, 0.25) as rolling_rate_q25, quantile_cont(rolling_rate, 0.75) as rolling_rate_q75
    from rates where month(date) > 4 or month(date) = 1 group by all)
    select unit, month, feature, round(value, 4) as value from
      (unpivot monthly on rolling_rate_q25, rolling_rate_q75 into name feature value value)"""
)
def month_of_year_features(t: Tables) -> DataFrame:
    """Quartiles by month of the year, merged over years, in long format."""
    monthly = monthly_features(
        nation_rates(t), "unit", "date", "rolling_rate", {"q25": 0.25, "q75": 0.75}, month_of_year=True
    ).filter((F.col("month") > 4) | (F.col("month") == 1))
    return rounded(features_long(monthly, "unit", ["rolling_rate_q25", "rolling_rate_q75"]), ["value"], 4)


@query(
    f"""with {NATION_RATES_SQL}, shown as (select unit from (select distinct unit from rates) order by md5(unit::varchar || ':4'), unit limit 12)
    select unit, date, round(rolling_rate, 4) as rolling_rate from rates where unit in (from shown)"""
)
def background_trajectories(t: Tables) -> DataFrame:
    """Observed series of a seeded sample of nations."""
    rates = nation_rates(t)
    shown = only_in(rates, sample_units(rates, "unit", 12, 4), "unit")
    return rounded(shown.select("unit", "date", "rolling_rate"), ["rolling_rate"], 4)


# ---------------------------------------------------------------- allocation
@query(
    f"""with {CUSTOMER_BRIDGE_SQL}, totals as (select {recode_sql("'N' || lpad(s_nationkey::varchar, 2, '0')")} as code,
      sum(l_linenumber)::bigint as amount from lineitem join supplier on s_suppkey = l_suppkey group by 1)
    select area, code, round_even((amount * pop / sum(pop) over (partition by code) * 100)::double, 0) / 100 as share
    from bridge join totals using (code)"""
)
def parent_totals_to_children(t: Tables) -> DataFrame:
    """Supplier totals per nation, spread over its customers by orders."""
    totals = (
        join_on(t.lineitem.select("l_suppkey", "l_linenumber"), t.supplier, {"l_suppkey": "s_suppkey"})
        .groupBy(recode(nation_code("s_nationkey"), CODES).alias("code"))
        .agg(F.sum("l_linenumber").alias("amount"))
    )
    bridge = customer_bridge(t).toDF("area", "code", "pop")
    spread = allocate_to_children(totals, bridge, "code", "amount", "pop", "share")
    return spread.select("area", "code", "share")


CASES_LONG_SQL = f"""{NATION_CASES_SQL}, {CUSTOMER_BRIDGE_SQL},
  kept as (select {recode_sql('"areaCode"')} as code, {season_sql('date')} as season, date, cases from nation_cases),
  totals as (select code, {{grain}}, sum(cases)::bigint as cases from kept where season not like 'other%' group by all),
  parents as (select code, sum(pop)::bigint as parent_pop from bridge group by 1),
  spread as (select area, {{grain}}, round_even(((cases * pop)::double / parent_pop) * 100, 0) / 100 as approx_lsoa_cases
    from totals join bridge using (code) join parents using (code))"""


@query(
    f"""with {CASES_LONG_SQL.format(grain='season')}
    select area as "LSOA Code", {", ".join(f"max(approx_lsoa_cases) filter (season = '{s}') as {s}" for s, _, _ in SEASONS)}
    from spread group by 1"""
)
def seasonal_cases_per_area(t: Tables) -> DataFrame:
    """Recode, bucket by season, total, spread by population, pivot."""
    long = seasonal_cases(nation_cases(t), customer_bridge(t), prefix="N", seasons=SEASONS, codes=CODES)
    return seasonal_cases_wide(long, {s: s for s, _, _ in SEASONS})


@query(
    f"""with {CASES_LONG_SQL.format(grain='date')} select area as "LSOA Code", date, approx_lsoa_cases from spread"""
)
def daily_cases_per_area(t: Tables) -> DataFrame:
    """The same at daily grain, kept long."""
    return seasonal_cases(nation_cases(t), customer_bridge(t), "date", prefix="N", seasons=SEASONS, codes=CODES)


# ---------------------------------------------------------------- intervals
PROMOTIONS_SQL = """promotions as (select p_partkey as promotion, date '1992-01-01' + (3 * (p_partkey % 1500))::int as start,
  date '1992-01-01' + (3 * (p_partkey % 1500) + 1 + p_partkey % 40)::int as "end" from part)"""


def promotions(t: Tables) -> DataFrame:
    """Every part on offer for some days: many intervals of several lengths, overlapping freely."""
    first = (3 * (F.col("p_partkey") % 1500)).cast("int")
    origin = F.lit("1992-01-01").cast("date")
    return t.part.select(
        F.col("p_partkey").alias("promotion"),
        F.date_add(origin, first).alias("start"),
        F.date_add(origin, (first + 1 + F.col("p_partkey") % 40).cast("int")).alias("end"),
    )


@query(
    f"""with {PROMOTIONS_SQL} select promotion, count(*) as orders, round(sum(o_totalprice), 2) as total
    from promotions join orders on o_orderdate::date >= start and o_orderdate::date < "end" group by 1"""
)
def orders_in_promotions(t: Tables) -> DataFrame:
    """Orders placed while each part is on offer: an interval join of two tables of any size."""
    orders = t.orders.select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    daily = orders.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))
    met = interval_join(daily, "day", promotions(t))
    found = met.groupBy("promotion").agg(F.sum("n").alias("orders"), F.sum("price").cast("double").alias("total"))
    return rounded(found, ["total"], 2)


@query(
    f"""select {season_sql('o_orderdate::date')} as season, o_orderpriority, count(*) as orders from orders group by all"""
)
def seasons_from_a_table(t: Tables) -> DataFrame:
    """Seasons as rows of a table, checked for overlaps and looked up by a range join."""
    seasons = t.spark.createDataFrame(SEASONS, "season string, start string, end string")
    seasons = seasons.select(F.col("season").alias("name"), F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    orders = t.orders.select(F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    named = label_by_interval(orders, "day", seasons, "name", "season", other="other_season")
    return named.groupBy("season", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query(
    f"""with {PROMOTIONS_SQL}, few as (select * from promotions where promotion % 40 < 6)
    select distinct a.promotion as first, b.promotion as second from few a join few b
      on a.promotion <> b.promotion and b.start >= a.start and b.start < a."end" """
)
def overlapping_promotions(t: Tables) -> DataFrame:
    """Offers of up to six days, that start while another runs."""
    few = promotions(t).where(F.col("promotion") % 40 < 6)
    return overlapping(few, "promotion")


# ---------------------------------------------------------------- space
GLOBE_SQL = """c as (select c_custkey, (c_acctbal + 1000) * 180 / 11000 - 90 as lat, ((c_custkey * 7919) % 36000) / 100.0::double - 180 as long from customer),
  s as (select s_suppkey, s_name, (s_acctbal + 1000) * 180 / 11000 - 90 as lat, ((s_suppkey * 10007) % 36000) / 100.0::double - 180 as long from supplier),
  d as (select c_custkey, s_suppkey, s_name, 2 * 6371.0088 * asin(sqrt(sin(radians(s.lat - c.lat) / 2) ^ 2
    + cos(radians(c.lat)) * cos(radians(s.lat)) * sin(radians(s.long - c.long) / 2) ^ 2)) as km from c, s)"""


@query(
    f"""with {GLOBE_SQL} select c_custkey, s_suppkey, s_name, round(km, 6) as distance_km from
      (select *, row_number() over (partition by c_custkey order by km, s_suppkey) as rn from d) where rn = 1"""
)
def nearest_supplier_on_the_globe(t: Tables) -> DataFrame:
    """Closest supplier of every customer by great circle, poles and antimeridian included."""

    def place(key: str, balance: str, step: int) -> list:
        lat = (F.col(balance) + 1000) * 180 / 11000 - 90
        return [lat.alias("lat"), (((F.col(key) * step) % 36000) / 100.0 - 180).alias("long")]

    customers = t.customer.select("c_custkey", *place("c_custkey", "c_acctbal", 7919))
    suppliers = t.supplier.select("s_suppkey", "s_name", *place("s_suppkey", "s_acctbal", 10007))
    found = nearest_on_globe(customers, "c_custkey", ["lat", "long"], suppliers, "s_suppkey", ["lat", "long"], carry=["s_name"], most=8)
    return rounded(found, ["distance_km"])


@query(
    """select c_custkey, s_suppkey, s_name, round(distance, 6) as distance from (
      select c_custkey, s_suppkey, s_name, sqrt((c_acctbal - s_acctbal) ^ 2 + (c_nationkey - s_nationkey) ^ 2) as distance,
        row_number() over (partition by c_custkey order by sqrt((c_acctbal - s_acctbal) ^ 2 + (c_nationkey - s_nationkey) ^ 2), s_suppkey) as rn
      from customer cross join supplier where s_acctbal is not null) where rn = 1"""
)
def nearest_supplier(t: Tables) -> DataFrame:
    """Closest supplier of every customer."""
    found = nearest_facility(
        t.customer,
        "c_custkey",
        ["c_acctbal", "c_nationkey"],
        t.supplier,
        "s_suppkey",
        ["s_acctbal", "s_nationkey"],
        carry=["s_name"],
    )
    return rounded(found, ["distance"])


@query(
    """with v as (select o_custkey as unit, o_orderpriority as ring, o_orderkey as seq, o_totalprice / 1000 as x, date_diff('day', date '1995-01-01', o_orderdate::date) as y from orders),
    e as (select unit, x, y, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2
      from v window w as (partition by unit, ring order by seq)),
    s as (select unit, sum(x * y2 - x2 * y) as c from e group by 1)
    select unit, round(abs(c) / 2, 6) as area from s"""
)
def polygon_areas(t: Tables) -> DataFrame:
    """Areas of rings made of each customer's orders; most rings span several chunks."""
    vertices = t.orders.select(
        F.col("o_custkey").alias("unit"),
        F.col("o_orderpriority").alias("ring"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_totalprice") / 1000).alias("x"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("y"),
    )
    return rounded(polygon_measures(vertices, "unit", chunk=2000).select("unit", "area"), ["area"])


@query(
    """with p as (select c_custkey as unit, unnest([[0, 0, 0], [1, 4, 0], [2, 4, 2], [3, 0, 2]]) as c, c_acctbal as x0, c_nationkey as y0 from customer),
    v as (select unit, c[1] as seq, x0 + c[2] as x, y0 + c[3] as y from p),
    e as (select unit, x, y, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2
      from v window w as (partition by unit order by seq)),
    s as (select unit, sum(x * y2 - x2 * y) as c, sum((x + x2) * (x * y2 - x2 * y)) as mx, sum((y + y2) * (x * y2 - x2 * y)) as my from e group by 1)
    select unit, round(abs(c) / 2, 4) as area, round(mx / (3 * c), 3) as centroid_x, round(my / (3 * c), 3) as centroid_y from s"""
)
def polygon_centroids(t: Tables) -> DataFrame:
    """Area and centroid of a rectangle around every customer."""
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, x, y in ((0, 0, 0), (1, 4, 0), (2, 4, 2), (3, 0, 2))])
    vertices = t.customer.withColumn("c", F.explode(corners)).select(
        F.col("c_custkey").alias("unit"),
        F.lit(1).alias("ring"),
        F.col("c.i").alias("seq"),
        (F.col("c_acctbal") + F.col("c.x")).alias("x"),
        (F.col("c_nationkey") + F.col("c.y")).alias("y"),
    )
    measured = polygon_measures(vertices, "unit")
    return rounded(rounded(measured, ["area"], 4), ["centroid_x", "centroid_y"], 3)


@query(
    """with m as (select count(c_acctbal) as n, stddev_samp(c_acctbal) * pow(count(c_acctbal), -0.2) as h, min(c_acctbal) as lo, max(c_acctbal) as hi from customer),
    g as (select range as i, lo - 3 * h + range * (hi - lo + 6 * h) / 199 as x, h, n from range(200), m)
    select i::int as i, round(x, 4) as x, round(sum(exp(-0.5 * ((g.x - c_acctbal) / h) ^ 2)) / any_value(n * h * sqrt(2 * pi())), 10) as density
    from g, customer group by i, x"""
)
def balance_density(t: Tables) -> DataFrame:
    """Kernel density of account balances on 200 points."""
    table = kde(t.customer, "c_acctbal")
    return rounded(rounded(table, ["x"], 4), ["density"], 10)
