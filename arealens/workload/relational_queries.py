"""Sources, sinks, projections, filters, joins, aggregates, windows, sorts and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions import (
    drop_last_char,
    haversine_km,
    is_weekend,
    month_of,
    month_start,
    null_safe_sum,
    planar_distance,
    proportion,
    rate_per,
    recode,
    round_even,
    row_sum,
    season_of,
    short_key,
    spread,
    weighted_row_mean,
)
from arealens.operators.allocation import share_of_total
from arealens.operators.columns import (
    columns_where,
    flatten_names,
    numeric_columns,
    quoted,
    rename,
    sum_columns_where,
    to_long,
    unpack_array,
)
from arealens.operators.quantiles import exact_medians, exact_quantiles, quantile_specs
from arealens.operators.relational import (
    calendar,
    distinct_values,
    first_per_key,
    join_on,
    not_in,
    only_in,
    sample_units,
    star_join,
)
from arealens.operators.rollup import (
    pivot_mean,
    pivot_unique,
    rollup_through,
    sum_all_numeric,
    weighted_means,
)
from arealens.session import scratch_path
from arealens.sources.readers import (
    cast_columns,
    promote_header,
    read_csv,
    read_headerless_csv,
    read_sheets,
    read_text_table,
)
from arealens.sources.writers import materialize, write_csv

from .registry import Tables, query
from .views import BANDS, CODES, NATION_CODE_SQL, SEASONS, nation_code, recode_sql, rounded, season_sql


# ---------------------------------------------------------------- sources and sinks
CUSTOMER_DDL = (
    "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
)


@query("select * from customer")
def csv_round_trip(t: Tables) -> DataFrame:
    """Write a table as CSV with a header and read it back with its schema."""
    path = scratch_path(t.spark, "csv")
    write_csv(t.customer, path)
    return read_csv(t.spark, path, CUSTOMER_DDL)


@query("select c_custkey::varchar as area_code, c_name as area_name, c_mktsegment as post_code from customer")
def csv_headerless_positions(t: Tables) -> DataFrame:
    """Read a headerless CSV, keeping columns by position."""
    path = scratch_path(t.spark, "headerless")
    t.customer.write.option("header", False).csv(path)
    return read_headerless_csv(t.spark, path, {0: "area_code", 1: "area_name", 4: "post_code"})


@query(
    """select 'E' || lpad(c_custkey::varchar, 8, '0') as "Code", c_name as "Name", c_acctbal as "All ages"
    from customer"""
)
def sheet_with_preamble(t: Tables) -> DataFrame:
    """A landed sheet: preamble rows, the header among the rows, footnotes after them."""
    path = scratch_path(t.spark, "sheet")
    code = F.concat(F.lit("E"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    data = t.customer.select(F.concat_ws(",", code, "c_name", F.col("c_acctbal").cast("string")).alias("value"))
    around = t.spark.createDataFrame([("Population estimates",), ("Code,Name,All ages",), ("Note: estimates,only",)], "value string")
    around.unionByName(data).write.text(path)
    raw = read_text_table(t.spark, path)
    table = promote_header(raw, F.col("_c0") == "Code", "^[A-Z][0-9]{8}$")
    return cast_columns(table, {"All ages": "double"})


@query(
    """select c_nationkey as code, avg_balance, max_balance from
    (select c_nationkey, round(avg(c_acctbal), 4) as avg_balance from customer group by 1)
    join (select c_nationkey, max(c_acctbal) as max_balance from customer group by 1) using (c_nationkey)"""
)
def sheets_as_tables(t: Tables) -> DataFrame:
    """Several sheets of one workbook, landed as one CSV each, joined again."""
    folder = scratch_path(t.spark, "sheets")
    by_nation = t.customer.groupBy(F.col("c_nationkey").alias("code"))
    write_csv(by_nation.agg(F.round(F.avg("c_acctbal"), 4).alias("avg_balance")), f"{folder}/Average.csv")
    write_csv(by_nation.agg(F.max("c_acctbal").alias("max_balance")), f"{folder}/Highest.csv")
    sheets = read_sheets(
        t.spark, folder, {"Average": "code INT, avg_balance DOUBLE", "Highest": "code INT, max_balance DOUBLE"}
    )
    return join_on(sheets["Average"], sheets["Highest"], "code")


@query("select o_custkey, count(*) as n_orders from orders group by 1")
def materialized_table(t: Tables) -> DataFrame:
    """Build a table once in the shared folder; the second call only reads it."""
    path = scratch_path(t.spark, "materialized")

    def build() -> DataFrame:
        return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))

    materialize(t.spark, path, build)
    return materialize(t.spark, path, build)


# ---------------------------------------------------------------- projections
@query(
    """select c_custkey as "area code", upper(c_name) as "AREA NAME", c_acctbal as score_1, c_nationkey as parent
    from customer"""
)
def select_drop_rename(t: Tables) -> DataFrame:
    """Column subset, drop, and renames by mapping, by function and by position."""
    kept = t.customer.drop("c_mktsegment").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    upper = rename(kept, str.upper)
    mapped = rename(upper, {"C_ACCTBAL": flatten_names([("score", 1)])[0], "C_NATIONKEY": "parent"})
    placed = rename(mapped, ["area code", "AREA NAME", "score_1", "parent"])
    return placed.withColumn("AREA NAME", F.upper("AREA NAME"))


@query(
    """select o_custkey, sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end)::bigint as fast,
      sum(case when o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') then 1 else 0 end)::bigint as slow,
      count(*) as everything
    from orders group by o_custkey"""
)
def sums_over_named_columns(t: Tables) -> DataFrame:
    """Pick columns by fragments of their names and sum them row by row."""
    wide = (
        t.orders.withColumn(
            "column", F.concat(F.when(F.col("o_orderpriority") < "3", "Speed: fast; ").otherwise("Speed: slow; "), "o_orderpriority", F.lit(": Total"))
        )
        .groupBy("o_custkey")
        .pivot("column", [f"Speed: {'fast' if v < '3' else 'slow'}; {v}: Total" for v in BANDS.values()])
        .count()
    )
    named = sum_columns_where(
        wide, {"fast": ("Speed: fast", ": Total"), "slow": ("Speed: slow", ": Total")}
    )
    everything = row_sum([quoted(c) for c in columns_where(wide, "Speed: ")])
    return named.select("o_custkey", "fast", "slow", everything.alias("everything"))


@query(
    f"""with bands as (select o_custkey, {", ".join(f"count(*) filter (o_orderpriority = '{v}') as {c}" for c, v in BANDS.items())}
      from orders group by 1),
    t as (select *, {" + ".join(BANDS)} as pop_total from bands)
    select o_custkey, pop_total, round(pop_a::double / pop_total, 6) as pop_a_prop,
      round_even((pop_b::double / pop_total) * 1000, 0) / 1000 as pop_b_prop,
      round_even(((7.5 * pop_a + 22.5 * pop_b + 37.0 * pop_c + 54.5 * pop_d + 72.0 * pop_e) / pop_total) * 100, 0) / 100 as mean_age,
      round(100000 * pop_e::double / pop_total, 4) as rate, pop_e - pop_a as gap
    from t"""
)
def bands_shares_and_rates(t: Tables) -> DataFrame:
    """Totals, proportions, half-even rounding, weighted mean, rate and spread per row."""
    bands = t.orders.groupBy("o_custkey").agg(
        *[F.count_if(F.col("o_orderpriority") == v).alias(c) for c, v in BANDS.items()]
    )
    total = bands.withColumn("pop_total", row_sum(list(BANDS)))
    mean_age = weighted_row_mean(list(BANDS), [7.5, 22.5, 37.0, 54.5, 72.0], "pop_total")
    return total.select(
        "o_custkey",
        "pop_total",
        F.round(proportion("pop_a", "pop_total"), 6).alias("pop_a_prop"),
        proportion("pop_b", "pop_total", 3).alias("pop_b_prop"),
        round_even(mean_age, 2).alias("mean_age"),
        F.round(rate_per("pop_e", "pop_total"), 4).alias("rate"),
        spread("pop_e", "pop_a").alias("gap"),
    )


@query(
    f"""select o_orderkey, {season_sql('o_orderdate')} as season,
      {recode_sql(NATION_CODE_SQL.format('c_nationkey'))} as code,
      case c_nationkey when 3 then 'B40 1NT' when 7 then 'E16 1XL' end as post_code,
      coalesce(case c_nationkey when 3 then 'B40 1NT' when 7 then 'E16 1XL' end, c_mktsegment) as filled
    from orders join customer on c_custkey = o_custkey"""
)
def seasons_and_recodes(t: Tables) -> DataFrame:
    """Season buckets, recodes with and without default, and filling from another column."""
    joined = join_on(t.orders, t.customer, {"o_custkey": "c_custkey"})
    post_code = recode("c_nationkey", {3: "B40 1NT", 7: "E16 1XL"}, otherwise="null")
    return joined.select(
        "o_orderkey",
        season_of(F.col("o_orderdate").cast("date"), SEASONS).alias("season"),
        recode(nation_code("c_nationkey"), CODES).alias("code"),
        post_code.alias("post_code"),
        F.coalesce(post_code, "c_mktsegment").alias("filled"),
    )


@query(
    """select c_custkey, c_name[:-2] as short_name, md5(c_name[:-2])[:13] as short_key, lower(c_mktsegment) as segment
    from customer"""
)
def names_and_short_keys(t: Tables) -> DataFrame:
    """Drop the last letter and hash what is left to a short key."""
    name = drop_last_char("c_name")
    return t.customer.select(
        "c_custkey", name.alias("short_name"), short_key(name).alias("short_key"), F.lower("c_mktsegment").alias("segment")
    )


@query(
    """select event_id, month(ts)::int as ymonth, case when isodow(ts) > 5 then 1 else 0 end as is_weekend,
      date_trunc('month', ts)::date as month_start, 1 as dummy
    from events"""
)
def calendar_features(t: Tables) -> DataFrame:
    """Month, weekend flag, first of the month and a constant."""
    day = F.col("ts").cast("date")
    return t.events.select(
        "event_id",
        month_of(day).alias("ymonth"),
        is_weekend(day).alias("is_weekend"),
        month_start(day).alias("month_start"),
        F.lit(1).alias("dummy"),
    )


@query(
    """select c_custkey, round(sqrt((c_acctbal - s_acctbal) ^ 2 + (c_nationkey - s_nationkey) ^ 2), 6) as planar,
      round(2 * 6371.0088 * asin(sqrt(sin((radians(s_nationkey) - radians(c_nationkey)) / 2) ^ 2
        + cos(radians(c_nationkey)) * cos(radians(s_nationkey)) * sin(radians(s_acctbal / 100 - c_acctbal / 100) / 2) ^ 2)), 4) as great_circle
    from customer join supplier on s_suppkey = c_custkey % (select count(*) from supplier)"""
)
def distances_to_supplier(t: Tables) -> DataFrame:
    """Planar and great-circle distance between joined points."""
    n = t.supplier.agg(F.count(F.lit(1))).scalar()
    joined = t.customer.withColumn("s_suppkey", F.col("c_custkey") % n).join(t.supplier, "s_suppkey")
    return joined.select(
        "c_custkey",
        F.round(planar_distance("c_acctbal", "c_nationkey", "s_acctbal", "s_nationkey"), 6).alias("planar"),
        F.round(
            haversine_km("c_nationkey", F.col("c_acctbal") / 100, "s_nationkey", F.col("s_acctbal") / 100), 4
        ).alias("great_circle"),
    )


@query(
    """select c_nationkey, unnest(['q25', 'q50', 'q75']) as measure,
      unnest([quantile_cont(c_acctbal, 0.25), quantile_cont(c_acctbal, 0.5), quantile_cont(c_acctbal, 0.75)])::decimal(18, 4)::double as amount
    from customer group by 1"""
)
def arrays_to_columns_to_long(t: Tables) -> DataFrame:
    """Split a list column into columns, then turn the columns into rows."""
    packed = exact_quantiles(t.customer, ["c_nationkey"], quantile_specs(["c_acctbal"], {"q25": 0.25, "q50": 0.5, "q75": 0.75}))
    names = ["q25", "q50", "q75"]
    as_array = packed.select("c_nationkey", F.array(*[F.col(f"c_acctbal_{n}") for n in names]).alias("list"))
    long = to_long(unpack_array(as_array, "list", names), ["c_nationkey"], names, "measure", "amount")
    return long.withColumn("amount", F.round("amount", 4))


# ---------------------------------------------------------------- filters
@query(
    """select c_custkey, c_name, c_acctbal from customer
    where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (3, 4, 5) and c_acctbal > 100
      and (c_nationkey >= 10 or c_nationkey = 1) and c_name like 'Customer%' and c_mktsegment not like 'MA%'
      and c_acctbal is not null"""
)
def filters(t: Tables) -> DataFrame:
    """Equality, lists, ranges, prefixes, nulls, and their combinations; pushed to the scan."""
    return t.customer.filter(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
        & ~F.col("c_nationkey").isin(3, 4, 5)
        & (F.col("c_acctbal") > 100)
        & ((F.col("c_nationkey") >= 10) | (F.col("c_nationkey") == 1))
        & F.col("c_name").startswith("Customer")
        & ~F.col("c_mktsegment").startswith("MA")
        & F.col("c_acctbal").isNotNull()
    ).select("c_custkey", "c_name", "c_acctbal")


@query(
    """select o_orderkey, o_custkey, o_totalprice from orders left join
      (select c_custkey, c_nationkey from customer where c_mktsegment = 'BUILDING') on c_custkey = o_custkey
    where c_nationkey is not null and o_orderdate >= date '1997-03-01' and o_orderdate < date '1998-03-01'"""
)
def complete_rows_in_period(t: Tables) -> DataFrame:
    """Keep the rows of a period that have no missing value."""
    some = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_nationkey")
    joined = join_on(t.orders, some, {"o_custkey": "c_custkey"}, "left").na.drop("any")
    day = F.col("o_orderdate").cast("date")
    return joined.filter((day >= F.lit("1997-03-01").cast("date")) & (day < F.lit("1998-03-01").cast("date"))).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


# ---------------------------------------------------------------- joins
@query(
    """select o_orderkey, o_totalprice, c_name, n_name, r_name from orders
    join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey"""
)
def star_join_orders(t: Tables) -> DataFrame:
    """Fact table with a chain of dimensions."""
    return star_join(
        t.orders,
        (t.customer, {"o_custkey": "c_custkey"}),
        (t.nation, {"c_nationkey": "n_nationkey"}),
        (t.region, {"n_regionkey": "r_regionkey"}),
    ).select("o_orderkey", "o_totalprice", "c_name", "n_name", "r_name")


@query(
    """select s_suppkey, coalesce(n_orders, 0) as n_orders, n_name from supplier
    left join (select c_nationkey, count(*) as n_orders from orders join customer on c_custkey = o_custkey
      where c_nationkey < 20 group by 1) on c_nationkey = s_nationkey
    join nation on n_nationkey = s_nationkey"""
)
def left_and_lookup_joins(t: Tables) -> DataFrame:
    """Left join that keeps unmatched rows, then a code-to-name lookup."""
    counts = (
        join_on(t.orders, t.customer.filter(F.col("c_nationkey") < 20), {"o_custkey": "c_custkey"})
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    left = join_on(t.supplier, counts, {"s_nationkey": "c_nationkey"}, "left")
    named = join_on(left, t.nation, {"s_nationkey": "n_nationkey"})
    return named.select("s_suppkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "n_name")


@query(
    """with s as (select l_suppkey, l_shipdate::date as day, sum(cast(l_quantity as bigint))::bigint as qty from lineitem group by 1, 2),
    o as (select l_suppkey, o_orderdate::date as day, count(*) as n from lineitem join orders on o_orderkey = l_orderkey group by 1, 2)
    select l_suppkey, day, qty, n from s join o using (l_suppkey, day)"""
)
def join_on_two_keys(t: Tables) -> DataFrame:
    """Inner join on unit and date."""
    shipped = t.lineitem.groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty")
    )
    # lines and orders are counted by key first, so that repeated keys never multiply rows
    lines = t.lineitem.where(F.col("l_orderkey").isNotNull()).groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    days = (
        t.orders.where(F.col("o_orderkey").isNotNull())
        .groupBy("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    ordered = (
        join_on(lines, days, {"l_orderkey": "o_orderkey"})
        .groupBy("l_suppkey", "day")
        .agg(F.sum(F.col("lines") * F.col("orders")).alias("n"))
    )
    return join_on(shipped, ordered, ["l_suppkey", "day"])


@query(
    """select c_custkey, c_nationkey from customer
    where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')
      and c_nationkey in (select s_nationkey from supplier)"""
)
def anti_and_semi_joins(t: Tables) -> DataFrame:
    """Leave out listed rows, keep rows found in a list."""
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    rest = not_in(t.customer, urgent, {"c_custkey": "o_custkey"})
    return only_in(rest, t.supplier, {"c_nationkey": "s_nationkey"}).select("c_custkey", "c_nationkey")


@query(
    """select date, n_nationkey, n_name, events_n from
      (select ts::date as date, user_id % 5 as region, count(*) as events_n from events group by all)
    join nation on n_regionkey = region where n_name is not null"""
)
def many_to_many_lookup(t: Tables) -> DataFrame:
    """One region's daily row serves each of its nations."""
    daily = (
        t.events.groupBy(F.col("ts").cast("date").alias("date"), (F.col("user_id") % 5).alias("region"))
        .agg(F.count(F.lit(1)).alias("events_n"))
    )
    places = t.nation.filter(F.col("n_name").isNotNull())
    return join_on(daily, places, {"region": "n_regionkey"}).select("date", "n_nationkey", "n_name", "events_n")


# ---------------------------------------------------------------- aggregates
@query(
    """select c_nationkey, count(*) as n, count(distinct c_mktsegment) as segments, round(sum(c_acctbal::decimal(18,2)), 2)::double as total,
      round(avg(c_acctbal), 6) as mean, min(c_acctbal) as low, max(c_acctbal) as high
    from customer group by 1"""
)
def grouped_aggregates(t: Tables) -> DataFrame:
    """Count, distinct count, sum, mean, minimum and maximum per group."""
    return t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("c_mktsegment").alias("segments"),
        null_safe_sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total"),
        F.round(F.avg("c_acctbal"), 6).alias("mean"),
        F.min("c_acctbal").alias("low"),
        F.max("c_acctbal").alias("high"),
    )


@query(
    """select l_returnflag, l_linestatus, sum(l_linenumber)::bigint as l_linenumber, sum(qty)::bigint as qty, sum(l_partkey)::bigint as l_partkey
    from (select *, cast(l_quantity as bigint) as qty from lineitem) group by all"""
)
def sum_of_every_numeric_column(t: Tables) -> DataFrame:
    """Sum whatever is numeric in the schema."""
    slim = t.lineitem.select(
        "l_returnflag", "l_linestatus", "l_linenumber", F.col("l_quantity").cast("bigint").alias("qty"), "l_partkey"
    )
    assert numeric_columns(slim) == ["l_linenumber", "qty", "l_partkey"]
    return sum_all_numeric(slim, ["l_returnflag", "l_linestatus"])


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
QUANTILE_SQL = """select o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) as o_totalprice_q25,
  round(quantile_cont(o_totalprice, 0.5), 4) as o_totalprice_q50, round(quantile_cont(o_totalprice, 0.75), 4) as o_totalprice_q75,
  round(quantile_cont(o_custkey, 0.25), 4) as o_custkey_q25, round(quantile_cont(o_custkey, 0.5), 4) as o_custkey_q50,
  round(quantile_cont(o_custkey, 0.75), 4) as o_custkey_q75
from orders group by 1"""


@query(QUANTILE_SQL)
def exact_quartiles(t: Tables) -> DataFrame:
    """Exact quartiles of several columns per group."""
    specs = quantile_specs(["o_totalprice", "o_custkey"], QUARTILES)
    return rounded(exact_quantiles(t.orders, ["o_orderpriority"], specs), list(specs), 4)


@query(QUANTILE_SQL)
def exact_quartiles_of_huge_groups(t: Tables) -> DataFrame:
    """The same quartiles, every group ranked by ranges as huge groups are."""
    specs = quantile_specs(["o_totalprice", "o_custkey"], QUARTILES)
    return rounded(exact_quantiles(t.orders, ["o_orderpriority"], specs, strategy="split"), list(specs), 4)


@query(QUANTILE_SQL)
def exact_quartiles_by_narrowing(t: Tables) -> DataFrame:
    """The same quartiles with ranges narrowed until no task orders more than 256 values."""
    specs = quantile_specs(["o_totalprice", "o_custkey"], QUARTILES)
    found = exact_quantiles(t.orders, ["o_orderpriority"], specs, strategy="split", sort_rows=256)
    return rounded(found, list(specs), 4)


@query(
    """select round(median(c_acctbal), 4) as lati, round(median(c_custkey), 4) as long from customer"""
)
def global_median_centre(t: Tables) -> DataFrame:
    """Median of whole columns, without gathering them in one task."""
    points = t.customer.select(F.col("c_acctbal").alias("lati"), F.col("c_custkey").alias("long"))
    return rounded(exact_medians(points, [], ["lati", "long"], strategy="split"), ["lati", "long"], 4)


@query("""select min(o_totalprice) as low, max(o_totalprice) as high, count(*) as n, min(o_orderdate)::date as first from orders""")
def global_extremes(t: Tables) -> DataFrame:
    """Minimum, maximum and count of a whole table."""
    return t.orders.agg(
        F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.col("o_orderdate").cast("date")).alias("first"),
    )


@query(
    """select n_regionkey, round(sum(c_acctbal * n) / sum(n), 6) as c_acctbal, round(sum(c_custkey * n) / sum(n), 6) as c_custkey
    from customer join nation on n_nationkey = c_nationkey
    join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey group by 1"""
)
def weighted_means_by_region(t: Tables) -> DataFrame:
    """Means of several columns weighted by the number of orders."""
    weights = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = star_join(t.customer, (weights, {"c_custkey": "o_custkey"}), (t.nation, {"c_nationkey": "n_nationkey"}))
    return rounded(weighted_means(joined, ["n_regionkey"], ["c_acctbal", "c_custkey"], "n"), ["c_acctbal", "c_custkey"])


@query(
    """select n_regionkey, round(avg(avg_balance), 6) as avg_balance, sum(n)::bigint as n from
      (select c_nationkey, avg(c_acctbal) as avg_balance, count(*) as n from customer group by 1)
    join nation on n_nationkey = c_nationkey group by 1"""
)
def two_level_rollup(t: Tables) -> DataFrame:
    """Roll up to nations, then through a lookup to regions."""
    nations = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("avg_balance"), F.count(F.lit(1)).alias("n"))
    regions = rollup_through(
        nations, t.nation, {"c_nationkey": "n_nationkey"}, ["n_regionkey"], {"avg_balance": "mean", "n": "sum"}
    )
    return rounded(regions, ["avg_balance"])


@query("select distinct c_mktsegment from customer order by 1")
def distinct_sorted_values(t: Tables) -> DataFrame:
    return distinct_values(t.customer, "c_mktsegment")


@query(
    """select o_custkey, o_orderkey, o_orderstatus, o_totalprice from
      (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1"""
)
def first_order_per_customer(t: Tables) -> DataFrame:
    """First row per key."""
    slim = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return first_per_key(slim, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    """select user_id, max(n) filter (event_type = 'click') as click, max(n) filter (event_type = 'view') as view,
      max(n) filter (event_type = 'error') as error, max(n) filter (event_type = 'signup') as signup,
      max(n) filter (event_type = 'purchase') as purchase
    from (select user_id, event_type, count(*) as n from events group by all) group by 1"""
)
def pivot_of_unique_cells(t: Tables) -> DataFrame:
    """Pivot with one row per cell, checked."""
    cells = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return pivot_unique(cells, ["user_id"], "event_type", ["click", "view", "error", "signup", "purchase"], "n")


@query(
    """select o_custkey, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 6) as "F_o_totalprice",
      round(avg(o_orderkey) filter (o_orderstatus = 'F'), 6) as "F_o_orderkey",
      round(avg(o_totalprice) filter (o_orderstatus = 'O'), 6) as "O_o_totalprice",
      round(avg(o_orderkey) filter (o_orderstatus = 'O'), 6) as "O_o_orderkey",
      round(avg(o_totalprice) filter (o_orderstatus = 'P'), 6) as "P_o_totalprice",
      round(avg(o_orderkey) filter (o_orderstatus = 'P'), 6) as "P_o_orderkey"
    from orders group by 1"""
)
def pivot_of_means(t: Tables) -> DataFrame:
    """Pivot of two columns with their mean."""
    wide = pivot_mean(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], ["o_totalprice", "o_orderkey"])
    return rounded(wide, wide.columns[1:])


# ---------------------------------------------------------------- windows, sorts, generators
@query(
    """select o_orderkey, o_custkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 6) as share from orders"""
)
def share_of_customer_total(t: Tables) -> DataFrame:
    """Each row's share of its group total."""
    shares = share_of_total(t.orders, ["o_custkey"], "o_totalprice", "share")
    return rounded(shares.select("o_orderkey", "o_custkey", "share"), ["share"])


@query(
    """select c_mktsegment, c_acctbal, c_custkey from customer order by c_mktsegment, c_acctbal desc, c_custkey"""
)
def multi_key_sort(t: Tables) -> DataFrame:
    """Ascending and descending keys in one sort."""
    return t.customer.select("c_mktsegment", "c_acctbal", "c_custkey").orderBy(
        "c_mktsegment", F.desc("c_acctbal"), "c_custkey"
    )


@query(
    """select unnest(generate_series(min(o_orderdate)::date, max(o_orderdate)::date, interval 1 day))::date as date from orders"""
)
def daily_calendar(t: Tables) -> DataFrame:
    """Every day between the first and the last order."""
    return calendar(t.orders, "o_orderdate")


@query(
    """select m as date from (select unnest(generate_series(date_trunc('month', min(l_shipdate))::date, max(l_shipdate)::date, interval 1 month))::date as m,
      min(l_shipdate) as low from lineitem) where m >= low::date"""
)
def month_start_calendar(t: Tables) -> DataFrame:
    """Month starts inside the range of ship dates."""
    return calendar(t.lineitem, "l_shipdate", "month")


@query(
    """select user_id from (select distinct user_id from events) order by md5(user_id::varchar || ':4'), user_id limit 12"""
)
def background_sample(t: Tables) -> DataFrame:
    """Seeded sample of twelve units."""
    return sample_units(t.events, "user_id", 12, 4)
