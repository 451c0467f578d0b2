"""Synthetic controls and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.operators.relational import join_on
from arealens.operators.scenario import (
    apply_scenarios,
    daily_panel,
    feature_importances,
    fit_forest,
    forest_leaves,
    mean_effect,
    predict,
    predict_by_leaves,
    regression_metrics,
    scenario_effect,
    scenario_table_effects,
)
from arealens.operators.density import kde
from arealens.operators.synthetic import (
    donor_pool,
    exclusions,
    fit_weights,
    normalised_weights,
    synthetic_trajectory,
    unit_vectors,
)
from arealens.plans.control import pre_period_features, synthetic_control
from arealens.session import cut

from .registry import Tables, query
from .series_queries import NATION_RATES_SQL, nation_rates
from .views import knn_sql, rounded, small_areas

PLACES = ["lat", "long"]


def customer_places(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("unit"),
        F.col("c_acctbal").alias("lat"),
        (F.col("c_custkey") % 1009).cast("double").alias("long"),
    )


CUSTOMER_PLACES_SQL = (
    "places as (select c_custkey as unit, c_acctbal as lat, (c_custkey % 1009)::double as long from customer)"
)


@query(
    f"""with {CUSTOMER_PLACES_SQL}, q as (select * from places where unit = 7),
    near as (select p.unit from places p, q order by sqrt((p.lat - q.lat) ^ 2 + (p.long - q.long) ^ 2), p.unit <> 7, p.unit limit 11)
    select * from places where unit not in (from near)"""
)
def donors_outside_neighbourhood(t: Tables) -> DataFrame:
    """All units but one target and its ten nearest."""
    return donor_pool(customer_places(t), "unit", *PLACES, 7, 10)


@query(
    f"""with {CUSTOMER_PLACES_SQL}, {knn_sql('places', 'unit', PLACES, 5)}
    select query_id as target, neighbour_id as excluded from near"""
)
def exclusions_of_every_unit(t: Tables) -> DataFrame:
    """Each unit with its five nearest ones."""
    return exclusions(customer_places(t), "unit", *PLACES, 5)


def given_weights(t: Tables) -> DataFrame:
    """Three donors of every nation, weighted by their customers."""
    size = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    donor = F.explode(F.array(*[((F.col("n_nationkey") + i) % 25) for i in (1, 7, 12)]))
    listed = t.nation.select(F.col("n_nationkey").alias("target"), donor.alias("donor"))
    return join_on(listed, size, {"donor": "c_nationkey"}).select("target", "donor", (F.col("weight") / 1000).alias("weight"))


GIVEN_WEIGHTS_SQL = """weights as (select n_nationkey as target, donor, n / 1000 as weight
  from (select n_nationkey, (n_nationkey + unnest([1, 7, 12])) % 25 as donor from nation)
  join (select c_nationkey, count(*)::double as n from customer group by 1) on c_nationkey = donor)"""


@query(
    f"""with {NATION_RATES_SQL}, {GIVEN_WEIGHTS_SQL},
    summed as (select target, date, sum(weight * rolling_rate) as total, count(rolling_rate) as present from weights join rates on unit = donor group by all),
    counted as (select target, count(*) as donors from weights group by 1)
    select unit as target, rates.date, round(rolling_rate, 4) as observed, case when present = donors then round(total, 4) end as synthetic
    from rates join counted on counted.target = unit left join summed on summed.target = unit and summed.date = rates.date"""
)
def trajectories_of_given_weights(t: Tables) -> DataFrame:
    """Observed and weighted-donor series of every nation."""
    table = synthetic_trajectory(given_weights(t), nation_rates(t), "unit", "date", "rolling_rate")
    return rounded(table, ["observed", "synthetic"], 4)


@query(
    f"""with {GIVEN_WEIGHTS_SQL} select target, donor, weight, round(weight / sum(weight) over (partition by target), 6) as normalised_weight from weights"""
)
def normalised_donor_weights(t: Tables) -> DataFrame:
    return rounded(normalised_weights(given_weights(t)), ["normalised_weight"])


def nation_control(t: Tables):
    """Every nation as a target in turn, before 1999, with the whole penalty grid."""
    places = (
        small_areas(t)
        .groupBy(F.col("nation_code").alias("unit"))
        .agg(F.avg("lati").alias("lat"), F.avg("long").alias("long"))
    )
    rates = nation_rates(t).select("unit", "date", "rolling_rate")
    return synthetic_control(rates, places, places.select("unit"), exclude=5, end="1999-01-01")


@query()
def synthetic_control_weights(t: Tables) -> DataFrame:
    """Non-negative elastic-net weights, all nations fitted in parallel."""
    return nation_control(t).weights


@query(
    """select distinct c_nationkey as target, true as complete, true as exact from customer join orders on o_custkey = c_custkey"""
)
def synthetic_control_status(t: Tables) -> DataFrame:
    """No nation is lost for want of features, and fits meet the optimality conditions."""
    complete = F.col("status") != "features missing"
    exact = F.when(F.col("status") == "fitted", F.coalesce((F.col("kkt") < 1e-7) & ~F.col("capped"), F.lit(False))).otherwise(F.col("status") == "no weight")
    return nation_control(t).status.select("target", complete.alias("complete"), exact.alias("exact"))


@query(
    """select distinct c_nationkey as target, true as same, true as exact from customer join orders on o_custkey = c_custkey"""
)
def large_pool_control_equals_shared(t: Tables) -> DataFrame:
    """Every nation fitted against the distributed pool, beside the fit of the shared one."""
    places = small_areas(t).groupBy(F.col("nation_code").alias("unit")).agg(F.avg("lati").alias("lat"), F.avg("long").alias("long"))
    features = pre_period_features(nation_rates(t).select("unit", "date", "rolling_rate"), end="1999-01-01")
    vectors = cut(unit_vectors(features, "unit", ["feature", "month"], "value"))
    barred = cut(exclusions(places, "unit", "lat", "long", 5))
    fit = lambda way: fit_weights(vectors, vectors.select("unit"), barred, (0.5, 0.9), 15, 5, way)
    one = fit("shared").select("target", "donor", F.col("weight").alias("wanted"), F.col("alpha").alias("wanted_alpha"))
    both = one.join(fit("distributed"), ["target", "donor"], "full")
    close = (F.abs(F.col("weight") - F.col("wanted")) < 1e-6) & (F.abs(F.col("alpha") / F.col("wanted_alpha") - 1) < 1e-9)
    judged = both.groupBy("target").agg(F.bool_and(F.coalesce(close, F.lit(False))).alias("same"), F.bool_and(F.coalesce((F.col("kkt") < 1e-7) & ~F.col("capped"), F.lit(False))).alias("exact"))
    listed = places.select(F.col("unit").alias("target")).join(judged, "target", "left")
    return listed.select("target", F.coalesce("same", F.lit(True)).alias("same"), F.coalesce("exact", F.lit(True)).alias("exact"))


@query()
def synthetic_control_trajectories(t: Tables) -> DataFrame:
    """Observed and synthetic rate of every nation and day."""
    control = nation_control(t)
    return rounded(control.trajectory, ["observed", "synthetic"])


# ---------------------------------------------------------------- scenarios
INPUTS = ["quantity", "discount", "tax", "price"]


def shipping_panel(t: Tables) -> DataFrame:
    """By supplier nation and day: what is shipped, beside what its customers order."""
    moving = (
        join_on(t.lineitem, t.supplier.select("s_suppkey", F.col("s_nationkey").alias("area")), {"l_suppkey": "s_suppkey"})
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), "area")
        .agg(
            F.avg("l_quantity").alias("quantity"),
            F.avg("l_discount").alias("discount"),
            F.avg("l_tax").alias("tax"),
            F.avg("l_extendedprice").alias("price"),
        )
    )
    response = (
        join_on(t.orders, t.customer.select("c_custkey", F.col("c_nationkey").alias("area")), {"o_custkey": "c_custkey"})
        .groupBy(F.col("o_orderdate").cast("date").alias("date"), "area")
        .agg(F.avg("o_totalprice").alias("response"))
    )
    static = t.customer.groupBy(F.col("c_nationkey").alias("code")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("balance")
    )
    return daily_panel(moving, response, ["date", "area"], "date", static, {"area": "code"})


@query(
    """with m as (select l_shipdate::date as date, s_nationkey as area, avg(l_quantity) as quantity, avg(l_discount) as discount,
      avg(l_tax) as tax, avg(l_extendedprice) as price from lineitem join supplier on s_suppkey = l_suppkey group by all),
    r as (select o_orderdate::date as date, c_nationkey as area, avg(o_totalprice) as response from orders join customer on c_custkey = o_custkey group by all),
    s as (select c_nationkey as area, count(*) as customers, avg(c_acctbal) as balance from customer group by 1)
    select date, area, round(quantity, 6) as quantity, round(discount, 6) as discount, round(tax, 6) as tax, round(price, 6) as price,
      round(response, 6) as response, month(date)::int as ymonth, case when isodow(date) > 5 then 1 else 0 end as is_weekend, customers, round(balance, 6) as balance
    from m join r using (date, area) join s using (area)"""
)
def daily_panel_by_nation(t: Tables) -> DataFrame:
    """Inputs and response joined by day and area, with calendar and static features."""
    return rounded(shipping_panel(t), [*INPUTS, "response", "balance"])


@query(
    """select scenario, l_orderkey, l_linenumber, l_suppkey, round(l_quantity + dq, 4) as l_quantity, round(l_discount + dd, 4) as l_discount
    from lineitem, (values ('none', 0, 0), ('less', -5, 0), ('more', 5, 0.1)) as s(scenario, dq, dd)"""
)
def shifted_scenarios(t: Tables) -> DataFrame:
    """Every row under three named shifts of its inputs."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount")
    shifted = apply_scenarios(
        lines, {"none": {}, "less": {"l_quantity": -5}, "more": {"l_quantity": 5, "l_discount": 0.1}}
    )
    return rounded(shifted, ["l_quantity", "l_discount"], 4)


@query(
    """with m as (select *, avg(o_totalprice) over (partition by o_orderpriority) as fitted from orders)
    select round(avg((o_totalprice - fitted) ^ 2), 2) as mse, round(sqrt(avg((o_totalprice - fitted) ^ 2)), 4) as rmse, round(avg(abs(o_totalprice - fitted)), 4) as mae from m"""
)
def fit_metrics_of_group_means(t: Tables) -> DataFrame:
    """Error measures of predicting each order by the mean of its priority."""
    means = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("fitted"))
    metrics = regression_metrics(join_on(t.orders, means, "o_orderpriority"), "o_totalprice", "fitted")
    return rounded(rounded(metrics, ["mse"], 2), ["rmse", "mae"], 4)


FEATURES = [*INPUTS, "is_weekend", "balance"]


def _fitted(t: Tables):
    panel = cut(shipping_panel(t).select("date", "area", "response", *FEATURES).na.drop("any"))
    return panel, fit_forest(panel, FEATURES, "response")


@query()
def forest_fit_metrics(t: Tables) -> DataFrame:
    """In-sample error of the random forest."""
    panel, model = _fitted(t)
    return regression_metrics(predict(model, panel, FEATURES, "expected"), "response", "expected")


@query()
def forest_feature_importances(t: Tables) -> DataFrame:
    panel, model = _fitted(t)
    return feature_importances(model, FEATURES, panel)


@query()
def scenario_effects(t: Tables) -> DataFrame:
    """Expected and counterfactual response by day and nation."""
    panel, model = _fitted(t)
    return scenario_effect(model, panel, FEATURES, "response", {"quantity": -5, "price": -10_000}, ["date", "area"])


@query()
def scenario_effect_density(t: Tables) -> DataFrame:
    """Kernel density of the mean effect per nation."""
    panel, model = _fitted(t)
    effects = scenario_effect(model, panel, FEATURES, "response", {"quantity": -5, "price": -10_000}, ["date", "area"])
    return kde(mean_effect(effects, "area"), "effect")


PANEL_KEYS_SQL = """(select l_shipdate::date as date, s_nationkey as area from lineitem join supplier on s_suppkey = l_suppkey group by all)
    join (select o_orderdate::date as date, c_nationkey as area from orders join customer on c_custkey = o_custkey group by all) using (date, area)"""


def regional_scenarios(t: Tables) -> DataFrame:
    """One scenario per region: less shipped, at lower prices, the further down the list."""
    shifts = {"quantity": -2.0 * F.col("r_regionkey"), "price": -1500.0 * F.col("r_regionkey")}
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), s.alias("shift")) for c, s in shifts.items()])
    return t.region.select(F.col("r_name").alias("scenario"), F.explode(entries).alias("e")).select("scenario", "e.*")


@query()
def effects_of_every_scenario(t: Tables) -> DataFrame:
    """Effects of a table of scenarios by day and nation, from one pass over the panel."""
    panel, model = _fitted(t)
    return scenario_table_effects(model, panel, FEATURES, "response", regional_scenarios(t), ["date", "area"])


@query(f"select r_name as scenario, date, area, true as same from region, {PANEL_KEYS_SQL}")
def scenario_table_equals_single_scenarios(t: Tables) -> DataFrame:
    """The effects of the table's scenarios beside those of each one scored by itself."""
    panel, model = _fitted(t)
    keys = ["date", "area"]
    together = scenario_table_effects(model, panel, FEATURES, "response", regional_scenarios(t), keys)
    alone = None
    for r in t.region.select("r_name", "r_regionkey").orderBy("r_regionkey").limit(5).collect():  # as many as there are regions
        shifts = {"quantity": -2.0 * r["r_regionkey"], "price": -1500.0 * r["r_regionkey"]}
        one = scenario_effect(model, panel, FEATURES, "response", shifts, keys).withColumn("scenario", F.lit(r["r_name"]))
        alone = one if alone is None else alone.unionByName(one)
    alone = alone.select("scenario", *keys, F.col("effect").alias("wanted"), F.col("expected").alias("wanted_expected"))
    same = (F.abs(F.col("effect") - F.col("wanted")) < 1e-6) & (F.abs(F.col("expected") - F.col("wanted_expected")) < 1e-6)
    return together.join(alone, ["scenario", *keys], "full").select("scenario", *keys, F.coalesce(same, F.lit(False)).alias("same"))


@query(f"select date, area, true as same from {PANEL_KEYS_SQL}")
def forest_by_its_leaves(t: Tables) -> DataFrame:
    """Predictions from the table of leaves beside the model's own, on every row."""
    panel, model = _fitted(t)
    both = predict_by_leaves(predict(model, panel, FEATURES, "wanted"), forest_leaves(model, panel), FEATURES, "found")
    return both.select("date", "area", (F.abs(F.col("found") - F.col("wanted")) < 1e-6).alias("same"))


@query("select true as sums_to_one, 6 as features, true as ranked")
def importances_add_up(t: Tables) -> DataFrame:
    panel, model = _fitted(t)
    table = feature_importances(model, FEATURES, panel)
    falls = F.forall(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.get("v", i - 1) >= F.get("v", i))
    return table.agg(F.collect_list("importance").alias("v")).select(
        (F.abs(F.aggregate("v", F.lit(0.0), lambda a, b: a + b) - 1) < 1e-9).alias("sums_to_one"), F.size("v").alias("features"), falls.alias("ranked")
    )
