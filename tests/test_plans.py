"""Physical plans: what must and must not appear at scale."""

from datetime import datetime

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from arealens.operators.density import kde
from arealens.operators.neighbours import _merge_equal, as_vectors, nearest_to
from arealens.operators.relational import first_per_key
from arealens.operators.scaling import zscore
from arealens.plans.profile import unit_profile
from arealens.workload import catalog
from arealens.workload.registry import Tables
from arealens.workload.views import SPEC, small_areas


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, DATA)


@pytest.mark.parametrize(
    "name", ["nation_profile", "seasonal_cases_per_area", "star_join_orders", "mobility_table", "daily_panel_by_nation",
             "weighted_means_by_region", "polygon_areas", "balance_density", "nearest_supplier"]
)
def test_no_cartesian_or_nested_loop_joins(spark, name):
    text = plan(catalog.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.queries()["filters"](spark, DATA))
    assert "StartsWith" in text.split("PushedFilters")[1] or "In(c_mktsegment" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string>" in text
    narrow = plan(catalog.queries()["global_extremes"](spark, DATA))
    assert "o_custkey" not in narrow.split("ReadSchema")[1]


def test_profile_reads_orders_once(spark, tables):
    text = plan(unit_profile(small_areas(tables), "nation", SPEC, strategy="percentile"))
    assert text.count("orders.parquet") == 1


def test_polygons_read_their_vertices_once(spark):
    text = plan(catalog.queries()["polygon_areas"](spark, DATA))
    assert text.count("orders.parquet") == 1 and "Join" not in text and "Union" not in text


def test_scaling_needs_no_window_and_no_join(spark, tables):
    text = plan(zscore(tables.customer, ["c_acctbal"]))
    assert "Window" not in text and "Join" not in text and "Exchange" not in text


def test_copies_are_limited_before_the_shuffle(spark, tables):
    text = plan(_merge_equal(as_vectors(tables.embeddings, "vec_id", "embedding"), 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_one_query_is_a_take_ordered(spark, tables):
    text = plan(nearest_to(tables.customer, "c_custkey", ["c_acctbal"], 3, 5))
    assert "TakeOrderedAndProject" in text


def test_repeated_keys_do_not_multiply_rows_in_the_join_on_two_keys(spark, tmp_path):
    days = [datetime(1995, 1, d) for d in (1, 2)]
    orders = [(1, days[0]), (1, days[0]), (1, days[1]), (None, days[0])] * 3
    lines = [(1, 5, 2.0, days[0]), (1, 5, 3.0, days[1]), (1, 6, 1.0, days[1]), (None, 5, 1.0, days[0]), (1, None, 1.0, days[0])] * 4
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()["join_on_two_keys"](spark, str(tmp_path))
    wanted = {(5, 1): (12, 48), (5, 2): (12, 24), (6, 2): (4, 12)}
    assert {(r.l_suppkey, r.day.day): (r.qty, r.n) for r in found.collect()} == wanted
    assert "Aggregate [o_orderkey#" in found._jdf.queryExecution().optimizedPlan().toString()


def test_first_rows_combine_before_the_shuffle(spark, tables):
    text = plan(first_per_key(tables.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]))
    assert "partial_min_by" in text and "Window" not in text


def test_density_sends_one_partial_sum_per_grid_point(spark, tables):
    text = plan(kde(tables.customer, "c_acctbal"))
    assert "partial_sum" in text and "Join" not in text


def test_no_broadcast_hints_in_the_library():
    from pathlib import Path

    import arealens

    for path in Path(arealens.__file__).parent.rglob("*.py"):
        text = path.read_text()
        assert "F.broadcast(" not in text and "crossJoin" not in text and "localCheckpoint" not in text, path
    assert F is not None


def test_donor_places_are_one_country_without_the_tiny_districts(spark):
    from arealens.plans.control import donor_places

    codes = ["E06000053", "E06000001", "W06000001", "E09000001", None, "E09000002"]
    places = spark.createDataFrame([(c, 1.0) for c in codes], "unit string, lat double")
    assert sorted(r.unit for r in donor_places(places).collect()) == ["E06000001", "E09000002"]
    assert donor_places(places, prefix=None, leave_out=[]).count() == 5


def test_a_match_on_noise_says_so(spark):
    from arealens.operators.neighbours import neighbour_sentence

    near = spark.createDataFrame([(1, i, i) for i in (1, 2, 3, 4)], "query_id long, neighbour_id long, rank int")
    names = spark.createDataFrame([(i, f"u{i}") for i in (1, 2, 3, 4)], "id long, name string")
    plain = neighbour_sentence(near, names, "id", "name").first().sentence
    assert plain == "The 3 neighbours for u1 are: u2, u3 and u4."
    assert neighbour_sentence(near, names, "id", "name", True).first().sentence == plain + " But we are fitting on noise!"
