"""Unit profiles, standardisation and similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.operators.neighbours import (
    knn,
    nearest_to,
    neighbour_recall,
    neighbour_report,
    neighbour_sentence,
    pca_scores,
)
from arealens.operators.rollup import rollup_units
from arealens.operators.scaling import gaussian, percent_explained, resolve_features, zscore
from arealens.plans.profile import level_profiles, unit_profile
from arealens.plans.search import (
    city_neighbours,
    find_neighbours,
    neighbourhood_centres,
    unit_by_name,
)

from arealens.session import cut

from .registry import Tables, query
from .views import (
    BANDS,
    CASES,
    FEATURES,
    GROUPS,
    SMALL_AREAS_SQL,
    SPEC,
    knn_sql,
    order_summary,
    profile_sql,
    rounded,
    small_areas,
    zscore_sql,
)

PROFILE_COUNTS = ["pop_all", *BANDS, *GROUPS, "group_all"]
PROFILE_MEASURES = [
    "area", "lati", "long", "balance", "mean_price", "pop_density",
    *[f"{b}_prop" for b in BANDS], *[f"pop_{g}_prop" for g in GROUPS],
    *[f"{c}_{q}" for c in CASES for q in ("q25", "q50", "q75")],
]
PROFILE_RATES = [f"{c}_{q}_rate" for c in CASES for q in ("q25", "q50", "q75", "iqr")]


def _profile_select(level: str) -> str:
    code, name = SPEC.levels[level]
    cells = [code, name, *[f"{c}::bigint as {c}" for c in PROFILE_COUNTS]]
    cells += [f"round({c}, 4) as {c}" for c in PROFILE_MEASURES]
    cells += [f"round({c}, 2) as {c}" for c in PROFILE_RATES]
    return f"with {SMALL_AREAS_SQL}, {profile_sql(level)} select {', '.join(cells)} from profile"


def _profile(t: Tables, level: str) -> DataFrame:
    table = unit_profile(small_areas(t), level, SPEC, noise_seed=None)
    return rounded(rounded(table, PROFILE_MEASURES, 4), PROFILE_RATES, 2)


@query(_profile_select("nation"))
def nation_profile(t: Tables) -> DataFrame:
    """Full profile of every nation."""
    return _profile(t, "nation")


@query(_profile_select("region"))
def region_profile(t: Tables) -> DataFrame:
    """The same profile one level up."""
    return _profile(t, "region")


def _level_select(level: str) -> str:
    cells = [f"{c}::bigint as {c}" for c in PROFILE_COUNTS]
    cells += [f"round({c}, 4) as {c}" for c in PROFILE_MEASURES]
    cells += [f"round({c}, 2) as {c}" for c in PROFILE_RATES]
    code, name = SPEC.levels[level]
    return f"""select * from (with {profile_sql(level)} select '{level}' as level, {code}::varchar as code, {name} as name, {', '.join(cells)} from profile)"""


@query(f"with {SMALL_AREAS_SQL} {_level_select('nation')} union all {_level_select('region')}")
def profile_of_all_levels(t: Tables) -> DataFrame:
    """Nations and regions profiled in one pass over the areas."""
    table = level_profiles(small_areas(t), spec=SPEC, noise_seed=None)
    return rounded(rounded(table, PROFILE_MEASURES, 4), PROFILE_RATES, 2)


@query(
    f"""with {SMALL_AREAS_SQL} select region_code, sum(pop_all)::bigint as pop_all, round(avg(balance), 6) as balance,
      round(quantile_cont(lati, 0.5), 4) as lati, round(quantile_cont(nc_y1, 0.9), 4) as nc_y1_q90
    from small_areas group by 1"""
)
def mixed_rollup_of_huge_units(t: Tables) -> DataFrame:
    """Sums, means, medians and quantiles, with the units treated as too big for one task."""
    rolled = rollup_units(
        small_areas(t),
        ["region_code"],
        {"pop_all": "sum", "balance": "mean", "lati": "median"},
        {"nc_y1_q90": ("nc_y1", 0.9)},
        strategy="split",
    )
    return rounded(rounded(rolled, ["balance"]), ["lati", "nc_y1_q90"], 4)


NATION_FEATURES = resolve_features(["age", "wealth", "status", "cases"], FEATURES)


@query(
    f"""with {SMALL_AREAS_SQL}, {profile_sql('nation')}, {zscore_sql('profile', ['nation_code'], NATION_FEATURES)},
      {knn_sql('scaled', 'nation_code', NATION_FEATURES, 3)}
    select query_id, neighbour_id, rank, round(distance, 6) as distance from near"""
)
def nation_neighbours(t: Tables) -> DataFrame:
    """Flagship: profile every nation, standardise, and find its three nearest ones."""
    profile = unit_profile(small_areas(t), "nation", SPEC)
    found = find_neighbours(
        profile,
        "nation_code",
        "nation_name",
        ["age", "wealth", "status", "cases"],
        nn=3,
        feature_groups=FEATURES,
        scale=NATION_FEATURES,
    )
    return rounded(found.table, ["distance"])


CUSTOMER_SPACE = ["balance", "mean_price", "pop_all", "long"]


def customer_space(t: Tables, weights=None) -> DataFrame:
    """Standardised features of every customer."""
    points = cut(small_areas(t).select("area_id", "area_name", *CUSTOMER_SPACE))
    return zscore(points, CUSTOMER_SPACE, weights)


CUSTOMER_SPACE_SQL = f"with {SMALL_AREAS_SQL}, {zscore_sql('small_areas', ['area_id', 'area_name'], CUSTOMER_SPACE)}"


@query(
    f"""{CUSTOMER_SPACE_SQL} select area_id, round(balance * 0.5, 6) as balance, round(mean_price, 6) as mean_price,
      round(pop_all, 6) as pop_all, round(long * 0.5, 6) as long from scaled"""
)
def weighted_feature_space(t: Tables) -> DataFrame:
    """Z-scores, two of them halved."""
    space = customer_space(t, {"balance": 0.5, "long": 0.5}).drop("area_name")
    return rounded(space, CUSTOMER_SPACE)


@query(
    """select c_custkey, round(sqrt(-2 * ln((('0x' || md5(c_custkey || ':420:r')[:13])::bigint::double + 0.5) / 16 ^ 13))
      * cos(2 * pi() * ((('0x' || md5(c_custkey || ':420:a')[:13])::bigint::double + 0.5) / 16 ^ 13)), 6) as noise
    from customer"""
)
def noise_column(t: Tables) -> DataFrame:
    """Normal noise per row, reproducible from key and seed."""
    return t.customer.select("c_custkey", F.round(gaussian("c_custkey", 420), 6).alias("noise"))


CUSTOMER_KNN_SQL = f"""{CUSTOMER_SPACE_SQL}, {knn_sql('scaled', 'area_id', CUSTOMER_SPACE, 4)}
  select query_id, neighbour_id, rank, round(distance, 6) as distance from near"""


@query(CUSTOMER_KNN_SQL)
def customer_neighbours(t: Tables) -> DataFrame:
    """Four nearest customers of every customer; the way is chosen by the checked size."""
    return rounded(knn(customer_space(t), "area_id", CUSTOMER_SPACE, 4), ["distance"])


@query(CUSTOMER_KNN_SQL)
def customer_neighbours_by_balls(t: Tables) -> DataFrame:
    """The same search by balls, the way taken for large reference sets."""
    return rounded(knn(customer_space(t), "area_id", CUSTOMER_SPACE, 4, strategy="balls"), ["distance"])


EMBEDDING_KNN_SQL = """with v as (select vec_id, embedding::double[] as e from embeddings),
  pairs as (select a.vec_id as query_id, b.vec_id as neighbour_id, list_distance(a.e, b.e) as distance from v a cross join v b)
  select query_id, neighbour_id, rank, round(distance, 6) as distance from (select *,
    row_number() over (partition by query_id order by query_id <> neighbour_id, distance, neighbour_id)::int as rank from pairs)
  where rank <= 6"""


@query(EMBEDDING_KNN_SQL)
def embedding_neighbours(t: Tables) -> DataFrame:
    """Five nearest vectors of every vector."""
    return rounded(knn(t.embeddings, "vec_id", "embedding", 5), ["distance"])


@query(EMBEDDING_KNN_SQL)
def embedding_neighbours_by_balls(t: Tables) -> DataFrame:
    return rounded(knn(t.embeddings, "vec_id", "embedding", 5, strategy="balls"), ["distance"])


@query()
def approximate_neighbours_recall(t: Tables) -> DataFrame:
    """Recall of a search limited to the three closest balls, against the exact search."""
    space = customer_space(t)
    exact = knn(space, "area_id", CUSTOMER_SPACE, 4)
    probed = knn(space, "area_id", CUSTOMER_SPACE, 4, strategy="balls", probe=3)
    return rounded(neighbour_recall(exact, probed), ["recall"])


@query(
    f"""{CUSTOMER_SPACE_SQL}
    select area_id as query_id, least(41, count(*) over ())::bigint as n_found, true as nearest_first, true as recall_reached
    from scaled"""
)
def probed_neighbours(t: Tables) -> DataFrame:
    """The closest eight balls, widened until 40 neighbours are held: rows found, and recall of at least 0.9."""
    space = customer_space(t)
    probed = cut(knn(space, "area_id", CUSTOMER_SPACE, 40, strategy="balls", probe=8))
    recall = neighbour_recall(knn(space, "area_id", CUSTOMER_SPACE, 40), probed)
    found = probed.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_found"),
        ((F.min("rank") == 1) & (F.max("rank") == F.count(F.lit(1)))).alias("nearest_first"),
    )
    return found.withColumn("recall_reached", recall.select(F.col("recall") >= 0.9).scalar())


@query(
    f"""{CUSTOMER_SPACE_SQL}, q as (select * from scaled where area_id = (select min(area_id) from scaled where area_name = 'Customer#000000007')),
    d as (select q.area_id as query_id, s.area_id as neighbour_id, sqrt({" + ".join(f"(s.{c} - q.{c}) ^ 2" for c in CUSTOMER_SPACE)}) as distance from scaled s, q)
    select query_id, neighbour_id, row_number() over (order by distance, query_id <> neighbour_id, neighbour_id)::int as rank, round(distance, 6) as distance
    from d order by distance, query_id <> neighbour_id, neighbour_id limit 8"""
)
def neighbours_of_one_customer(t: Tables) -> DataFrame:
    """The one-query way: look the customer up by name, take the closest eight rows."""
    target = unit_by_name(t.customer, "c_custkey", "c_name", "Customer#000000007").first()[0]
    return rounded(nearest_to(customer_space(t), "area_id", CUSTOMER_SPACE, target, 8), ["distance"])


@query(
    f"""{CUSTOMER_SPACE_SQL}, {knn_sql('scaled', 'area_id', CUSTOMER_SPACE, 3)}
    select query_id, neighbour_id, rank, round(distance, 6) as distance, raw.pop_all, round(raw.mean_price, 6) as mean_price,
      round(scaled.pop_all, 6) as pop_all_norm, round(scaled.mean_price, 6) as mean_price_norm
    from near join small_areas raw on raw.area_id = neighbour_id join scaled on scaled.area_id = neighbour_id"""
)
def neighbour_values(t: Tables) -> DataFrame:
    """Raw and normalised features of every customer's neighbours."""
    space = customer_space(t)
    table = neighbour_report(
        knn(space, "area_id", CUSTOMER_SPACE, 3), small_areas(t), space, "area_id", ["pop_all", "mean_price"]
    )
    return rounded(table, ["distance", "mean_price", "pop_all_norm", "mean_price_norm"])


@query(
    f"""{CUSTOMER_SPACE_SQL}, {knn_sql('scaled', 'area_id', CUSTOMER_SPACE, 3)},
    named as (select near.*, area_name from near join small_areas on area_id = neighbour_id)
    select query_id, 'The 3 neighbours for ' || max(area_name) filter (rank = 1) || ' are: ' || max(area_name) filter (rank = 2)
      || ', ' || max(area_name) filter (rank = 3) || ' and ' || max(area_name) filter (rank = 4) || '.' as sentence
    from named group by 1"""
)
def neighbour_sentences(t: Tables) -> DataFrame:
    """One sentence naming each customer's neighbours."""
    space = customer_space(t)
    return neighbour_sentence(knn(space, "area_id", CUSTOMER_SPACE, 3), space, "area_id", "area_name")


@query(
    f"""{CUSTOMER_SPACE_SQL}, {knn_sql('scaled', 'area_id', CUSTOMER_SPACE, 3)}
    select query_id, round(median(lati), 4) as lati, round(median(small_areas.long), 4) as long
    from near join small_areas on area_id = neighbour_id group by 1"""
)
def neighbourhood_centre(t: Tables) -> DataFrame:
    """Median coordinates of every neighbourhood."""
    table = knn(customer_space(t), "area_id", CUSTOMER_SPACE, 3)
    return rounded(neighbourhood_centres(table, small_areas(t), "area_id", ["lati", "long"]), ["lati", "long"], 4)


BAND_SPACE = [*BANDS, "balance", "mean_price"]


@query()
def neighbours_in_reduced_space(t: Tables) -> DataFrame:
    """Neighbours between the first three principal components."""
    areas = cut(small_areas(t).select("area_id", *BAND_SPACE))
    scores, ratios = pca_scores(zscore(areas, BAND_SPACE), "area_id", BAND_SPACE, 3)
    return knn(scores, "area_id", "scores", 3).withColumn("variance_kept", F.lit(percent_explained(ratios, 3)))


@query(
    f"""with {SMALL_AREAS_SQL}, {zscore_sql('small_areas', ['area_id'], BAND_SPACE)}, {knn_sql('scaled', 'area_id', BAND_SPACE, 3)}
    select query_id, rank, round(distance, 5) as distance from near"""
)
def distances_in_rotated_space(t: Tables) -> DataFrame:
    """With all components kept, distances equal those between the features."""
    areas = cut(small_areas(t).select("area_id", *BAND_SPACE))
    scores, _ = pca_scores(zscore(areas, BAND_SPACE), "area_id", BAND_SPACE, len(BAND_SPACE))
    return rounded(knn(scores, "area_id", "scores", 3), ["distance"], 5).select("query_id", "rank", "distance")


@query(
    """with s as (select o_custkey, count(*)::double as n from orders group by 1),
    z as (select o_custkey, (n - avg(n) over ()) / stddev_pop(n) over () as z from s)
    select o_custkey, round(z, 6) as pop_all from z"""
)
def zscore_of_order_counts(t: Tables) -> DataFrame:
    """One standardised column straight from the order table."""
    return rounded(zscore(order_summary(t).select("o_custkey", "pop_all"), ["pop_all"]), ["pop_all"])


NOISE_SQL = """noisy as (select c_custkey as area_id, sqrt(-2 * ln((('0x' || md5(c_custkey || ':420:r')[:13])::bigint::double + 0.5) / 16 ^ 13))
  * cos(2 * pi() * ((('0x' || md5(c_custkey || ':420:a')[:13])::bigint::double + 0.5) / 16 ^ 13)) as noise from customer)"""


@query(
    f"""with {NOISE_SQL}, {knn_sql('noisy', 'area_id', ['noise'], 3)}
    select query_id, neighbour_id, rank, round(distance, 6) as distance from near"""
)
def neighbours_on_noise(t: Tables) -> DataFrame:
    """With no feature group chosen the match is on the noise column."""
    noisy = t.customer.select(F.col("c_custkey").alias("area_id"), gaussian("c_custkey", 420).alias("noise"))
    return rounded(knn(noisy, "area_id", resolve_features([], FEATURES), 3), ["distance"])


CITIES_SQL = """cities as (select c_name, c_acctbal as lat, (c_custkey % 1009)::double as lng, c_mktsegment as iso3 from customer
  join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and n > 5)"""


@query(
    f"""with {CITIES_SQL}, {knn_sql('cities', 'c_name', ['lat', 'lng'], 3)}
    select query_id, neighbour_id, rank, round(distance, 6) as distance, iso3, lat, lng as lon from near join cities on c_name = neighbour_id"""
)
def large_city_neighbours(t: Tables) -> DataFrame:
    """Customers as cities: those of one segment with enough orders, and their nearest."""
    population = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("population"))
    cities = t.customer.join(population, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_name").alias("city_ascii"),
        F.col("c_acctbal").alias("lat"),
        (F.col("c_custkey") % 1009).cast("double").alias("lng"),
        F.col("c_mktsegment").alias("iso3"),
        "population",
    )
    return rounded(city_neighbours(cities, 4, "BUILDING", 5.0), ["distance"])
