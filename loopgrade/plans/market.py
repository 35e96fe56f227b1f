"""Queries of the ranking, carbon and impact operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopgrade.functions import labels
from loopgrade.functions.geo import distance_score, haversine_km
from loopgrade.functions.session import bounded, cut
from loopgrade.operators import carbon, ranking
from loopgrade.operators.ordered import quantiles
from loopgrade.plans.bindings import bind, read, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *bindings: str):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle, *bindings) if bindings else oracle
        return f

    return add


KM = "6371.0 * 2 * asin(least(1.0, sqrt(pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"
PLACE = "(SELECT 12.95::DOUBLE AS lat, 77.6::DOUBLE AS lon)"
LAT, LON = 12.95, 77.6


def listings(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "listings")


def recyclers(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "recyclers").withColumn("types", ranking.split_types(F.col("waste_types")))


def rated(spark: SparkSession, d: str) -> DataFrame:
    return carbon.saved(carbon.resolve(listings(spark, d), bind(spark, d, "factors"), bind(spark, d, "codes")))


RATED = """rated AS (
    SELECT l.*, CASE WHEN l.sub_type <> 'unknown' THEN f.factor ELSE m.mean_factor END AS factor,
           CASE WHEN l.sub_type <> 'unknown' THEN CASE WHEN f.factor IS NULL THEN 'unavailable' ELSE 'exact' END
                WHEN m.mean_factor IS NULL THEN 'unavailable' ELSE 'type_mean' END AS outcome,
           CASE WHEN l.sub_type <> 'unknown' THEN f.is_proxy WHEN m.mean_factor IS NOT NULL THEN true END AS is_proxy,
           CASE WHEN l.sub_type <> 'unknown' THEN f.source ELSE m.sources END AS source
    FROM listings l LEFT JOIN codes c ON l.waste_type = c.waste_type AND l.sub_type = c.photo_sub
    LEFT JOIN factors f ON f.sub_type = coalesce(c.market_sub, l.sub_type)
    LEFT JOIN (SELECT waste_type, avg(factor) AS mean_factor, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM factors GROUP BY 1) m ON m.waste_type = l.waste_type),
saved AS (SELECT *, round(CAST(quantity_kg AS DECIMAL(20,4)) * CAST(factor AS DECIMAL(18,8)), 2)::DOUBLE AS co2e_kg, CAST(round(CAST(quantity_kg AS DECIMAL(20,4)) * CAST(factor AS DECIMAL(18,8)), 2) AS DECIMAL(28,2)) AS c FROM rated)
"""
CARBON = ("listings", "factors", "codes")

PAIRS = f"""WITH pairs AS (
    SELECT l.waste_id, l.waste_type, l.quantity_kg, r.recycler_id, r.capacity, len(string_split(r.waste_types, ', ')) AS n_types, {KM.format(a="l.", b="r.")} AS km
    FROM listings l JOIN (SELECT *, unnest(string_split(waste_types, ', ')) AS t FROM recyclers) r ON r.t = l.waste_type),
scored AS (SELECT *, 0.5 * exp(-km / 25.0) + 0.3 * least(1.0, capacity::DOUBLE / greatest(quantity_kg, 1)) + 0.2 / n_types AS s FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY waste_id ORDER BY s DESC, recycler_id) AS rank FROM scored)
"""


@query(
    "j_01_rank_recyclers",
    PAIRS + """SELECT waste_id, waste_type, quantity_kg, rank::INT AS rank, recycler_id, round(km, 1) AS distance_km, capacity, capacity >= quantity_kg AS can_absorb, round(s, 3) AS score,
        round(exp(-km / 25.0), 3) AS distance_score, round(least(1.0, capacity::DOUBLE / greatest(quantity_kg, 1)), 3) AS capacity_score, round(1.0 / n_types, 3) AS specialist_score
        FROM ranked WHERE rank <= 5""",
    "listings", "recyclers",
)
def j_01(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_recyclers(listings(spark, d), recyclers(spark, d), 5)


@query(
    "a_14_months_to_absorb",
    PAIRS + "SELECT waste_id, recycler_id, CASE WHEN capacity < quantity_kg THEN ceil(quantity_kg::DOUBLE / capacity)::BIGINT END AS months FROM ranked WHERE rank <= 3",
    "listings", "recyclers",
)
def a_14(spark: SparkSession, d: str) -> DataFrame:
    return ranking.months_to_absorb(ranking.rank_recyclers(listings(spark, d), recyclers(spark, d), 3)).select("waste_id", "recycler_id", "months")


@query(
    "a_13_match_listing",
    PAIRS + "SELECT waste_id, rank::INT AS rank, recycler_id, round(s, 3) AS score FROM ranked WHERE rank <= 5",
    "listings", "recyclers",
)
def a_13(spark: SparkSession, d: str) -> DataFrame:
    chosen = listings(spark, d).select("waste_id")  # the ids asked for: all of them
    return ranking.rank_recyclers(listings(spark, d).join(chosen, "waste_id", "left_semi"), recyclers(spark, d), 5).select("waste_id", "rank", "recycler_id", "score")


@query(
    "g_32_recycler_coverage",
    PAIRS + """, best AS (SELECT l.waste_id, l.waste_type, r.n_types, round(r.km, 1) AS km FROM listings l LEFT JOIN ranked r ON r.waste_id = l.waste_id AND r.rank = 1)
        SELECT waste_type, count(*) AS n, round(avg(CASE WHEN km IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage, round(avg(CASE WHEN n_types = 1 THEN 1.0 WHEN n_types > 1 THEN 0.0 END), 6) AS specialist, round(quantile_cont(km, 0.5), 4) AS median_km
        FROM best GROUP BY waste_type""",
    "listings", "recyclers",
)
def g_32(spark: SparkSession, d: str) -> DataFrame:
    best = ranking.rank_recyclers(listings(spark, d), recyclers(spark, d), 1).select(F.col("waste_id").alias("b"), "distance_km", "specialist_score")
    j = listings(spark, d).join(best, F.col("waste_id") == F.col("b"), "left")
    special = F.when(F.col("distance_km").isNotNull(), (F.col("specialist_score") == 1).cast("double"))
    j = cut(j.select("waste_type", "distance_km", special.alias("special")))
    median = quantiles(j, ["waste_type"], "distance_km", {"m": 0.5}).select(F.col("waste_type").alias("t"), F.round("m", 4).alias("median_km"))
    g = j.groupBy("waste_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("distance_km").isNotNull().cast("double")), 6).alias("coverage"), F.round(F.avg("special"), 6).alias("specialist"))
    return g.join(median, F.col("waste_type") == F.col("t"), "left").drop("t")


@query("a_01_haversine", f"SELECT waste_id, round({KM.format(a='p.', b='l.')}, 4) AS km FROM listings l, {PLACE} p", "listings")
def a_01(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).select("waste_id", F.round(haversine_km(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")), 4).alias("km"))


@query("a_02_distance_score", f"SELECT waste_id, round(exp(-({KM.format(a='p.', b='l.')}) / 25.0), 6) AS score FROM listings l, {PLACE} p", "listings")
def a_02(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).select("waste_id", F.round(distance_score(haversine_km(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))), 6).alias("score"))


SIM = "(waste_id * 7919 % 1009)::DOUBLE / 1000"
LISTED = f"""WITH sim AS (SELECT *, {SIM} AS similarity FROM listings), ends AS (SELECT min(similarity) AS lo, max(similarity) AS hi FROM sim),
    q AS (SELECT sim.*, {KM.format(a="p.", b="sim.")} AS km, CASE WHEN hi > lo THEN (similarity - lo) / (hi - lo) ELSE 1.0 END AS n,
          CASE quality WHEN 'good' THEN 1.0 WHEN 'fair' THEN 0.7 WHEN 'poor' THEN 0.4 ELSE 0.5 END AS ql FROM sim, ends, {PLACE} p)
"""


def with_similarity(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in similarity for the ranking rule alone; the text search is A-08 to A-10."""
    return listings(spark, d).withColumn("similarity", (F.col("waste_id") * 7919 % 1009).cast("double") / 1000)


@query(
    "a_04_rank_listings",
    LISTED + "SELECT waste_id, round(km, 1) AS distance_km, round(0.0 + 0.25 * exp(-km / 25.0) + 0.15 * ql + 0.6 * n, 3) AS score FROM q WHERE quantity_kg >= 1000 AND quality IN ('good', 'fair') ORDER BY 0.0 + 0.25 * exp(-km / 25.0) + 0.15 * ql + 0.6 * n DESC, quantity_kg DESC, waste_id LIMIT 25",
    "listings",
)
def a_04(spark: SparkSession, d: str) -> DataFrame:
    best = ranking.rank_listings(with_similarity(spark, d), 25, True, LAT, LON, min_quantity=1000, qualities=["good", "fair"])
    return best.select("waste_id", "distance_km", "score")


@query(
    "a_05_browse_listings",
    LISTED + "SELECT waste_id, round(0.625 * exp(-km / 25.0) + 0.375 * ql, 3) AS score FROM q WHERE waste_type = 'BUILDING' ORDER BY 0.625 * exp(-km / 25.0) + 0.375 * ql DESC, quantity_kg DESC, waste_id LIMIT 25",
    "listings",
)
def a_05(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_listings(listings(spark, d), 25, False, LAT, LON, waste_type="BUILDING").select("waste_id", "score")


@query("a_06_quality_weight", "SELECT waste_id, CASE quality WHEN 'good' THEN 1.0::DOUBLE WHEN 'fair' THEN 0.7::DOUBLE WHEN 'poor' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM listings", "listings")
def a_06(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).select("waste_id", labels.quality_weight(F.col("quality")).alias("weight"))


@query("w_07_normalise", f"WITH s AS (SELECT waste_id, {SIM} AS v FROM listings) SELECT waste_id, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS similarity FROM s", "listings")
def w_07(spark: SparkSession, d: str) -> DataFrame:
    return ranking.normalised(with_similarity(spark, d)).select("waste_id", F.round("similarity", 6).alias("similarity"))


@query("a_17_best_per_grade", LISTED + "SELECT quality, waste_id, quantity_kg FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, quantity_kg DESC, waste_id) AS r FROM q WHERE waste_type = 'BUILDING') WHERE r = 1", "listings")
def a_17(spark: SparkSession, d: str) -> DataFrame:
    df = ranking.normalised(with_similarity(spark, d)).where("waste_type = 'BUILDING'")
    return ranking.best_per_group(df, "quality", F.desc("similarity"), F.desc("quantity_kg"), F.col("waste_id")).select("quality", "waste_id", "quantity_kg")


@query("a_15_nearest_check", LISTED + ", b AS (SELECT * FROM q WHERE waste_type = 'BUILDING') SELECT waste_id, round(km, 1) <= min(round(km, 1)) OVER () AS is_nearest, quantity_kg >= 200000 AS covered FROM b ORDER BY 0.25 * exp(-km / 25.0) + 0.15 * ql + 0.6 * n DESC, quantity_kg DESC, waste_id LIMIT 40", "listings")
def a_15(spark: SparkSession, d: str) -> DataFrame:
    best = ranking.rank_listings(with_similarity(spark, d), 40, True, LAT, LON, waste_type="BUILDING")
    km = F.round(haversine_km(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")), 1)
    nearest = listings(spark, d).where("waste_type = 'BUILDING'").agg(F.min(km).alias("nearest"))
    return best.crossJoin(F.broadcast(nearest)).select("waste_id", (F.col("distance_km") <= F.col("nearest")).alias("is_nearest"), (F.col("quantity_kg") >= 200000).alias("covered"))


@query("a_16_cost_and_carbon", f"WITH {RATED} SELECT waste_id, CASE WHEN price > 0 THEN 500.0::DOUBLE * price END AS cost, round(500.0::DOUBLE * factor, 2) AS co2e_kg FROM saved", *CARBON)
def a_16(spark: SparkSession, d: str) -> DataFrame:
    r = rated(spark, d)
    return ranking.cost_and_carbon(r.drop("factor"), r.select("waste_id", "factor"), 500.0)


@query(
    "g_43_buyer_kpis",
    f"WITH {RATED} SELECT waste_type, quality, count(*) AS matches, sum(quantity_kg)::BIGINT AS available, min(CASE WHEN price > 0 THEN price * 500 END) AS lowest_cost, round(max(factor) * 500, 2) AS best_co2e FROM saved GROUP BY ALL",
    *CARBON,
)
def g_43(spark: SparkSession, d: str) -> DataFrame:
    g = rated(spark, d).groupBy("waste_type", "quality")
    return g.agg(F.count("*").alias("matches"), F.sum("quantity_kg").alias("available"), F.min(F.when(F.col("price") > 0, F.col("price") * 500)).alias("lowest_cost"), F.round(F.max("factor") * 500, 2).alias("best_co2e"))


# ---- carbon ----
@query("b_01_factor_resolution", f"WITH {RATED} SELECT waste_id, outcome, round(factor, 6) AS factor, is_proxy, source FROM saved", *CARBON)
def b_01(spark: SparkSession, d: str) -> DataFrame:
    return rated(spark, d).select("waste_id", "outcome", F.round("factor", 6).alias("factor"), "is_proxy", "source")


@query(
    "b_02_co2e_saved",
    f"WITH {RATED} SELECT waste_id, co2e_kg, round(CAST(CAST(quantity_kg AS DECIMAL(20,4)) * CAST(factor AS DECIMAL(18,8)) AS DECIMAL(38,12)) * 0.001, 3)::DOUBLE AS co2e_tonnes, CASE WHEN factor IS NULL THEN 'not available' WHEN is_proxy THEN 'proxy / conservative estimate' ELSE 'sourced factor (still an estimate)' END AS factor_label, CASE WHEN factor < 0.05 THEN 'low carbon value: diversion is the main benefit' ELSE '' END AS note FROM saved",
    *CARBON,
)
def b_02(spark: SparkSession, d: str) -> DataFrame:
    return rated(spark, d).select("waste_id", "co2e_kg", "co2e_tonnes", "factor_label", "note")


@query("j_02_factor_lookup", "SELECT waste_id, f.factor, m.mean_factor FROM listings l LEFT JOIN factors f ON f.sub_type = l.sub_type LEFT JOIN (SELECT waste_type, round(avg(factor), 6) AS mean_factor FROM factors GROUP BY 1) m ON m.waste_type = l.waste_type", *CARBON)
def j_02(spark: SparkSession, d: str) -> DataFrame:
    f = bind(spark, d, "factors")
    mean = carbon.type_factors(f).select("waste_type", F.round("mean_factor", 6).alias("mean_factor"))
    return listings(spark, d).join(bounded(f.select("sub_type", "factor")), "sub_type", "left").join(bounded(mean), "waste_type", "left").select("waste_id", "factor", "mean_factor")


@query("j_03_market_codes", "SELECT waste_id, coalesce(c.market_sub, l.sub_type) AS market_sub, coalesce(r.photo_sub, l.sub_type) AS photo_sub FROM listings l LEFT JOIN codes c ON c.waste_type = l.waste_type AND c.photo_sub = l.sub_type LEFT JOIN (SELECT waste_type, market_sub, min(photo_sub) AS photo_sub FROM codes GROUP BY ALL) r ON r.waste_type = l.waste_type AND r.market_sub = l.sub_type", *CARBON)
def j_03(spark: SparkSession, d: str) -> DataFrame:
    codes = bind(spark, d, "codes")
    return carbon.to_photo(carbon.to_market(listings(spark, d), codes), codes).select("waste_id", "market_sub", "photo_sub")


@query("b_03_listings_with_carbon", f"WITH {RATED} SELECT waste_id, co2e_kg, coalesce(is_proxy, false) AS is_proxy, 'catalogue' AS provenance FROM saved", *CARBON)
def b_03(spark: SparkSession, d: str) -> DataFrame:
    return rated(spark, d).select("waste_id", "co2e_kg", F.coalesce("is_proxy", F.lit(False)).alias("is_proxy"), F.lit("catalogue").alias("provenance"))


@query(
    "b_04_labels",
    "SELECT waste_id, CASE WHEN sub_type = 'unknown' THEN 'Not sure' ELSE concat(upper(substr(sub_type, 1, 1)), substr(sub_type, 2)) END AS sub_label, waste_type AS type_label, CASE WHEN quantity_kg % 700 < 160 THEN 'low' WHEN quantity_kg % 700 < 224 THEN 'fair' ELSE 'good' END AS verdict FROM listings",
    "listings",
)
def b_04(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).select("waste_id", labels.sub_label(F.col("sub_type")).alias("sub_label"), labels.type_label(F.col("waste_type")).alias("type_label"), labels.photo_verdict(F.col("quantity_kg") % 700).alias("verdict"))


@query("b_05_single_subtype", "SELECT t.waste_type, count(c.photo_sub) <= 1 AS single FROM (SELECT DISTINCT waste_type FROM listings) t LEFT JOIN codes c USING (waste_type) GROUP BY 1", *CARBON)
def b_05(spark: SparkSession, d: str) -> DataFrame:
    n = bind(spark, d, "codes").groupBy("waste_type").agg(F.count("*").alias("n"))
    return listings(spark, d).select("waste_type").distinct().join(bounded(n), "waste_type", "left").select("waste_type", (F.coalesce("n", F.lit(0)) <= 1).alias("single"))


#: A factor per part, with one link, two links, or none, and method and notes in all combinations.
PART_FACTORS = """SELECT concat(p_name, ' ', CAST(p_partkey AS VARCHAR(20))) AS sub_type, p_retailprice / 1000 AS factor,
    CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('https://www.', lower(p_type), '.example.org/', CAST(p_size AS VARCHAR(20)), ' ; http://other.example.com') WHEN 2 THEN concat(' http://', lower(p_type), '.example.net/a/b') ELSE 'https://www.example.org' END AS source_url,
    CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS basis, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END AS notes FROM part"""


@query(
    "b_06_factor_view",
    f"WITH factors AS ({PART_FACTORS}) SELECT sub_type, factor, trim(split_part(source_url, ';', 1)) AS url, regexp_replace(regexp_extract(trim(split_part(source_url, ';', 1)), '^[a-z]+://([^/]+)', 1), '^www\\.', '') AS domain, concat_ws(' - ', nullif(basis, ''), nullif(notes, '')) AS method FROM factors",
)
def b_06(spark: SparkSession, d: str) -> DataFrame:
    return carbon.factor_view(spark.sql(PART_FACTORS.replace("FROM part", "FROM {part}"), part=read(spark, d, "part")))


@query(
    "g_01_impact_totals",
    f"WITH {RATED} SELECT sum(quantity_kg)::BIGINT AS kg, sum(c)::DOUBLE AS co2e_kg, count(*) FILTER (c IS NULL) AS without_factor, round(sum(CASE WHEN is_proxy THEN c END)::DOUBLE / sum(c)::DOUBLE, 6) AS proxy_share FROM saved",
    *CARBON,
)
def g_01(spark: SparkSession, d: str) -> DataFrame:
    return carbon.impact_totals(rated(spark, d))


def _lever(by: str) -> str:
    return f"WITH {RATED} SELECT {by}, sum(c)::DOUBLE AS co2, sum(quantity_kg)::BIGINT AS kg, count(*) AS n, sum(CASE WHEN is_proxy THEN c ELSE 0 END)::DOUBLE AS proxy_co2 FROM saved WHERE c IS NOT NULL GROUP BY 1"


@query("g_02_levers_by_type", _lever("waste_type"), *CARBON)
def g_02(spark: SparkSession, d: str) -> DataFrame:
    return carbon.levers(rated(spark, d), "waste_type")


@query("g_02_levers_by_subtype", _lever("sub_type"), *CARBON)
def g_02b(spark: SparkSession, d: str) -> DataFrame:
    return carbon.levers(rated(spark, d), "sub_type")


@query(
    "g_03_zone_board",
    f"WITH {RATED}, cell AS (SELECT location_name, waste_type, count(*) AS n, sum(quantity_kg)::BIGINT AS kg, sum(coalesce(c, 0)) AS co2 FROM saved GROUP BY ALL) SELECT location_name, sum(n)::BIGINT AS n, sum(kg)::BIGINT AS kg, sum(co2)::DOUBLE AS co2, string_agg(concat(waste_type, '=', kg), ',' ORDER BY waste_type) AS mix FROM cell GROUP BY 1",
    *CARBON,
)
def g_03(spark: SparkSession, d: str) -> DataFrame:
    return carbon.zone_board(rated(spark, d))


@query("g_04_co2_ranking", f"WITH x AS ({_lever('sub_type').replace('WITH ', 'WITH ', 1)}) SELECT sub_type, co2, proxy_co2 > 0.5 * co2 AS mostly_proxy FROM x".replace("WITH x AS (WITH", "WITH x AS (WITH"), *CARBON)
def g_04(spark: SparkSession, d: str) -> DataFrame:
    return carbon.levers(rated(spark, d), "sub_type").select("sub_type", "co2", (F.col("proxy_co2") > 0.5 * F.col("co2")).alias("mostly_proxy"))


@query("g_05_kpis", f"WITH {RATED} SELECT sum(c)::DOUBLE AS total, round(sum(c)::DOUBLE / sum(quantity_kg), 6) AS per_kg, round(coalesce(sum(CASE WHEN is_proxy THEN c END)::DOUBLE / sum(c)::DOUBLE, 0), 6) AS proxy_share, count(*) AS n FROM saved WHERE c IS NOT NULL", *CARBON)
def g_05(spark: SparkSession, d: str) -> DataFrame:
    return carbon.kpis(rated(spark, d))


@query(
    "g_06_biggest_lever",
    f"""WITH {RATED}, t AS (SELECT waste_type, sum(c) AS co2, sum(CASE WHEN is_proxy THEN c ELSE 0 END) AS p FROM saved WHERE c IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
    z AS (SELECT location_name, sum(c) AS zc FROM saved JOIN t USING (waste_type) WHERE c IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
    SELECT waste_type, co2::DOUBLE AS type_co2, location_name, zc::DOUBLE AS zone_co2, round(zc::DOUBLE / co2::DOUBLE, 6) AS zone_share, CASE WHEN p::DOUBLE / co2::DOUBLE >= 0.999 THEN 'proxy' WHEN p::DOUBLE / co2::DOUBLE <= 0.001 THEN 'sourced' ELSE 'mixed' END AS basis FROM t, z""",
    *CARBON,
)
def g_06(spark: SparkSession, d: str) -> DataFrame:
    return carbon.biggest_lever(rated(spark, d))


@query("g_07_supply_by_type", "WITH o(waste_type, ord) AS (VALUES ('FURNITURE', 1), ('BUILDING', 2), ('MACHINERY', 3), ('AUTOMOBILE', 4), ('HOUSEHOLD', 5)) SELECT ord, o.waste_type, sum(quantity_kg)::BIGINT AS kg FROM o JOIN listings USING (waste_type) GROUP BY ALL", "listings")
def g_07(spark: SparkSession, d: str) -> DataFrame:
    order = spark.sql("SELECT * FROM VALUES ('FURNITURE', 1), ('BUILDING', 2), ('MACHINERY', 3), ('AUTOMOBILE', 4), ('HOUSEHOLD', 5) AS o(waste_type, ord)")
    kg = listings(spark, d).groupBy("waste_type").agg(F.sum("quantity_kg").alias("kg"))
    return kg.join(bounded(order), "waste_type").select("ord", "waste_type", "kg").orderBy("ord")


@query("g_08_zone_centroids", "SELECT location_name, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM listings GROUP BY 1", "listings")
def g_08(spark: SparkSession, d: str) -> DataFrame:
    return carbon.zone_centroids(listings(spark, d))


@query("g_09_price_ranges", "SELECT sub_type, quality, min(price) AS low, max(price) AS high FROM listings GROUP BY ALL", "listings")
def g_09(spark: SparkSession, d: str) -> DataFrame:
    return carbon.price_ranges(listings(spark, d))


@query("g_10_type_factors", "SELECT l.waste_type, round(m.mean_factor, 6) AS mean_factor, m.n_factors, m.sources, count(*) AS listings FROM listings l JOIN (SELECT waste_type, avg(factor) AS mean_factor, count(*) AS n_factors, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM factors GROUP BY 1) m USING (waste_type) GROUP BY ALL", *CARBON)
def g_10(spark: SparkSession, d: str) -> DataFrame:
    n = listings(spark, d).groupBy("waste_type").agg(F.count("*").alias("listings"))
    return n.join(bounded(carbon.type_factors(bind(spark, d, "factors"))), "waste_type").select("waste_type", F.round("mean_factor", 6).alias("mean_factor"), "n_factors", "sources", "listings")


@query("g_11_factor_kpis", "SELECT count(*) AS rows, count(*) FILTER (NOT is_proxy) AS sourced, count(*) FILTER (is_proxy) AS proxy, max_by(sub_type, factor) AS highest FROM (SELECT DISTINCT f.* FROM factors f JOIN listings l ON l.waste_type = f.waste_type)", *CARBON)
def g_11(spark: SparkSession, d: str) -> DataFrame:
    used = bind(spark, d, "factors").join(listings(spark, d).select("waste_type").distinct(), "waste_type", "left_semi")
    return carbon.factor_kpis(used)


@query("g_12_recyclers_per_type", "SELECT t AS waste_type, count(*) AS n FROM (SELECT unnest(string_split(waste_types, ', ')) AS t FROM recyclers) GROUP BY 1", "recyclers")
def g_12(spark: SparkSession, d: str) -> DataFrame:
    return recyclers(spark, d).select(F.explode("types").alias("waste_type")).groupBy("waste_type").agg(F.count("*").alias("n"))


@query("g_44_submission_rollup", f"WITH {RATED} SELECT waste_id // 10 AS submission, count(*) AS items, sum(quantity_kg)::BIGINT AS kg, sum(coalesce(c, 0))::DOUBLE AS co2e_kg, count(*) FILTER (c IS NULL) AS without_factor FROM saved GROUP BY 1", *CARBON)
def g_44(spark: SparkSession, d: str) -> DataFrame:
    r = rated(spark, d).withColumn("submission", F.floor(F.col("waste_id") / 10))
    return r.groupBy("submission").agg(F.count("*").alias("items"), F.sum("quantity_kg").alias("kg"), carbon.exact_sum(F.coalesce("co2e_kg", F.lit(0.0))).alias("co2e_kg"), F.count_if(F.col("co2e_kg").isNull()).alias("without_factor"))


@query("w_08_share_of_total", "WITH g AS (SELECT location_name, sum(quantity_kg)::BIGINT AS kg FROM listings GROUP BY 1) SELECT location_name, kg, round(kg::DOUBLE / sum(kg) OVER (), 6) AS share, round(kg::DOUBLE / max(kg) OVER (), 6) AS bar FROM g", "listings")
def w_08(spark: SparkSession, d: str) -> DataFrame:
    return carbon.share_of_total(listings(spark, d).groupBy("location_name").agg(F.sum("quantity_kg").alias("kg")), "kg")


# ---- filters, projections, set operations ----
@query("f_01_filter_listings", "SELECT waste_id FROM listings WHERE waste_type = 'BUILDING' AND quality = 'good' AND quantity_kg >= 100000", "listings")
def f_01(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).where("waste_type = 'BUILDING' and quality = 'good' and quantity_kg >= 100000").select("waste_id")


@query("f_02_filter_in", "SELECT waste_id FROM listings WHERE sub_type = '2-HIGH' AND quality IN ('fair', 'poor')", "listings")
def f_02(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).where(F.col("quality").isin("fair", "poor") & (F.col("sub_type") == "2-HIGH")).select("waste_id")


@query("f_03_point_lookup", "SELECT waste_id, quantity_kg FROM listings WHERE waste_id = 77", "listings")
def f_03(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).where("waste_id = 77").select("waste_id", "quantity_kg")


@query("f_04_accepts_type", "SELECT recycler_id FROM recyclers WHERE list_contains(string_split(waste_types, ', '), 'BUILDING')", "recyclers")
def f_04(spark: SparkSession, d: str) -> DataFrame:
    return recyclers(spark, d).where(F.array_contains("types", "BUILDING")).select("recycler_id")


@query("f_05_accepts_any", "SELECT recycler_id FROM recyclers WHERE list_has_any(string_split(waste_types, ', '), ['BUILDING', 'HOUSEHOLD'])", "recyclers")
def f_05(spark: SparkSession, d: str) -> DataFrame:
    return recyclers(spark, d).where(F.arrays_overlap("types", F.array(F.lit("BUILDING"), F.lit("HOUSEHOLD")))).select("recycler_id").orderBy("recycler_id")


@query("f_06_drop_unrated", f"WITH {RATED} SELECT waste_id, co2e_kg FROM saved WHERE co2e_kg IS NOT NULL", *CARBON)
def f_06(spark: SparkSession, d: str) -> DataFrame:
    return rated(spark, d).na.drop(subset=["co2e_kg"]).select("waste_id", "co2e_kg")


@query("f_07_chosen_types", "SELECT waste_id, waste_type FROM listings WHERE waste_type <> 'MACHINERY' AND waste_type IN ('BUILDING', 'FURNITURE')", "listings")
def f_07(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).where((F.col("waste_type") != "MACHINERY") & F.col("waste_type").isin("BUILDING", "FURNITURE")).select("waste_id", "waste_type")


@query("f_12_conditional_value", f"WITH {RATED} SELECT waste_id, CASE WHEN is_proxy THEN co2e_kg ELSE 0.0 END AS proxy_kg FROM saved WHERE co2e_kg IS NOT NULL", *CARBON)
def f_12(spark: SparkSession, d: str) -> DataFrame:
    return rated(spark, d).na.drop(subset=["co2e_kg"]).select("waste_id", F.when(F.col("is_proxy"), F.col("co2e_kg")).otherwise(F.lit(0.0)).alias("proxy_kg"))


@query("t_02_top_listings", "SELECT waste_id, quantity_kg FROM listings ORDER BY price DESC, quantity_kg DESC, waste_id LIMIT 20", "listings")
def t_02(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).orderBy(F.desc("price"), F.desc("quantity_kg"), "waste_id").limit(20).select("waste_id", "quantity_kg")


@query("t_01_top_recyclers", PAIRS + "SELECT recycler_id, round(s, 3) AS score FROM ranked WHERE waste_id = 3 AND rank <= 5", "listings", "recyclers")
def t_01(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_recyclers(listings(spark, d).where("waste_id = 3"), recyclers(spark, d), 5).select("recycler_id", "score")


@query("t_03_paging", "SELECT waste_id FROM listings ORDER BY waste_id LIMIT 30 OFFSET 60", "listings")
def t_03(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).select("waste_id").orderBy("waste_id").offset(60).limit(30)


@query("t_08_most_common", "SELECT location_name, count(*) AS n FROM listings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "listings")
def t_08(spark: SparkSession, d: str) -> DataFrame:
    return listings(spark, d).groupBy("location_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "location_name").limit(5)


@query("s_01_union_listings", "SELECT waste_id, waste_type, coalesce(pickup, '') AS pickup, provenance FROM (SELECT waste_id, waste_type, NULL AS pickup, 'catalogue' AS provenance FROM listings WHERE waste_id % 5 <> 0 UNION ALL SELECT waste_id, waste_type, location_name, 'session' FROM listings WHERE waste_id % 5 = 0)", "listings")
def s_01(spark: SparkSession, d: str) -> DataFrame:
    rows = listings(spark, d)
    catalogue = rows.where("waste_id % 5 <> 0").select("waste_id", "waste_type", F.lit("catalogue").alias("provenance"))
    session = rows.where("waste_id % 5 = 0").select("waste_id", "waste_type", F.col("location_name").alias("pickup"), F.lit("session").alias("provenance"))
    return catalogue.unionByName(session, allowMissingColumns=True).fillna({"pickup": ""}).select("waste_id", "waste_type", "pickup", "provenance")


@query("s_02_vocabulary", "SELECT sub_type, min(o) AS ord FROM (SELECT DISTINCT sub_type, 0 AS o FROM listings UNION ALL SELECT photo_sub, 1 FROM codes UNION ALL SELECT market_sub, 1 FROM codes) GROUP BY 1", *CARBON)
def s_02(spark: SparkSession, d: str) -> DataFrame:
    codes = bind(spark, d, "codes")
    market = listings(spark, d).select("sub_type").distinct().select("sub_type", F.lit(0).alias("ord"))
    photo = codes.select(F.explode(F.array("photo_sub", "market_sub")).alias("sub_type")).select("sub_type", F.lit(1).alias("ord"))
    return market.unionByName(photo).groupBy("sub_type").agg(F.min("ord").alias("ord")).orderBy("ord", "sub_type")
