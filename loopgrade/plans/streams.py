"""Streaming queries: every stream reads the events table to its end and must equal its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopgrade.functions.session import ensure_checkpoint_dir
from loopgrade.operators import dimensions, feedback, vectors
from loopgrade.plans.bindings import bind, read, sql
from loopgrade.plans.learning import LATEST, MEMORY_T, NEAR
from loopgrade.plans.market import PAIRS
from loopgrade.sources import files
from loopgrade.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def query(name: str, oracle: str | None = None, *bindings: str):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle, *bindings) if bindings else oracle
        return f

    return add


def folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def answer_stream(spark: SparkSession, d: str) -> DataFrame:
    """The feedback log of the bindings, as a stream."""
    e = jobs.read_log(spark, f"{d}/event[s].parquet", EVENTS)  # as a glob: the source refuses the path of a single file
    other = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    ok = F.col("event_id") % 3 != 0
    actual = F.when(F.col("event_id") % 17 == 0, F.lit(None)).when(ok, F.col("event_type")).otherwise(other)
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("item_key"), F.col("ts").cast("timestamp").alias("created_at"), ok.alias("is_correct"), F.col("event_type").alias("predicted"), actual.alias("actual")
    )


@query("st_01_latest_stream", LATEST + "SELECT item_key, seq, actual FROM latest", "answers")
def st_01(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    jobs.upsert_latest(answer_stream(spark, d), f"{at}/store", f"{at}/check").awaitTermination()
    return jobs.read_latest(spark, f"{at}/store").select("item_key", "seq", "actual")


@query("st_02_summary_stream", LATEST + "SELECT count(*) AS n, count(*) FILTER (is_correct) AS correct, round(count(*) FILTER (is_correct) / count(*), 6) AS accuracy, count(*) FILTER (actual = 'other') AS n_other FROM latest", "answers")
def st_02(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    jobs.summary_stream(answer_stream(spark, d), f"{at}/store", f"{at}/check").awaitTermination()
    return jobs.read_summary(spark, f"{at}/store")


@query("st_03_new_photos", "SELECT DISTINCT user_id % 1000 AS sha FROM events")
def st_03(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    rows = answer_stream(spark, d).select((F.col("item_key") % 1000).alias("sha"), "created_at")
    jobs.deliver(jobs.new_photos(rows, "60 days"), f"{at}/out", f"{at}/check").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("sha")


@query("st_04_deliver", "SELECT event_id AS seq FROM events")
def st_04(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    jobs.deliver(answer_stream(spark, d).select("seq"), f"{at}/out", f"{at}/check").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("seq")


@query("st_05_restore", "SELECT event_id, event_type FROM events")
def st_05(spark: SparkSession, d: str) -> DataFrame:
    return jobs.restore(spark, f"{folder(spark)}/missing", f"{d}/events.parquet", EVENTS).select("event_id", "event_type")


@query("st_06_memory_join", f"WITH {NEAR} SELECT id, count(*) AS n_similar, round(min(distance), 5) AS nearest, arg_min(label, struct_pack(d := round(distance, 9), m := mem_id)) AS remembered FROM near GROUP BY 1")
def st_06(spark: SparkSession, d: str) -> DataFrame:
    """Photos arrive as vectors and meet the confirmed ones within the memory's radius."""
    at = folder(spark)
    v = read(spark, d, "embeddings").where("vec_id % 7 = 0").select(F.col("vec_id").alias("mem_id"), "label", "embedding")
    jobs.write_generation(v, f"{at}/memory", 0)
    photos = jobs.read_log(spark, f"{d}/embedding[s].parquet", "vec_id long, embedding array<float>, label int").where("vec_id % 7 <> 0").select(F.col("vec_id").alias("id"), "embedding")

    def apply(batch: DataFrame, memory: DataFrame) -> DataFrame:
        near = vectors.within(batch, memory, MEMORY_T)
        return near.groupBy("id").agg(F.count("*").alias("n_similar"), F.round(F.min("distance"), 5).alias("nearest"), F.min_by("label", F.struct(F.round("distance", 9).alias("d"), "mem_id")).alias("remembered"))

    jobs.with_memory(photos, lambda s: jobs.read_last(s, f"{at}/memory"), apply, f"{at}/out", f"{at}/check").awaitTermination()
    return spark.read.parquet(f"{at}/out").drop("batch")


TREND = "SELECT date_trunc('day', ts) AS start, count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS correct, round(count(*) FILTER (event_id % 3 <> 0) / count(*), 6) AS accuracy FROM events GROUP BY 1"


@query("st_07_trend_stream", TREND)
def st_07(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    jobs.trend_stream(answer_stream(spark, d), f"{at}/out", f"{at}/check").awaitTermination()
    return jobs.read_trend(spark, f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st_07_trend_batch", TREND)
def st_07b(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 3 != 0).alias("is_correct"))
    return jobs.trend(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st_07_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS item_key, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def st_07c(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("item_key"))
    return jobs.sessions(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


# ---- validation, static dimension, memory entries, ids ----
@query(
    "a_18_validate",
    """SELECT waste_id, concat_ws(',', CASE WHEN quantity_kg % 7 = 0 OR quantity_kg % 10 = 3 THEN 'quantity' END, CASE WHEN quality = 'poor' THEN 'quality' END, CASE WHEN price % 19 = 0 THEN 'place' END, CASE WHEN price % 31 = 2 THEN 'price' END, CASE WHEN price % 11 = 0 THEN 'phone' END,
    CASE WHEN price % 13 = 0 THEN 'sub_type' END, CASE WHEN price % 17 < 2 THEN 'location' END, CASE WHEN price % 23 = 0 THEN 'seller' END, CASE WHEN price % 29 = 1 THEN 'contact' END, CASE WHEN price % 37 = 3 THEN 'description' END) AS errors FROM listings""",
    "listings",
)
def a_18(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("price")
    chars = lambda n: F.repeat(F.lit("ü"), n)
    new = {
        "sub_type": F.when(p % 13 == 0, chars(61)).when(p % 13 == 1, F.lit(None)).otherwise(chars(60)),
        "quantity_kg": F.when(F.col("quantity_kg") % 7 == 0, 0).when(F.col("quantity_kg") % 10 == 3, 100_000_001).otherwise(100_000_000),
        "quality": F.when(F.col("quality") == "poor", "bad").otherwise(F.col("quality")),
        "location_name": F.when(p % 17 == 0, "").when(p % 17 == 1, chars(121)).otherwise(chars(120)),
        "lat": F.when(p % 19 == 0, F.lit(90.5)).otherwise(F.lit(-90.0)),
        "seller_name": F.when(p % 23 == 0, F.lit(None)).otherwise("s"),
        "seller_contact": F.when(p % 29 == 1, chars(41)).when(p % 29 == 2, chars(40)),
        "price": F.when(p % 31 == 2, 1_000_001).when(p % 31 != 3, 1_000_000),
        "description": F.when(p % 37 == 3, chars(2001)).otherwise(""),
        "phone": F.when(p % 11 == 0, "12+34567").otherwise("+441234567890"),
    }
    return files.validate(bind(spark, d, "listings").withColumns(new), files.listing_rules(texts=True)).select("waste_id", F.array_join("errors", ",").alias("errors"))


@query(
    "a_18_match_requests",
    "SELECT o_orderkey AS request, concat_ws(',', CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 4 = 1 THEN 'id or fields' END, CASE WHEN o_orderkey % 5 = 0 THEN 'quantity' END, CASE WHEN o_orderkey % 7 = 0 THEN 'place' END, CASE WHEN o_orderkey % 52 NOT BETWEEN 1 AND 50 THEN 'top_k' END) AS errors FROM orders",
)
def a_18b(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(
        k.alias("request"), F.when(k % 3 == 0, k).alias("waste_id"), F.when(k % 4 != 1, F.col("o_orderstatus")).alias("waste_type"), F.lit(None).cast("string").alias("sub_type"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("quantity_kg"), F.when(k % 7 == 0, F.lit(-91.0)).otherwise(F.lit(12.0)).alias("lat"), F.lit(77.0).alias("lon"), (k % 52).alias("top_k"),
    )
    return files.validate(rows, files.match_rules()).select("request", F.array_join("errors", ",").alias("errors"))


@query("a_19_publish_ids", "SELECT waste_id AS source_id, (SELECT max(waste_id) FROM listings) + row_number() OVER (ORDER BY waste_id) AS waste_id FROM (SELECT * FROM listings WHERE waste_id % 50 = 7 ORDER BY waste_id LIMIT 1000)", "listings")
def a_19(spark: SparkSession, d: str) -> DataFrame:
    rows = bind(spark, d, "listings")
    new = rows.where("waste_id % 50 = 7").select(F.col("waste_id").alias("source_id"))  # the rows being published
    return files.append_listings(rows, new, "source_id").select("source_id", "waste_id")


#: Guidance per type of the driver's tables; one type has none, and one has no route after its second step.
ROUTES = "SELECT * FROM (VALUES ('AUTOMOBILE', 'mostly', 'drain it', 4, CAST(NULL AS INT)), ('BUILDING', 'as aggregate', 'keep it dry', 4, CAST(NULL AS INT)), ('FURNITURE', 'partly', 'stack it', 3, 3), ('HOUSEHOLD', 'hardly', 'sort it', 4, 2)) AS t(waste_type, recyclability, handling, n_steps, broken_from)"


@query("b_08_facts", f"WITH routes AS ({ROUTES}) SELECT t.waste_type, recyclability, handling, coalesce(broken_from - 1, n_steps) AS open_steps, f.m AS co2e_per_kg, coalesce(r.n, 0) AS recyclers FROM (SELECT DISTINCT waste_type FROM listings) t LEFT JOIN routes USING (waste_type) LEFT JOIN (SELECT waste_type, round(avg(factor), 6) AS m FROM factors GROUP BY 1) f USING (waste_type) LEFT JOIN (SELECT t AS waste_type, count(*) AS n FROM (SELECT unnest(string_split(waste_types, ', ')) AS t FROM recyclers) GROUP BY 1) r USING (waste_type)", "listings", "factors", "recyclers")
def b_08(spark: SparkSession, d: str) -> DataFrame:
    from loopgrade.operators.ranking import split_types

    n = bind(spark, d, "recyclers").select(F.explode(split_types(F.col("waste_types"))).alias("waste_type")).groupBy("waste_type").agg(F.count("*").alias("recyclers"))
    routes = spark.sql(ROUTES).withColumn("steps", F.transform(F.sequence(F.lit(1), F.col("n_steps")), lambda i: F.concat(F.lit("step "), i)))
    return dimensions.facts(bind(spark, d, "listings").select("waste_type").distinct(), routes, bind(spark, d, "factors"), n)


@query("d_11_memory_entries", "SELECT vec_id AS sha, event_type AS label, count(*) AS n FROM events JOIN embeddings ON vec_id IN (event_id % 700, event_id % 300) GROUP BY ALL")
def d_11(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "events").select(F.array_distinct(F.array(F.col("event_id") % 700, F.col("event_id") % 300)).alias("shas"), F.col("event_type").alias("label"))
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("sha"), "embedding")
    return dimensions.memory_entries(a, v).groupBy("sha", "label").agg(F.count("*").alias("n"))


@query("d_11_missing_vectors", "SELECT DISTINCT event_id % 700 AS sha FROM events WHERE event_id % 700 NOT IN (SELECT vec_id FROM embeddings)")
def d_11b(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "events").select(F.array(F.col("event_id") % 700).alias("shas"))
    return dimensions.missing_vectors(a, read(spark, d, "embeddings").select(F.col("vec_id").alias("sha")))


@query("w_03_first_relevant", PAIRS + "SELECT waste_id, min(rank) FILTER (n_types = 1) AS first_specialist FROM ranked WHERE rank <= 5 GROUP BY 1", "listings", "recyclers")
def w_03(spark: SparkSession, d: str) -> DataFrame:
    from loopgrade.plans.market import listings, ranking, recyclers

    r = ranking.rank_recyclers(listings(spark, d), recyclers(spark, d), 5)
    return r.groupBy("waste_id").agg(F.min(F.when(F.col("specialist_score") == 1, F.col("rank"))).cast("long").alias("first_specialist"))


@query("io_11_path_parts", "SELECT doc_id AS id, lang AS label, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' END AS split FROM documents")
def io_11(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    top = F.when(k == 0, "Training").when(k == 1, "valid").when(k == 2, "testing/train").otherwise("extra")  # of two folders the first counts
    label, split = files.path_parts(F.concat_ws("/", F.lit("/data"), top, "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), label.alias("label"), split.alias("split"))
