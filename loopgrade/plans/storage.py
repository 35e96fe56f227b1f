"""Queries of the readers and writers: rows of the driver's tables are written in the format, by Spark, and read back through the reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopgrade.functions.session import bounded, ensure_checkpoint_dir
from loopgrade.plans.bindings import bind, read, sql
from loopgrade.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str, *bindings: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql(oracle, *bindings) if bindings else oracle
        return f

    return add


def folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def as_csv(table: DataFrame, schema) -> str:
    """``table`` as CSV with the columns of ``schema``; its path."""
    at = folder(table.sparkSession)
    files.write_rows(table, at, schema.fieldNames())
    return at


@query(
    "io_01_listings",
    """SELECT waste_id, waste_type, sub_type, quantity_kg, round(lat, 3) AS location_lat, 'the "' || quality || '" seller, ' || location_name AS seller_name,
    CASE WHEN price % 5 > 0 THEN price END AS price_per_kg, true AS is_synthetic FROM listings""",
    "listings",
)
def io_01(spark: SparkSession, d: str) -> DataFrame:
    seller = F.concat(F.lit('the "'), "quality", F.lit('" seller, '), "location_name")
    rows = bind(spark, d, "listings").select("*", F.col("lat").alias("location_lat"), F.col("lon").alias("location_lon"), seller.alias("seller_name"), F.lit(None).cast("string").alias("seller_contact"), F.when(F.col("price") % 5 > 0, F.col("price")).alias("price_per_kg"), F.lit("d").alias("description"))
    got = files.read_listings(spark, as_csv(rows, files.LISTINGS))
    return got.select("waste_id", "waste_type", "sub_type", "quantity_kg", F.round("location_lat", 3).alias("location_lat"), "seller_name", "price_per_kg", "is_synthetic")


@query("io_02_recyclers", "SELECT recycler_id, name, replace(waste_types, ', ', '|') AS types, capacity AS capacity_kg_per_month FROM recyclers", "recyclers")
def io_02(spark: SparkSession, d: str) -> DataFrame:
    got = files.read_recyclers(spark, as_csv(bind(spark, d, "recyclers").withColumnRenamed("capacity", "capacity_kg_per_month"), files.RECYCLERS))
    return got.select("recycler_id", "name", F.array_join("types", "|").alias("types"), "capacity_kg_per_month")


@query("io_03_factors", "SELECT concat(p_name, ' ', p_partkey) AS sub_type, round(p_retailprice / 1000, 6) AS factor, p_partkey % 6 IN (0, 1) AS is_proxy FROM part")
def io_03(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    text = F.when(k == 0, "TRUE").when(k == 1, " true ").when(k == 2, "false").when(k == 3, "yes").when(k == 4, "1")
    none = F.lit(None).cast("string")
    rows = read(spark, d, "part").select(
        F.concat("p_name", F.lit(" "), "p_partkey").alias("sub_type"), F.col("p_type").alias("waste_type"), (F.col("p_retailprice") / 1000).alias("co2e_saved_kg_per_kg"), F.lit("b").alias("factor_basis"),
        text.alias("is_proxy"), F.lit("s").alias("source"), none.alias("source_url"), none.alias("notes"),
    )
    return files.read_factors(spark, as_csv(rows, files.FACTORS)).select("sub_type", F.round("co2e_saved_kg_per_kg", 6).alias("factor"), "is_proxy")


@query("io_04_profiles", "SELECT r.recycler_id, r.name, CASE WHEN r.recycler_id % 4 > 0 THEN 'area ' || s_nationkey END AS area, CASE WHEN r.recycler_id % 4 > 0 THEN r.recycler_id % 3 = 0 END AS is_sample_profile FROM recyclers r JOIN supplier ON s_suppkey = recycler_id", "recyclers")
def io_04(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    text = {c: F.concat(F.lit(f"{c} "), "s_nationkey") for c in ("address", "area", "phone", "email", "website", "profile_note")}
    rows = read(spark, d, "supplier").where(key % 4 > 0).select(key.alias("recycler_id"), (key % 3 == 0).alias("is_sample_profile"), *[v.alias(c) for c, v in text.items()])
    profiles = files.read_profiles(spark, as_csv(rows, files.PROFILES))
    return bind(spark, d, "recyclers").join(bounded(profiles.select("recycler_id", "area", "is_sample_profile")), "recycler_id", "left").select("recycler_id", "name", "area", "is_sample_profile")


def mapping(spark: SparkSession, d: str) -> str:
    """A label per part; every ninth without type, every seventh without sub-type."""
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(
        F.concat(F.lit("set"), k % 3).alias("dataset"), F.concat(F.lit(" Part "), k).alias("source_label"), F.when(k % 9 > 0, F.concat(F.lit("type "), F.col("p_size") % 5)).alias("canonical_waste_type"),
        F.when(k % 7 > 0, F.concat(F.lit(" sub "), F.col("p_size") % 11)).otherwise(" ").alias("canonical_sub_type"), F.lit("mapped").alias("status"), F.lit(None).cast("string").alias("notes"),
    )
    return as_csv(rows, files.MAPPING)


@query("io_05_hierarchy", "SELECT 'type ' || p_size % 5 AS waste_type, string_agg(DISTINCT 'sub ' || p_size % 11, ',' ORDER BY 'sub ' || p_size % 11) AS subs FROM part WHERE p_partkey % 9 > 0 AND p_partkey % 7 > 0 GROUP BY 1")
def io_05(spark: SparkSession, d: str) -> DataFrame:
    return files.hierarchy(files.read_mapping(spark, mapping(spark, d))).select("waste_type", F.array_join("subs", ",").alias("subs"))


@query("io_06_mapping", "SELECT 'set' || p_partkey % 3 AS dataset, 'part ' || p_partkey AS label_key, CASE WHEN p_partkey % 9 > 0 THEN 'type ' || p_size % 5 END AS waste_type FROM part")
def io_06(spark: SparkSession, d: str) -> DataFrame:
    return files.read_mapping(spark, mapping(spark, d)).select("dataset", "label_key", F.col("canonical_waste_type").alias("waste_type"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """The feedback log of the bindings in the columns of its file."""
    k = F.col("seq")
    own = {
        "id": k.cast("string"), "created_at": F.col("created_at").cast("string"), "item_key": F.col("item_key").cast("string"), "predicted_label": F.col("predicted"), "actual_label": F.col("actual"), "is_correct": F.col("is_correct"),
        "image_sha256": F.transform(F.sequence(F.lit(1), F.col("n_photos").cast("int")), lambda i: F.concat(F.lit("s"), i)), "predicted_confidence": (k % 100) / 100,
    }
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in files.ANSWER.fields if f.name not in own]
    return bind(spark, d, "answers").select(*[v.alias(c) for c, v in own.items()], *rest)


@query("io_07_answers", "SELECT CAST(seq AS VARCHAR) AS id, CAST(item_key AS VARCHAR) AS item_key, actual AS actual_label, n_photos AS photos, is_correct FROM answers WHERE seq % 13 <> 0", "answers")
def io_07(spark: SparkSession, d: str) -> DataFrame:
    """Every 13th line is half written, and a blank line follows every seventh."""
    rows = records(spark, d).select(F.col("id").cast("long").alias("k"), F.to_json(F.struct("*")).alias("line"))
    broken = F.when(F.col("k") % 13 == 0, F.expr("left(line, char_length(line) div 2)")).when(F.col("k") % 7 == 0, F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    at = folder(spark)
    rows.select(broken.alias("value")).write.text(at)
    return files.read_answers(spark, at).select("id", "item_key", "actual_label", F.size("image_sha256").cast("long").alias("photos"), "is_correct")


@query("io_08_append", "SELECT CAST(item_key AS VARCHAR) AS item_key, count(*) AS n FROM answers GROUP BY 1", "answers")
def io_08(spark: SparkSession, d: str) -> DataFrame:
    at, rows = folder(spark), records(spark, d)
    for part in (F.col("is_correct"), ~F.col("is_correct")):  # two appends
        files.append_answers(rows.where(part), at)
    return files.read_answers(spark, at).groupBy("item_key").agg(F.count("*").alias("n"))


@query("io_13_photo_store", "SELECT DISTINCT sha256(text) AS sha, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL")
def io_13(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("text").cast("binary")
    photos = read(spark, d, "documents").where("text is not null").select(F.sha2(content, 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"), content.alias("content"), "lang")
    at = folder(spark)
    files.store_new(photos.where("lang <> 'en'").drop("lang"), at, 1 << 62)
    files.store_new(photos.drop("lang"), at, 1 << 62)  # finds the first part stored
    return spark.read.parquet(at).select("sha", "bytes")


@query("io_14_manifest_table", "SELECT source || '/' || doc_id AS path, md5(text) AS md5 FROM documents")
def io_14(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    files.write_tsv(read(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("md5")), at)
    return spark.read.schema("path string, md5 string").option("header", True).option("sep", "\t").csv(at)


@query("io_15_result_rows", "SELECT id, truth, pred, confidence FROM classified", "classified")
def io_15(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    files.write_rows(bind(spark, d, "classified"), at, ["id", "truth", "pred", "confidence"])
    return spark.read.schema("id long, truth string, pred string, confidence double").option("header", True).csv(at)


@query("io_16_metrics", "SELECT count(*) AS n, round(avg((truth = pred)::INT), 6) AS accuracy, count(DISTINCT truth) AS classes FROM classified", "classified")
def io_16(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    files.write_metrics(bind(spark, d, "classified").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.count_distinct("truth").alias("classes")), at)
    return spark.read.schema("n long, accuracy double, classes long").json(at)


@query("io_17_vector_cache", "WITH c AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE lang = 'en') SELECT doc_id AS id, CASE WHEN sha256(text) IN (SELECT sha FROM c) THEN -1 ELSE strlen(text) END::DOUBLE AS x FROM documents WHERE text IS NOT NULL")
def io_17(spark: SparkSession, d: str) -> DataFrame:
    texts = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", "lang")
    cached = texts.where("lang = 'en'").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).distinct()
    vector = lambda x: F.array(x.cast("double")).alias("embedding")
    cache = cached.select(F.lit("now").alias("model"), "sha", vector(F.lit(-1))).unionByName(texts.select(F.lit("before").alias("model"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), vector(F.lit(-2))))
    got = files.embed_new(texts.select("id", "text"), cache, "now", lambda new: new.select("sha", vector(F.octet_length("text"))))
    return got.select("id", F.get("embedding", F.lit(0)).alias("x"))


def manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents before and after: every 50th is new, every 60th is gone, every 70th says something else."""
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("sha")
    now = F.when(F.col("doc_id") % 70 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return rows.where("doc_id % 50 <> 1").select("path", sha(F.col("text"))), rows.where("doc_id % 60 <> 2").select("path", sha(now))


TREE = """WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS sha FROM documents), l2 AS (SELECT substr(md5(path), 1, 2) AS node, sha256(string_agg(concat(path, ' ', sha), chr(10) ORDER BY concat(path, ' ', sha))) AS digest, count(*) AS n FROM m GROUP BY 1),
    l1 AS (SELECT substr(node, 1, 1) AS node, sha256(string_agg(concat(node, ' ', digest), chr(10) ORDER BY node)) AS digest, sum(n)::BIGINT AS n FROM l2 GROUP BY 1), l0 AS (SELECT '' AS node, sha256(string_agg(concat(node, ' ', digest), chr(10) ORDER BY node)) AS digest, sum(n)::BIGINT AS n FROM l1)"""


@query("io_17_digest_tree", TREE + " SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0")
def io_17b(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    return files.digest_tree(rows, 2)


@query("io_17_changes", "WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS t FROM documents WHERE doc_id % 50 <> 1), b AS (SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 70 = 3 THEN concat(coalesce(text, ''), '!') ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id % 60 <> 2) SELECT path, CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.t IS DISTINCT FROM b.t")
def io_17c(spark: SparkSession, d: str) -> DataFrame:
    return files.changes(*manifests(spark, d))
