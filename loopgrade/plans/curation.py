"""Queries of the search, near-duplicate and curation operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopgrade.functions.session import bounded, cut, written
from loopgrade.operators import curate, evaluate, inverted, search, vectors
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


# ---- text search: catalogue = documents, queries = benchmark ----
def _counts(name: str, table: str, key: str) -> str:
    return f"""{name}_w AS (SELECT {key} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {table}),
    {name}_t AS (SELECT id, unnest(w) AS term FROM {name}_w UNION ALL SELECT id, concat(w[i], ' ', w[i + 1]) FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM {name}_w)),
    {name}_c AS (SELECT id, term, count(*) AS n FROM {name}_t GROUP BY ALL)"""


def _weights(name: str) -> str:
    return f"""{name}_r AS (SELECT id, term, (1 + ln(n::DOUBLE)) * idf AS w FROM {name}_c JOIN idf USING (term)),
    {name}_n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}_r GROUP BY 1), {name} AS (SELECT r.id, term, w / norm AS weight FROM {name}_r r JOIN {name}_n USING (id))"""


INDEX = f"WITH {_counts('cat', 'documents', 'doc_id')}, idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM cat_c GROUP BY 1), {_weights('cat')}"
SCORES = f"{INDEX}, {_counts('q', 'benchmark', 'item_id')}, {_weights('q')}, sim AS (SELECT q.id AS query_id, cat.id, sum(q.weight * cat.weight) AS similarity FROM q JOIN cat USING (term) GROUP BY ALL)"


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


_INDEXES: dict = {}


def text_index(spark: SparkSession, d: str) -> inverted.Index:
    """The catalogue's block-max index, labelled by source: written once for a session and an input folder, then read by every search."""
    key = spark.sparkContext.applicationId, d
    if key in _INDEXES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_INDEXES[key].packed.inputFiles()[0])
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # the shared folder was cleared
            del _INDEXES[key]
    if key not in _INDEXES:
        _INDEXES[key] = inverted.build(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source"), "source")
    return _INDEXES[key]


def searched(spark: SparkSession, d: str, k: int | None) -> DataFrame:
    index = text_index(spark, d)
    return inverted.search(index, inverted.vectors(index, asked(spark, d)), k)


@query("a_08_tfidf_index", INDEX + " SELECT id, count(*) AS terms, round(max(weight), 5) AS top_weight, round(sum(weight), 4) AS total_weight FROM cat GROUP BY 1")
def a_08(spark: SparkSession, d: str) -> DataFrame:
    docs = inverted.build(catalogue(spark, d), stats=True).docs
    each = docs.select(F.explode(F.arrays_zip("ids", "counts", "tops", "sums")).alias("x")).where("x.counts > 0")
    return each.select(F.col("x.ids").alias("id"), F.col("x.counts").cast("long").alias("terms"), F.round("x.tops", 5).alias("top_weight"), F.round("x.sums", 4).alias("total_weight"))


@query("a_09_query_similarity", SCORES + " SELECT query_id, id, rank, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM sim) WHERE rank <= 10")
def a_09(spark: SparkSession, d: str) -> DataFrame:
    return searched(spark, d, 10).select("query_id", "id", "rank", F.round("similarity", 5).alias("similarity"))


@query("a_10_new_texts", INDEX + f", {_counts('q', 'pages', 'page_id').replace('lower(text)', 'lower(url)')}, {_weights('q')} SELECT id, count(*) AS terms, round(max(weight), 5) AS top_weight FROM q GROUP BY 1")
def a_10(spark: SparkSession, d: str) -> DataFrame:
    fresh = read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    weighed = inverted.weigh(text_index(spark, d), fresh).where(F.size("terms") > 0)
    return weighed.select("id", F.size("terms").cast("long").alias("terms"), F.round(F.array_max("weights"), 5).alias("top_weight"))


@query("j_04_similarity_pairs", SCORES + " SELECT query_id, count(*) AS pairs, round(max(similarity), 5) AS best FROM sim GROUP BY 1")
def j_04(spark: SparkSession, d: str) -> DataFrame:
    return searched(spark, d, None).groupBy("query_id").agg(F.count("*").alias("pairs"), F.round(F.max("similarity"), 5).alias("best"))


#: A query asks for one sub-type (a source), which is of one of four types. The ranking is over all documents; those that share no term come last.
TYPE = "concat('g', CAST(CAST(substr({c}, 4) AS INT) % 4 AS {text}))"
RETRIEVAL = SCORES + f""", a AS (SELECT item_id AS query_id, concat('src', item_id % 20) AS label FROM benchmark), f AS (SELECT a.query_id, label, d.doc_id AS id, source, coalesce(similarity, 0) AS s FROM a CROSS JOIN documents d LEFT JOIN sim ON sim.query_id = a.query_id AND sim.id = d.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM f), g AS (SELECT query_id, round(count(*) FILTER (rank <= 10 AND s > 0 AND source = label) / 10, 6) AS precision_at_k, round(count(*) FILTER (rank <= 10 AND s > 0 AND {TYPE.format(c='source', text='VARCHAR')} = {TYPE.format(c='label', text='VARCHAR')}) / 10, 6) AS type_precision_at_k,
    min(rank) FILTER (source = label) AS first_rank FROM r GROUP BY 1), e AS (SELECT *, round(coalesce(1.0 / first_rank, 0), 6) AS rr FROM g)"""


def retrieval(spark: SparkSession, d: str) -> DataFrame:
    index = text_index(spark, d)
    q = inverted.vectors(index, asked(spark, d).withColumn("label", F.concat(F.lit("src"), F.col("id") % 20)), "label")
    sources = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    best = inverted.search(index, q, 10).join(q.select("query_id", "label"), "query_id")
    kind = lambda c: F.expr(TYPE.format(c=c, text="STRING"))
    best = sources.join(bounded(cut(best)), "id").select("query_id", "rank", (F.col("source") == F.col("label")).alias("relevant"), (kind("source") == kind("label")).alias("type_relevant"))
    return evaluate.retrieval(best, inverted.first_rank(index, q, "label"), 10)


@query("g_31_retrieval", RETRIEVAL + " SELECT * FROM e")
def g_31(spark: SparkSession, d: str) -> DataFrame:
    return retrieval(spark, d)


@query("g_31_means", RETRIEVAL + " SELECT count(*) AS queries, round(avg(precision_at_k), 6) AS mean_precision_at_k, round(avg(type_precision_at_k), 6) AS mean_type_precision_at_k, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM e")
def g_31b(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.mean_retrieval(retrieval(spark, d))


@query("a_12_backend", SCORES + " SELECT query_id, id FROM sim QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) = 1")
def a_12(spark: SparkSession, d: str) -> DataFrame:
    return searched(spark, d, 1).select("query_id", "id")


#: The text of a listing, with abbreviations in every place a listing has them.
LISTING = "replace(sub_type, '_', ' ') || ' ' || replace(waste_type, '_', ' ') || ' waste, ' || quality || ' quality, ' || location_name || '. ' || "


@query("a_07_listing_text", f"SELECT waste_id, {LISTING} CASE waste_id % 4 WHEN 0 THEN 'clean PET polyethylene terephthalate flakes' WHEN 1 THEN 'PETS PCB, PP polypropylene' WHEN 2 THEN 'HDPE high-density polyethylene drums and LDPE low-density polyethylene film' ELSE 'PP polypropylene caps' END AS text FROM listings", "listings")
def a_07(spark: SparkSession, d: str) -> DataFrame:
    note = F.element_at(F.array(*[F.lit(x) for x in NOTES]), (F.col("waste_id") % 4 + 1).cast("int"))
    return bind(spark, d, "listings").select("waste_id", search.listing_text(*[F.col(c) for c in ("waste_type", "sub_type", "quality", "location_name")], note).alias("text"))


#: Needs of nations: one in five only browses, some have a place and filters. Every thousandth listing is one of this session, so it isn't in the index.
NEEDS = """SELECT n_nationkey AS need_id, CASE WHEN n_nationkey % 5 = 4 THEN ' ' ELSE concat(n_name, ' ', CASE n_nationkey % 3 WHEN 0 THEN 'building HDPE drums, good quality' WHEN 1 THEN 'clean polyethylene terephthalate flakes of furniture' ELSE 'urgent printed circuit board' END) END AS text,
    CASE WHEN n_nationkey % 4 < 3 THEN CAST(12.9 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) / 100 END AS lat, CASE WHEN n_nationkey % 4 < 3 THEN CAST(77.6 AS DOUBLE) END AS lon, CASE WHEN n_nationkey % 6 = 1 THEN 'BUILDING' END AS waste_type, CASE WHEN n_nationkey % 7 = 2 THEN '2-HIGH' END AS sub_type,
    CASE WHEN n_nationkey % 3 = 0 THEN CAST(50000 AS DOUBLE) END AS min_quantity, CASE WHEN n_nationkey % 2 = 0 THEN 'good,fair' END AS grades FROM nation"""
NOTES = ("clean PET flakes", "PETS  PCB, PP", "HDPE drums and LDPE film", "PP caps")
_NOTED = "CASE waste_id % 4 WHEN 0 THEN 'clean PET polyethylene terephthalate flakes' WHEN 1 THEN 'PETS PCB, PP polypropylene' WHEN 2 THEN 'HDPE high-density polyethylene drums and LDPE low-density polyethylene film' ELSE 'PP polypropylene caps' END"
FOUND = f"""WITH all_listings AS (SELECT *, waste_id % 1000 = 7 AS is_session, {LISTING} {_NOTED} AS text FROM listings), needs AS ({NEEDS}), cat_docs AS (SELECT waste_id AS id, text FROM all_listings WHERE NOT is_session),
    {_counts('cat', 'cat_docs', 'id')}, idf AS (SELECT term, ln((1 + (SELECT count(*) FROM cat_docs)) / (1.0 + count(*))) + 1 AS idf FROM cat_c GROUP BY 1), {_counts('lst', 'all_listings', 'waste_id')}, {_weights('lst')}, {_counts('q', 'needs', 'need_id')}, {_weights('q')},
    sim AS (SELECT q.id AS need_id, lst.id AS waste_id, sum(q.weight * lst.weight) AS s FROM q JOIN lst USING (term) GROUP BY ALL),
    x AS (SELECT n.need_id, l.waste_id, l.quantity_kg, l.is_session, coalesce(s, 0) AS s, trim(n.text) <> '' AS has_query, n.lat IS NOT NULL AS placed, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(l.lat - n.lat) / 2), 2) + cos(radians(n.lat)) * cos(radians(l.lat)) * pow(sin(radians(l.lon - n.lon) / 2), 2)))) AS km,
        CASE quality WHEN 'good' THEN 1.0 WHEN 'fair' THEN 0.7 WHEN 'poor' THEN 0.4 ELSE 0.5 END AS grade, (n.waste_type IS NULL OR l.waste_type = n.waste_type) AND (n.sub_type IS NULL OR l.sub_type = n.sub_type) AND (min_quantity IS NULL OR quantity_kg >= min_quantity) AND (grades IS NULL OR list_contains(string_split(grades, ','), quality)) AS ok
        FROM needs n CROSS JOIN all_listings l LEFT JOIN sim ON sim.need_id = n.need_id AND sim.waste_id = l.waste_id),
    y AS (SELECT *, min(s) OVER (PARTITION BY need_id) AS lo, max(s) OVER (PARTITION BY need_id) AS hi FROM x), z AS (SELECT *, CASE WHEN placed THEN exp(-km / 25.0) ELSE 1.0 END AS near FROM y),
    t AS (SELECT *, CASE WHEN has_query THEN 0.25 * near + 0.15 * grade + 0.6 * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1.0 END ELSE 0.625 * near + 0.375 * grade END AS total FROM z WHERE ok),
    r AS (SELECT *, row_number() OVER (PARTITION BY need_id ORDER BY round(total, 9) DESC, quantity_kg DESC, waste_id) AS rank FROM t)
    SELECT need_id, rank::INT AS rank, waste_id, is_session, round(s, 3) AS similarity, round(CASE WHEN placed THEN km END, 1) AS distance_km, round(total, 3) AS score FROM r WHERE rank <= 10"""


@query("a_04_find_listings", FOUND, "listings")
def a_04b(spark: SparkSession, d: str) -> DataFrame:
    note = F.element_at(F.array(*[F.lit(x) for x in NOTES]), (F.col("waste_id") % 4 + 1).cast("int"))
    every = bind(spark, d, "listings").withColumn("text", search.listing_text(*[F.col(c) for c in ("waste_type", "sub_type", "quality", "location_name")], note))
    old, new = every.where("waste_id % 1000 <> 7"), every.where("waste_id % 1000 = 7")
    index = inverted.build(old.select(F.col("waste_id").alias("id"), "text"))
    needs = spark.sql(NEEDS.replace("FROM nation", "FROM {n}"), n=read(spark, d, "nation")).withColumn("qualities", F.split("grades", ","))
    return search.find_listings(index, old, needs, 10, new)


@query("a_11_dense_similarity", "SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0")
def a_11(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.scores(v.where("id % 100 = 0"), v, "dense").select("query_id", "id", F.round("similarity", 5).alias("similarity"))


# ---- near duplicates ----
#: Every vector twice: as it is, and as a second shot with one element changed.
SHOTS = "shots AS (SELECT vec_id * 2 AS id, embedding AS v FROM embeddings UNION ALL SELECT vec_id * 2 + 1, list_transform(range(1, 65), lambda i: CASE WHEN i = 1 + vec_id % 64 THEN embedding[i] + 0.02::FLOAT ELSE embedding[i] END) FROM embeddings)"
BITS = "list_sum(list_transform(range(0, 63), lambda i: CASE WHEN v[i + 2] > v[i + 1] THEN 1::BIGINT << i ELSE 0 END))::BIGINT"


def shots(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings")
    changed = F.transform("embedding", lambda x, i: F.when(i == F.col("vec_id") % 64, x + F.lit(0.02).cast("float")).otherwise(x))
    return v.select((F.col("vec_id") * 2).alias("id"), F.col("embedding").alias("v")).unionByName(v.select((F.col("vec_id") * 2 + 1).alias("id"), changed.alias("v")))


@query("c_01_gradient_hash", f"WITH {SHOTS} SELECT id, {BITS} AS hash FROM shots")
def c_01(spark: SparkSession, d: str) -> DataFrame:
    return shots(spark, d).select("id", vectors.gradient_hash(F.col("v")).alias("hash"))


PAIRS = f"""WITH {SHOTS}, h AS (SELECT id, {BITS} AS hash FROM shots), c AS (SELECT hash, min(id) AS id FROM h GROUP BY 1),
    near AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS bits FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 4 UNION ALL SELECT c.id, h.id, 0 FROM h JOIN c USING (hash) WHERE h.id <> c.id)"""


@query("j_09_near_hashes", PAIRS + " SELECT a, b, bits FROM near")
def j_09(spark: SparkSession, d: str) -> DataFrame:
    return vectors.near_rows(shots(spark, d).select("id", vectors.gradient_hash(F.col("v")).alias("hash")), 4)


def _wide(k: int) -> str:
    return f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN v[(i + {k}) % 64 + 1] > v[i + 1] THEN (1::UBIGINT << i)::HUGEINT ELSE 0 END))::UBIGINT"


#: The three tests over classes of equal vectors, and each member with its class. The tables' vectors have unit length: so the mean difference.
MEAN_DIFFERENCE = 0.001
THREE = """hashed AS (SELECT *, {bits} AS hash, {w1} AS w1, {w2} AS w2, {w3} AS w3, {w4} AS w4 FROM {rows}), classes AS (SELECT v, any_value(hash) AS hash, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, any_value(w4) AS w4, min(id) AS id FROM hashed GROUP BY v),
    links AS (SELECT a.id AS a, b.id AS b FROM classes a JOIN classes b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 10 AND bit_count(xor(a.w1, b.w1)) + bit_count(xor(a.w2, b.w2)) + bit_count(xor(a.w3, b.w3)) + bit_count(xor(a.w4, b.w4)) <= 22
        AND list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i]::DOUBLE - b.v[i]::DOUBLE))) / 64 <= 0.001), near AS (SELECT * FROM links UNION ALL SELECT classes.id, hashed.id FROM hashed JOIN classes USING (v) WHERE hashed.id <> classes.id)"""


def _three(rows: str) -> str:
    return THREE.format(bits=BITS, rows=rows, **{f"w{k}": _wide(k) for k in range(1, 5)})


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", vectors.gradient_hash(F.col("v"))).withColumn("wide", vectors.wide_hash(F.col("v")))


@query("j_08_near_duplicates", f"WITH {SHOTS}, {_three('shots')} SELECT a, b FROM near")
def j_08(spark: SparkSession, d: str) -> DataFrame:
    return vectors.near_images(hashed(shots(spark, d)), mean_difference=MEAN_DIFFERENCE)


@query("g_40_pair_classes", f"WITH {SHOTS}, {_three('shots')} SELECT CASE WHEN a % 4 <> b % 4 THEN 'cross_dataset' WHEN a % 3 <> b % 3 THEN 'cross_label' ELSE 'same_folder' END AS kind, count(*) AS n FROM near GROUP BY 1")
def g_40(spark: SparkSession, d: str) -> DataFrame:
    p = vectors.near_images(hashed(shots(spark, d)), mean_difference=MEAN_DIFFERENCE)
    kind = F.when(F.col("a") % 4 != F.col("b") % 4, "cross_dataset").when(F.col("a") % 3 != F.col("b") % 3, "cross_label").otherwise("same_folder")
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# ---- groups, splits, balance ----
def items(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "items")


#: Photos of the curation queries: vectors rounded down to eighths, so that many neighbours are equal, and second shots in which
#: a quarter of the elements is a little larger: up to 12 bits of the hash and 40 of the wide one, on both sides of what is near.
#: Third shots of every fifth vector differ further, so some are near the second shot alone. Of every eleventh vector the same file
#: is there again in another folder. Some second shots are labelled otherwise, some are filed under another official split, and
#: one rare label is in the training split alone.
PHOTO = """id, CASE WHEN vec % 97 = 0 THEN 'rare' WHEN vec % 53 = 0 AND shot = 1 THEN 'odd' ELSE concat('l', CAST(label AS {text})) END AS leaf, concat('d', CAST(vec AS {text}), '-', CAST(CASE WHEN shot = 2 THEN 0 ELSE shot END AS {text})) AS digest,
    concat('set', CAST(vec % 3 AS {text}), '/', CAST(id AS {text})) AS path, concat('set', CAST(vec % 3 AS {text})) AS dataset, 600 + id % 900 AS n_chars,
    CASE WHEN vec % 97 = 0 THEN 'train' WHEN vec % 13 = 0 AND shot = 1 THEN 'test' WHEN vec % 10 = 0 THEN 'val' WHEN vec % 10 < 4 THEN 'train' END AS split"""
SHOT = "SELECT vec_id * 4 AS id, vec_id AS vec, 0 AS shot, label, {v0} AS v FROM {e} UNION ALL SELECT vec_id * 4 + 1, vec_id, 1, label, {v1} FROM {e} UNION ALL SELECT vec_id * 4 + 2, vec_id, 2, label, {v0} FROM {e} WHERE vec_id % 11 = 0 UNION ALL SELECT vec_id * 4 + 3, vec_id, 3, label, {v3} FROM {e} WHERE vec_id % 5 = 0"
#: The vectors of the shots in both dialects: which elements (from 0) are 0.001 larger.
STEPS = {"v0": "false", "v1": "(i + vec_id) % 4 = 0", "v3": "(i + vec_id) % 4 < 2"}
_DUCK_V = {k: f"list_transform(range(0, 64), lambda i: floor(embedding[i + 1]::DOUBLE * 8) / 8 + CASE WHEN {c} THEN 0.001::DOUBLE ELSE 0 END)" for k, c in STEPS.items()}
_SPARK_V = {k: f"transform(embedding, (x, i) -> floor(CAST(x AS DOUBLE) * 8) / 8 + CASE WHEN {c} THEN 0.001D ELSE 0D END)" for k, c in STEPS.items()}
PHOTOS = f"photos AS (SELECT {PHOTO.format(text='VARCHAR')}, v FROM ({SHOT.format(e='embeddings', **_DUCK_V)}))"
GROUPS = f"""WITH RECURSIVE {PHOTOS}, {_three('photos')},
    dig AS (SELECT id, min(id) OVER (PARTITION BY digest) AS q FROM photos), edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT id, q FROM dig UNION SELECT q, id FROM dig),
    reach(id, r) AS (SELECT id, id FROM photos UNION SELECT e.a, reach.r FROM reach JOIN edges e ON e.b = reach.id), grouped AS (SELECT photos.*, g.grp FROM photos JOIN (SELECT id, min(r) AS grp FROM reach GROUP BY 1) g USING (id))"""
PRIO = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 9 END"
DEDUP = f"""{GROUPS}, gg AS (SELECT grp, min(leaf) <> max(leaf) AS conflict FROM grouped GROUP BY 1),
    rep AS (SELECT grp, path AS rep_path, split AS rep_split FROM grouped QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {PRIO}, path) = 1),
    own AS (SELECT grp, digest, path AS own_path FROM grouped QUALIFY row_number() OVER (PARTITION BY grp, digest ORDER BY {PRIO}, path) = 1),
    deduped AS (SELECT g.*, CASE WHEN conflict THEN 'conflict' WHEN path = rep_path THEN 'kept' WHEN path <> own_path THEN 'exact_copy' WHEN rep_split IS NOT NULL AND split IS NOT NULL AND split <> rep_split THEN 'other_split' ELSE 'near_copy' END AS reason
        FROM grouped g JOIN gg USING (grp) JOIN rep USING (grp) JOIN own USING (grp, digest))"""


def photos(spark: SparkSession, d: str) -> DataFrame:
    shots_ = spark.sql(SHOT.format(e="{e}", **_SPARK_V), e=read(spark, d, "embeddings"))
    return spark.sql(f"SELECT {PHOTO.format(text='STRING')}, v FROM {{s}}", s=shots_)


def grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = photos(spark, d)
    near = vectors.near_images(hashed(rows.select("id", "v")), mean_difference=MEAN_DIFFERENCE, forest=True)
    return curate.duplicate_groups(rows.drop("v"), near.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("c_02_duplicate_groups", GROUPS + " SELECT id, grp FROM grouped")
def c_02(spark: SparkSession, d: str) -> DataFrame:
    return grouped(spark, d).select("id", "grp")


@query("c_03_conflicting_groups", GROUPS + " SELECT grp, count(*) AS n FROM grouped GROUP BY 1 HAVING min(leaf) <> max(leaf)")
def c_03(spark: SparkSession, d: str) -> DataFrame:
    return grouped(spark, d).groupBy("grp").agg(F.count("*").alias("n"), (F.min("leaf") != F.max("leaf")).alias("c")).where("c").drop("c")


@query("c_04_representatives", DEDUP + " SELECT id, reason FROM deduped")
def c_04(spark: SparkSession, d: str) -> DataFrame:
    return curate.dedup(grouped(spark, d)).select("id", "reason")


SPLIT = DEDUP + """, unsplit AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY md5(concat('7:', path)), path) AS rank, count(*) OVER (PARTITION BY leaf)::DOUBLE AS n FROM deduped WHERE reason = 'kept' AND split IS NULL),
    assigned AS (SELECT id, leaf, digest, path, n_chars, dataset, grp, CASE WHEN rank <= round_even(n * 0.15, 0) THEN 'val' WHEN rank <= round_even(n * 0.15, 0) + round_even(n * 0.1, 0) THEN 'test' ELSE 'train' END AS split FROM unsplit
        UNION ALL SELECT id, leaf, digest, path, n_chars, dataset, grp, split FROM deduped WHERE reason = 'kept' AND split IS NOT NULL)"""


def assigned(spark: SparkSession, d: str) -> DataFrame:
    kept = cut(curate.dedup(grouped(spark, d)).where("reason = 'kept'").drop("reason"))  # read three times
    return curate.stratified_split(kept.where("split is null"), 0.15, 0.1).unionByName(kept.where("split is not null"))


@query("c_05_stratified_split", SPLIT + " SELECT id, split FROM assigned")
def c_05(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d).select("id", "split")


@query("w_04_stratified_counts", SPLIT + " SELECT leaf, split, count(*) AS n FROM assigned GROUP BY ALL")
def w_04(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d).groupBy("leaf", "split").agg(F.count("*").alias("n"))


@query("c_05_unit_split", "WITH s AS (SELECT DISTINCT scene, ('0x' || substr(md5(concat('7:', scene)), 1, 8))::BIGINT / 4294967295.0 AS x FROM boxes) SELECT scene, CASE WHEN x < 0.15 THEN 'val' WHEN x < 0.25 THEN 'test' ELSE 'train' END AS split FROM s", "boxes")
def c_05b(spark: SparkSession, d: str) -> DataFrame:
    scenes = bind(spark, d, "boxes").select("scene").distinct().withColumn("split", F.lit(None).cast("string"))
    return curate.unit_split(scenes, 0.15, 0.1)


@query("c_06_cross_split", GROUPS + f", s AS (SELECT *, CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS sp FROM grouped) SELECT id, sp AS split FROM s QUALIFY {PRIO.replace('split', 'sp')} = min({PRIO.replace('split', 'sp')}) OVER (PARTITION BY grp)")
def c_06(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val").otherwise("test")
    return curate.drop_cross_split(grouped(spark, d).withColumn("split", s)).select("id", "split")


@query("c_07_viable_leaves", SPLIT + " SELECT leaf, count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val FROM assigned GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'val') > 0")
def c_07(spark: SparkSession, d: str) -> DataFrame:
    return curate.viable_leaves(assigned(spark, d))


OVER = SPLIT + """, tr AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY md5(concat('7:', path)), path) - 1 AS r, count(*) OVER (PARTITION BY leaf) AS n FROM assigned WHERE split = 'train'), med AS (SELECT floor(quantile_cont(n, 0.5))::BIGINT AS m FROM (SELECT DISTINCT leaf, n FROM tr)),
    ov AS (SELECT tr.*, greatest(0, least(m, n * 3) - n) AS extra FROM tr, med)"""


@query("c_08_oversample", OVER + " SELECT id, 1 + extra // n + CASE WHEN r < extra % n THEN 1 ELSE 0 END AS copies FROM ov")
def c_08(spark: SparkSession, d: str) -> DataFrame:
    return curate.oversample(assigned(spark, d)).select("id", "copies")


#: A built dataset with a fault for every check: copies of some files, a few of them outside train, stems used twice, a leaf outside
#: the mapping, leaves that miss a split, and equal files and near ones in different splits.
BUILT = """SELECT id, concat(CAST(id AS {text}), '.jpg') AS path, CASE WHEN id % 97 = 3 THEN concat('f', CAST(id - 2 AS {text})) ELSE concat('f', CAST(id AS {text})) END AS stem, CASE WHEN leaf = 'odd' THEN leaf ELSE concat('t', substr(leaf, 2, 1), '__', leaf) END AS leaf,
    CASE WHEN leaf = 'rare' OR id % 10 < 7 THEN 'train' WHEN id % 10 < 9 THEN 'val' ELSE 'test' END AS split, digest, false AS is_copy FROM {photos}
    UNION ALL SELECT id, concat(CAST(id AS {text}), '_rep1.jpg'), concat('f', CAST(id AS {text}), '_rep1'), concat('t', substr(leaf, 2, 1), '__', leaf), CASE WHEN id % 60 = 0 THEN 'val' ELSE 'train' END, digest, true FROM {photos} WHERE id % 6 = 0 AND leaf <> 'odd'"""
#: The mapping has the leaves of all labels but one.
ALLOWED = "SELECT DISTINCT concat('t', CAST(label AS {text}), '__l', CAST(label AS {text})) AS leaf FROM {e} WHERE label <> 7"


def built(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(BUILT.format(text="STRING", photos="{p}"), p=photos(spark, d).drop("v"))


@query(
    "c_09_leakage_checks",
    f"""WITH {PHOTOS}, built AS ({BUILT.format(text='VARCHAR', photos='photos')}), allowed AS ({ALLOWED.format(text='VARCHAR', e='embeddings')}), uniq AS (SELECT *, {PRIO} AS prio FROM built WHERE NOT is_copy),
    firsts AS (SELECT *, row_number() OVER w AS r, first_value(split) OVER w AS first FROM uniq WINDOW w AS (PARTITION BY digest ORDER BY prio, id)),
    u AS (SELECT 'class_in_every_split' AS "check", (SELECT count(*) FROM (SELECT leaf FROM built GROUP BY 1 HAVING count(DISTINCT split) <> (SELECT count(DISTINCT split) FROM built))) AS bad, true AS judged
        UNION ALL SELECT 'class_in_mapping', (SELECT count(DISTINCT leaf) FROM built WHERE split = 'train' AND leaf NOT IN (SELECT leaf FROM allowed)), true UNION ALL SELECT 'copy_in_train', (SELECT count(*) FROM built WHERE is_copy AND split <> 'train'), true
        UNION ALL SELECT 'stem_once', (SELECT count(*) FROM (SELECT stem FROM uniq GROUP BY 1 HAVING count(*) > 1)), true UNION ALL SELECT 'digest_in_one_split', (SELECT count(*) FROM firsts WHERE split <> first), true
        UNION ALL SELECT 'files', (SELECT count(*) FROM built), false UNION ALL SELECT 'unique_files', (SELECT count(*) FROM uniq), false UNION ALL SELECT 'copies', (SELECT count(*) FROM built WHERE is_copy), false UNION ALL SELECT 'repeated_digests', (SELECT count(*) FROM firsts WHERE r > 1), false)
    SELECT "check", bad, CASE WHEN judged THEN CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END END AS verdict FROM u""",
)
def c_09(spark: SparkSession, d: str) -> DataFrame:
    return curate.leakage_checks(cut(built(spark, d)), spark.sql(ALLOWED.format(text="STRING", e="{e}"), e=read(spark, d, "embeddings")))


@query(
    "c_09_near_between_splits",
    f"""WITH {PHOTOS}, {_three('photos')}, built AS ({BUILT.format(text='VARCHAR', photos='photos')}), u AS (SELECT b.*, c.id AS cls, {PRIO.replace('split', 'b.split')} AS prio FROM built b JOIN hashed h USING (id) JOIN classes c USING (v) WHERE NOT is_copy), met AS (SELECT a, b FROM links UNION ALL SELECT id, id FROM classes),
    f AS (SELECT least(struct_pack(p := a.prio, s := a.split, l := a.leaf), struct_pack(p := b.prio, s := b.split, l := b.leaf)) AS x, greatest(struct_pack(p := a.prio, s := a.split, l := a.leaf), struct_pack(p := b.prio, s := b.split, l := b.leaf)) AS y FROM met m JOIN u a ON a.cls = m.a JOIN u b ON b.cls = m.b AND (m.a <> m.b OR a.id < b.id))
    SELECT x.s AS split_a, y.s AS split_b, x.l AS leaf_a, y.l AS leaf_b, count(*) AS n FROM f GROUP BY ALL""",
)
def c_09b(spark: SparkSession, d: str) -> DataFrame:
    members, links = vectors.near_classes(hashed(photos(spark, d).select("id", "v")), mean_difference=MEAN_DIFFERENCE)
    return curate.near_between_splits(built(spark, d).where("not is_copy").join(members, "id"), links)


@query("c_10_extend_domain", SPLIT + """, k AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY md5(concat('7:', path)), path) AS p FROM assigned WHERE id % 9 <> 0) SELECT id, unnest(range(1, CASE WHEN leaf = 'l3' AND split = 'train' THEN 4 ELSE 2 END))::INT AS copy FROM k WHERE p <= CASE leaf WHEN 'l0' THEN 100 WHEN 'l3' THEN 40 WHEN 'l5' THEN 60 WHEN 'l7' THEN 50 END""")
def c_10(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(assigned(spark, d))  # read twice
    return curate.extend_domain(rows, rows.where("id % 9 = 0"), {"l0": 100, "l3": 40, "l5": 60, "l7": 50}, "l3").select("id", "copy")


@query("c_11_shadow_copies", SPLIT + " SELECT id, false AS low_detail FROM assigned UNION ALL SELECT id, true FROM assigned WHERE split = 'train' AND n_chars > 1000 AND ('0x' || substr(md5(concat('7:', path)), 1, 8))::BIGINT / 4294967295.0 < 0.3")
def c_11(spark: SparkSession, d: str) -> DataFrame:
    return curate.shadow_copies(assigned(spark, d), 0.3, 1000).select("id", "low_detail")


@query("c_12_holdout", "SELECT id, list_sum(list_transform(string_split(md5(path), ''), lambda c: ('0x' || c)::INT)) % 5 = 0 AS held_out FROM items", "items")
def c_12(spark: SparkSession, d: str) -> DataFrame:
    return curate.holdout(items(spark, d), "path").select("id", "held_out")


@query("c_13_replay_mix", "SELECT id, unnest(range(1, 4))::INT AS copy FROM items WHERE id % 10 = 0 UNION ALL SELECT id, 0 FROM (SELECT * FROM items WHERE id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY md5(concat('7:', path)), path) <= 25)", "items")
def c_13(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d)
    return curate.replay_mix(rows.where("id % 10 = 0"), rows.where("id % 10 <> 0"), 3, 25).select("id", "copy")


@query("c_15_hierarchy", "SELECT dataset, string_agg(DISTINCT leaf, ',' ORDER BY leaf) AS leaves FROM items GROUP BY 1", "items")
def c_15(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_set("leaf")), ",").alias("leaves"))


@query("t_06_capped", SPLIT + " SELECT id FROM assigned QUALIFY row_number() OVER (PARTITION BY leaf, split ORDER BY md5(concat('7:', path)), path) <= CASE split WHEN 'train' THEN 50 ELSE 10 END")
def t_06(spark: SparkSession, d: str) -> DataFrame:
    return curate.capped(assigned(spark, d), {"train": 50, "val": 10, "test": 10}).select("id")


@query("t_07_sample_per_class", "SELECT id FROM items QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY md5(concat('7:', path)), path) <= 20", "items")
def t_07(spark: SparkSession, d: str) -> DataFrame:
    return curate.sample_per_class(items(spark, d), 20).select("id")


@query("w_05_round_robin", "WITH r AS (SELECT id, leaf, row_number() OVER (PARTITION BY leaf ORDER BY n_chars DESC, id) AS round FROM items), s AS (SELECT round, coalesce(sum(count(*)) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r GROUP BY 1) SELECT id, round FROM r JOIN s USING (round) WHERE before < 24", "items")
def w_05(spark: SparkSession, d: str) -> DataFrame:
    return curate.round_robin(items(spark, d), 24, "leaf", F.desc("n_chars"), F.col("id")).select("id", "round")


@query("g_36_inventory", "WITH c AS (SELECT dataset, leaf, coalesce(split, '-') AS split, count(*) AS n FROM items GROUP BY ALL) SELECT dataset, leaf, sum(n)::BIGINT AS n, string_agg(concat(split, '=', n), ',' ORDER BY split) AS by_split FROM c GROUP BY ALL", "items")
def g_36(spark: SparkSession, d: str) -> DataFrame:
    return curate.inventory(items(spark, d))


SIZED = "sized AS (SELECT *, CASE WHEN id % 41 <> 0 THEN 64 + n_chars % 7 * 32 END AS w, CASE WHEN id % 41 <> 0 THEN 48 + n_chars % 5 * 48 END AS h, CASE WHEN n_chars % 9 = 0 THEN 'L' WHEN n_chars % 9 = 4 THEN 'P' ELSE 'RGB' END AS mode FROM items)"


@query(
    "g_36_sizes",
    f"""WITH {SIZED}, ok AS (SELECT * FROM sized WHERE w IS NOT NULL), z AS (SELECT dataset, leaf, concat(w, 'x', h) AS size, count(*) AS c FROM ok GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY dataset, leaf ORDER BY c DESC, size) AS r FROM z),
    t AS (SELECT dataset, leaf, string_agg(concat(size, '=', c), ',' ORDER BY r) AS most_common FROM c WHERE r <= 3 GROUP BY ALL), m AS (SELECT dataset, leaf, string_agg(concat(mode, '=', c), ',' ORDER BY mode) AS modes FROM (SELECT dataset, leaf, mode, count(*) AS c FROM ok GROUP BY ALL) GROUP BY ALL),
    a AS (SELECT dataset, leaf, count(*) AS images, count(*) FILTER (w IS NULL) AS unreadable, min(least(w, h)) AS min_side, max(greatest(w, h)) AS max_side, floor(quantile_cont(w, 0.5))::BIGINT AS median_w, floor(quantile_cont(h, 0.5))::BIGINT AS median_h FROM sized GROUP BY ALL)
    SELECT * FROM a LEFT JOIN t USING (dataset, leaf) LEFT JOIN m USING (dataset, leaf)""",
    "items",
)
def g_36b(spark: SparkSession, d: str) -> DataFrame:
    sized = spark.sql(f"WITH {SIZED.replace('FROM items', 'FROM {i}')} SELECT * FROM sized", i=items(spark, d))
    return curate.size_inventory(sized)


FLAGGED = "flagged AS (SELECT *, w % 2 = 0 AS has_polygon, w % 5 = 0 AS difficult, h > 50 AS truncated, w > 40 AND h > 80 AS occluded FROM boxes)"


@query("g_37_box_flags", f"WITH {FLAGGED} SELECT label, count(*) AS objects, count(*) FILTER (has_polygon) AS has_polygon, count(*) FILTER (difficult) AS difficult, count(*) FILTER (truncated) AS truncated, count(*) FILTER (occluded) AS occluded FROM flagged GROUP BY 1", "boxes")
def g_37b(spark: SparkSession, d: str) -> DataFrame:
    flags = ("has_polygon", "difficult", "truncated", "occluded")
    flagged = spark.sql(f"WITH {FLAGGED.replace('FROM boxes', 'FROM {b}')} SELECT * FROM flagged", b=bind(spark, d, "boxes"))
    return curate.box_stats(flagged, flags).select("label", "objects", *flags)


@query("g_37_box_stats", "SELECT label, count(*) AS objects, count(DISTINCT scene) AS scenes, round(quantile_cont(least(w, h), 0.5), 6) AS median, round(quantile_cont(least(w, h), 0.1), 6) AS p10, count(*) FILTER (least(w, h) < 24) AS under_24, count(*) FILTER (least(w, h) < 64) AS under_64, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM boxes GROUP BY 1", "boxes")
def g_37(spark: SparkSession, d: str) -> DataFrame:
    return curate.box_stats(bind(spark, d, "boxes"))


@query("g_38_cooccurrence", "WITH s AS (SELECT DISTINCT scene, label FROM boxes) SELECT x.label AS a, y.label AS b, count(*) AS scenes FROM s x JOIN s y ON x.scene = y.scene AND x.label < y.label GROUP BY ALL", "boxes")
def g_38(spark: SparkSession, d: str) -> DataFrame:
    return curate.cooccurrence(bind(spark, d, "boxes"))


@query("g_38_labels_per_scene", "SELECT labels, count(*) AS scenes FROM (SELECT count(DISTINCT label) AS labels FROM boxes GROUP BY scene) GROUP BY 1", "boxes")
def g_38b(spark: SparkSession, d: str) -> DataFrame:
    return curate.labels_per_scene(bind(spark, d, "boxes"))


@query("g_39_digest_classes", "SELECT digest, count(*) AS n, CASE WHEN min(dataset) <> max(dataset) THEN 'cross_dataset' WHEN min(leaf) <> max(leaf) THEN 'cross_label' WHEN min(coalesce(split, '-')) <> max(coalesce(split, '-')) THEN 'cross_split' ELSE 'same_folder' END AS kind FROM items GROUP BY 1 HAVING count(*) > 1", "items")
def g_39(spark: SparkSession, d: str) -> DataFrame:
    return curate.digest_classes(items(spark, d))


@query("g_39_redundant", "SELECT leaf, count(*) AS redundant FROM (SELECT leaf, row_number() OVER (PARTITION BY digest ORDER BY path) AS r FROM items) WHERE r > 1 GROUP BY 1", "items")
def g_39b(spark: SparkSession, d: str) -> DataFrame:
    return curate.redundant_by_label(items(spark, d))


@query("g_41_dataset_summary", SPLIT + " SELECT leaf, split, count(*) AS n FROM assigned GROUP BY CUBE (leaf, split)")
def g_41(spark: SparkSession, d: str) -> DataFrame:
    return curate.dataset_summary(assigned(spark, d))


KINDS = f"""WITH {PHOTOS}, {_three('photos')}, p AS (SELECT h.*, coalesce(split, '-') AS s, c.id AS cls FROM hashed h JOIN classes c USING (v)), met AS (SELECT a, b FROM links UNION ALL SELECT id, id FROM classes),
    near_files AS (SELECT least(struct_pack(d := a.dataset, l := a.leaf, s := a.s), struct_pack(d := b.dataset, l := b.leaf, s := b.s)) AS x, greatest(struct_pack(d := a.dataset, l := a.leaf, s := a.s), struct_pack(d := b.dataset, l := b.leaf, s := b.s)) AS y, least(a.path, b.path) AS path_a, greatest(a.path, b.path) AS path_b
        FROM met m JOIN p a ON a.cls = m.a JOIN p b ON b.cls = m.b AND (m.a <> m.b OR a.id < b.id) AND a.digest <> b.digest),
    k AS (SELECT CASE WHEN x.d <> y.d THEN 'cross_dataset' WHEN x.l <> y.l THEN 'cross_label' WHEN x.s <> y.s THEN 'cross_split' ELSE 'same_folder' END AS kind, concat(x.d, '/', x.l) AS a, concat(y.d, '/', y.l) AS b, path_a, path_b FROM near_files)"""


def near_kinds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = photos(spark, d)
    members, links = vectors.near_classes(hashed(rows.select("id", "v")), mean_difference=MEAN_DIFFERENCE)
    return curate.near_kinds(cut(rows.drop("v").join(members, "id")), cut(links))


@query("g_40_near_kinds", KINDS + " SELECT kind, a, b, count(*) AS n FROM k GROUP BY ALL")
def g_40b(spark: SparkSession, d: str) -> DataFrame:
    return near_kinds(spark, d)[0]


@query("g_40_examples", KINDS + " SELECT kind, a, b, path_a, path_b, row_number() OVER (PARTITION BY kind, a, b ORDER BY path_a, path_b)::INT AS rank FROM k QUALIFY rank <= 4")
def g_40c(spark: SparkSession, d: str) -> DataFrame:
    return near_kinds(spark, d)[1]


#: Leaves with a type before them, for the summaries.
TYPED = "typed AS (SELECT id, concat('m', CAST(length(leaf) AS {text}), '__', leaf) AS leaf, leaf AS source_label, dataset, split FROM {rows})"


def typed(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"WITH {TYPED.format(text='STRING', rows='{a}')} SELECT * FROM typed", a=assigned(spark, d))


@query(
    "g_41_leaves",
    SPLIT + f""", {TYPED.format(text='VARCHAR', rows='assigned')}, c AS (SELECT leaf, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM typed GROUP BY 1), m AS (SELECT floor(quantile_cont(train, 0.5))::BIGINT AS m FROM c WHERE train > 0),
    s AS (SELECT leaf, string_agg(concat(src, '=', n), ',' ORDER BY src) AS sources FROM (SELECT leaf, concat(dataset, '/', source_label) AS src, count(*) AS n FROM typed GROUP BY ALL) GROUP BY 1) SELECT leaf, train, CASE WHEN train > 0 THEN greatest(0, least(m, train * 3) - train) ELSE 0 END AS added, val, test, sources FROM c JOIN s USING (leaf), m""",
)
def g_41c(spark: SparkSession, d: str) -> DataFrame:
    return curate.leaf_summary(typed(spark, d))


@query("g_41_types", SPLIT + f", {TYPED.format(text='VARCHAR', rows='assigned')} SELECT split_part(leaf, '__', 1) AS type, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM typed GROUP BY ROLLUP (1)")
def g_41d(spark: SparkSession, d: str) -> DataFrame:
    return curate.type_summary(typed(spark, d), F.split_part(F.col("leaf"), F.lit("__"), F.lit(1)))


@query("g_41_imbalance", "WITH c AS (SELECT leaf, count(*) AS n FROM items GROUP BY 1) SELECT (SELECT leaf FROM c ORDER BY n, leaf LIMIT 1) AS smallest, (SELECT leaf FROM c ORDER BY n DESC, leaf DESC LIMIT 1) AS largest, min(n) AS low, max(n) AS high, round(max(n) / min(n), 6) AS ratio, quantile_cont(n, 0.5) AS median FROM c", "items")
def g_41b(spark: SparkSession, d: str) -> DataFrame:
    return curate.imbalance(items(spark, d))


@query(
    "g_42_dominant",
    """WITH per AS (SELECT scene, substr(label, 1, 1) AS kind, label, sum(CAST(w * h AS DECIMAL(28,4))) AS a FROM boxes GROUP BY ALL), l AS (SELECT scene, label FROM per QUALIFY row_number() OVER (PARTITION BY scene ORDER BY a DESC, label DESC) = 1),
    kk AS (SELECT scene, kind, sum(a) AS k FROM per GROUP BY ALL), k AS (SELECT * FROM kk QUALIFY row_number() OVER (PARTITION BY scene ORDER BY k DESC, kind DESC) = 1), t AS (SELECT scene, sum(a) AS t FROM per GROUP BY 1)
    SELECT scene, label, kind, round(CASE WHEN t = 0 THEN 0 ELSE k::DOUBLE / t::DOUBLE END, 6) AS kind_share FROM l JOIN k USING (scene) JOIN t USING (scene)""",
    "boxes",
)
def g_42(spark: SparkSession, d: str) -> DataFrame:
    return curate.dominant(bind(spark, d, "boxes"))


@query("f_09_padded_boxes", "WITH b AS (SELECT scene, label, w, h, scene % 300 AS x, scene % 200 AS y FROM boxes), c AS (SELECT *, greatest(0.0, x - 0.1 * w) AS x0, greatest(0.0, y - 0.1 * h) AS y0, least(320.0, x + 1.1 * w) AS x1, least(240.0, y + 1.1 * h) AS y1 FROM b) SELECT scene, count(*) AS n, count(*) FILTER (w > 0 AND h > 0 AND least(floor(x1) - ceil(x0), floor(y1) - ceil(y0)) >= 24) AS usable FROM c GROUP BY 1", "boxes")
def f_09(spark: SparkSession, d: str) -> DataFrame:
    b = bind(spark, d, "boxes").withColumn("x", F.col("scene") % 300).withColumn("y", F.col("scene") % 200)
    return curate.padded_boxes(b, 320, 240).groupBy("scene").agg(F.count("*").alias("n"), F.count_if("usable").alias("usable"))


MAPPING = "VALUES ('AF', 'metal', 'mapped'), ('ao', 'glass', 'mapped'), ('NF', '', 'mapped'), ('rf', 'paper', 'unmapped')"


@query("f_08_map_labels", f"WITH m(source_label, canonical_type, status) AS ({MAPPING}) SELECT coalesce(CASE WHEN status IS NULL THEN 'not_in_mapping' WHEN status = 'unmapped' THEN 'unmapped' WHEN canonical_type = '' THEN 'blank_type' END, 'mapped') AS reason, count(*) AS n FROM boxes LEFT JOIN m ON lower(label) = lower(source_label) GROUP BY 1", "boxes")
def f_08(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.sql(f"SELECT * FROM {MAPPING} AS m(source_label, canonical_type, status)")
    return curate.map_labels(bind(spark, d, "boxes"), mapping).groupBy(F.coalesce("reason", F.lit("mapped")).alias("reason")).agg(F.count("*").alias("n"))


@query("j_10_annotations", "SELECT l_orderkey AS scene, o_orderpriority AS file, p_type AS category, count(*) AS objects FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def j_10(spark: SparkSession, d: str) -> DataFrame:
    ann = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    images = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("file"))
    cats = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    return curate.annotations(ann, images, cats, "l_orderkey", "l_partkey").withColumnRenamed("l_orderkey", "scene")


@query("j_11_images_without_annotation", "SELECT o_orderkey AS image FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j_11(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("image"))


@query("j_13_profiles", "SELECT s_suppkey AS recycler_id, coalesce(n_name, '') AS area FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey")
def j_13(spark: SparkSession, d: str) -> DataFrame:
    profiles = read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("area"))
    return read(spark, d, "supplier").join(profiles, "s_nationkey", "left").select(F.col("s_suppkey").alias("recycler_id"), F.coalesce("area", F.lit("")).alias("area"))


@query("s_03_class_difference", SPLIT + ", c AS (SELECT DISTINCT leaf, split FROM assigned) SELECT a.leaf, s.split FROM (SELECT DISTINCT leaf FROM c) a, (SELECT DISTINCT split FROM c) s EXCEPT SELECT leaf, split FROM c")
def s_03(spark: SparkSession, d: str) -> DataFrame:
    c = assigned(spark, d).select("leaf", "split").distinct()
    return c.select("leaf").distinct().crossJoin(F.broadcast(c.select("split").distinct())).exceptAll(c)


@query("s_04_unlisted_files", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def s_04(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id").subtract(read(spark, d, "labels").select("doc_id"))


@query("s_05_concat_sources", "SELECT origin, count(*) AS n FROM (SELECT 'documents' AS origin FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY 1")
def s_05(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, key: read(spark, d, t).select(F.col(key).alias("id"), F.lit(t).alias("origin"))
    return part("documents", "doc_id").unionByName(part("pages", "page_id")).unionByName(part("benchmark", "item_id")).groupBy("origin").agg(F.count("*").alias("n"))


@query("io_12_manifest", "SELECT doc_id AS id, md5(text) AS md5, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def io_12(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("text").cast("binary")
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(b).alias("md5"), F.sha2(b, 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))
