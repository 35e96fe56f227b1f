"""Queries of the feedback, prediction, calibration and evaluation operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopgrade.functions.labels import wilson
from loopgrade.functions.session import bounded, cut
from loopgrade.operators import calibrate, evaluate, feedback, ordered, predict, vectors
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


CUTOFF = "2024-01-10 00:00:00"
LATEST = "WITH latest AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY seq DESC) = 1)\n"


def answers(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "answers")


# ---- feedback ----
@query("w_01_latest_answer", LATEST + "SELECT item_key, seq, actual FROM latest", "answers")
def w_01(spark: SparkSession, d: str) -> DataFrame:
    return feedback.latest(answers(spark, d)).select("item_key", "seq", "actual")


@query("f_11_reset_cutoff", LATEST + f"SELECT item_key, actual FROM latest WHERE created_at >= TIMESTAMP '{CUTOFF}' AND actual IS NOT NULL AND actual <> 'unknown'", "answers")
def f_11(spark: SparkSession, d: str) -> DataFrame:
    return feedback.since(answers(spark, d), CUTOFF).select("item_key", "actual")


CHILDREN = "children(actual, subs) AS (VALUES ('view', ['s0', 's1']), ('click', ['s1']), ('purchase', ['s0', 's1', 's2']))"
USABLE = f"""{LATEST.rstrip()}, {CHILDREN}, st AS (SELECT l.*, subs, coalesce(nullif(actual_sub, ''), CASE WHEN len(subs) = 1 THEN subs[1] END, CASE WHEN is_correct AND predicted = l.actual THEN nullif(predicted_sub, '') END) AS st FROM latest l LEFT JOIN children USING (actual)),
    why AS (SELECT *, CASE WHEN created_at < TIMESTAMP '{CUTOFF}' THEN 'before_reset' WHEN subs IS NULL THEN 'no_class' WHEN st IS NULL OR NOT list_contains(subs, st) THEN 'no_sub_type' WHEN n_files = 0 THEN 'no_photo' ELSE 'used' END AS reason FROM st)"""


@query("f_10_usability", USABLE + " SELECT reason, CASE WHEN reason = 'used' THEN concat(actual, '__', st) END AS leaf, count(*) AS n FROM why GROUP BY 1, 2", "answers")
def f_10(spark: SparkSession, d: str) -> DataFrame:
    children = spark.sql("SELECT * FROM VALUES ('view', array('s0', 's1')), ('click', array('s1')), ('purchase', array('s0', 's1', 's2')) AS t(waste_type, subs)")
    return feedback.usability(answers(spark, d), children, CUTOFF).groupBy("reason", "leaf").agg(F.count("*").alias("n"))


@query("g_13_feedback_summary", LATEST + "SELECT count(*) AS n, count(*) FILTER (is_correct) AS correct, round(count(*) FILTER (is_correct) / count(*), 6) AS accuracy, count(*) FILTER (actual = 'other') AS n_other FROM latest", "answers")
def g_13(spark: SparkSession, d: str) -> DataFrame:
    return feedback.summary(answers(spark, d))


@query("g_13_corrections", LATEST + "SELECT concat(predicted, ' -> ', actual) AS correction, count(*) AS n FROM latest WHERE NOT is_correct AND actual IS NOT NULL GROUP BY 1", "answers")
def g_13b(spark: SparkSession, d: str) -> DataFrame:
    return feedback.corrections(answers(spark, d))


@query("g_14_memory_stats", LATEST + "SELECT actual, count(*) AS sets, sum(n_photos)::BIGINT AS photos FROM latest WHERE actual IS NOT NULL GROUP BY 1", "answers")
def g_14(spark: SparkSession, d: str) -> DataFrame:
    return feedback.memory_stats(answers(spark, d))


RAW = """raw AS (SELECT event_id AS id, [md5(CAST(event_id // 2 AS VARCHAR)), md5(CAST(user_id AS VARCHAR))] AS shas, event_type AS predicted, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'unknown' ELSE 's' || (event_id % 3) END AS predicted_sub,
    CAST(event_id * 37 % 100003 AS DOUBLE) / 100003 AS confidence, event_id % 3 <> 0 AS is_correct, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'view' END AS answer, CASE WHEN event_id % 5 = 0 THEN '' ELSE 's' || (event_id % 4) END AS answer_sub FROM events),
    children(actual, subs) AS (VALUES ('view', ['s0', 's1']), ('click', ['s1']), ('error', ['s0', 's1', 's2']))"""


def raw_answers(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT event_id AS id, array(md5(CAST(event_id DIV 2 AS STRING)), md5(CAST(user_id AS STRING))) AS shas, event_type AS predicted, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'unknown' ELSE concat('s', event_id % 3) END AS predicted_sub, CAST(event_id * 37 % 100003 AS DOUBLE) / 100003 AS confidence, event_id % 3 <> 0 AS is_correct, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'view' END AS answer, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('s', event_id % 4) END AS answer_sub FROM {events}"
    return spark.sql(text, events=read(spark, d, "events"))


@query(
    "c_14_derive_records",
    f"""WITH {RAW}, a AS (SELECT raw.*, CASE WHEN is_correct THEN predicted ELSE answer END AS actual, CASE WHEN is_correct THEN predicted_sub ELSE answer_sub END AS g FROM raw),
    b AS (SELECT a.*, subs, CASE WHEN g <> '' AND g <> 'unknown' THEN g END AS given FROM a LEFT JOIN children USING (actual)),
    c AS (SELECT *, CASE WHEN len(subs) = 1 THEN subs[1] ELSE given END AS actual_sub FROM b)
    SELECT id, substr(sha256(shas[1] || shas[2]), 1, 16) AS item_key, actual, actual_sub, actual = predicted AS type_correct,
    CASE WHEN actual_sub IS NOT NULL AND predicted_sub <> 'unknown' THEN actual = predicted AND actual_sub = predicted_sub END AS subtype_correct, round(confidence, 4) AS confidence,
    CASE WHEN actual IS NULL THEN 'no_label' WHEN given IS NOT NULL AND NOT coalesce(list_contains(subs, given), false) THEN 'foreign_sub_type' END AS error FROM c""",
)
def c_14(spark: SparkSession, d: str) -> DataFrame:
    children = spark.sql("SELECT * FROM VALUES ('view', array('s0', 's1')), ('click', array('s1')), ('error', array('s0', 's1', 's2')) AS t(waste_type, subs)")
    return feedback.derive(raw_answers(spark, d), children)


@query("j_15_belongs", "SELECT event_id AS id FROM events WHERE (event_type = 'view' AND event_id % 3 IN (0, 1)) OR (event_type = 'click' AND event_id % 3 = 1)")
def j_15(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.sql("SELECT * FROM VALUES ('view', 's0'), ('view', 's1'), ('click', 's1') AS t(waste_type, sub_type)")
    rec = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("waste_type"), F.concat(F.lit("s"), F.col("event_id") % 3).alias("sub_type"))
    return feedback.belongs(rec, pairs).select("id")


# ---- prediction tables ----
def leaves(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "leaf_probs")


TYPES = """types AS (SELECT id, waste_type, sum(CAST(p AS DECIMAL(28,12)))::DOUBLE AS tp FROM leaf_probs GROUP BY ALL),
    best AS (SELECT * FROM types QUALIFY row_number() OVER (PARTITION BY id ORDER BY tp DESC, waste_type) = 1),
    sub AS (SELECT l.* FROM leaf_probs l JOIN best USING (id, waste_type) QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY p DESC, leaf) = 1),
    rolled AS (SELECT b.id, b.waste_type, s.sub_type, b.tp AS type_confidence, s.p AS leaf_confidence, s.p / b.tp AS subtype_confidence FROM best b JOIN sub s USING (id))"""


@query("j_14_type_probabilities", "WITH " + TYPES + " SELECT id, waste_type, round(tp, 6) AS p FROM types", "leaf_probs")
def j_14(spark: SparkSession, d: str) -> DataFrame:
    return predict.type_probabilities(leaves(spark, d)).select("id", "waste_type", F.round("p", 6).alias("p"))


@query("d_01_roll_up", "WITH " + TYPES + " SELECT id, waste_type, sub_type, round(type_confidence, 4) AS type_confidence, round(subtype_confidence, 4) AS subtype_confidence, round(leaf_confidence, 4) AS leaf_confidence FROM rolled", "leaf_probs")
def d_01(spark: SparkSession, d: str) -> DataFrame:
    r = predict.roll_up(leaves(spark, d))
    return r.select("id", "waste_type", "sub_type", *[F.round(c, 4).alias(c) for c in ("type_confidence", "subtype_confidence", "leaf_confidence")])


@query("t_04_top_leaves", "SELECT id, rank::INT AS rank, leaf, round(p, 4) AS p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, leaf) AS rank FROM leaf_probs) WHERE rank <= 3", "leaf_probs")
def t_04(spark: SparkSession, d: str) -> DataFrame:
    return predict.top_leaves(leaves(spark, d), 3)


#: Thresholds of the status queries: by type where given, else global.
KNN = "(id * 13 % 100)::DOUBLE / 100"
STATUS_IN = f"""th(waste_type, k, f) AS (VALUES ('a', 0.5::DOUBLE, 0.9::DOUBLE), ('b', 0.3::DOUBLE, 0.8::DOUBLE)),
    st AS (SELECT r.*, CASE WHEN id % 19 = 0 THEN NULL ELSE {KNN} END AS knn, coalesce(th.k, 0.6::DOUBLE) AS thr, coalesce(th.f, 0.95::DOUBLE) AS far, id % 7 = 0 AS familiar, (id % 11)::DOUBLE / 20 AS other_mass FROM rolled r LEFT JOIN th USING (waste_type)),
    flags AS (SELECT *, coalesce(knn > thr, false) AND NOT familiar AS odd, coalesce(knn > far, false) AND NOT familiar AS very, type_confidence < 0.4 AS close FROM st),
    stat AS (SELECT *, CASE WHEN other_mass > type_confidence THEN 'unknown' WHEN very THEN 'unknown' WHEN odd AND close THEN 'unknown' WHEN odd OR close THEN 'confirm' ELSE 'detected' END AS status,
        CASE WHEN other_mass > type_confidence THEN 'other_material' WHEN very THEN 'very_far' WHEN odd AND close THEN 'odd+close' WHEN odd THEN 'odd' WHEN close THEN 'close' END AS reasons FROM flags)"""


def status_rows(spark: SparkSession, d: str) -> DataFrame:
    by_type = spark.sql("SELECT * FROM VALUES ('a', 0.5D, 0.9D), ('b', 0.3D, 0.8D) AS t(waste_type, knn_threshold, far_threshold)")
    r = predict.roll_up(leaves(spark, d)).withColumn("knn", F.when(F.col("id") % 19 == 0, F.lit(None)).otherwise((F.col("id") * 13 % 100).cast("double") / 100))
    r = predict.with_thresholds(r, by_type, 0.6, 0.95).withColumn("familiar", F.col("id") % 7 == 0).withColumn("other_mass", (F.col("id") % 11).cast("double") / 20)
    args = (F.col("type_confidence"), F.col("knn"), F.col("thr"), F.col("far"), F.lit(0.4), F.col("familiar"), F.col("other_mass"))
    return r.withColumn("status", predict.status(*args)).withColumn("reasons", predict.reasons(*args))


@query("d_02_status", f"WITH {TYPES}, {STATUS_IN} SELECT id, waste_type, status FROM stat", "leaf_probs")
def d_02(spark: SparkSession, d: str) -> DataFrame:
    return status_rows(spark, d).select("id", "waste_type", "status")


@query("d_03_confident", f"WITH {TYPES}, {STATUS_IN} SELECT id, type_confidence >= 0.45 AND status = 'detected' AS is_confident, reasons FROM stat", "leaf_probs")
def d_03(spark: SparkSession, d: str) -> DataFrame:
    return status_rows(spark, d).select("id", ((F.col("type_confidence") >= 0.45) & (F.col("status") == "detected")).alias("is_confident"), "reasons")


@query("d_05_small_guard", f"WITH {TYPES}, {STATUS_IN} SELECT id, CASE WHEN id * 7 % 400 < 160 AND status = 'detected' AND waste_type = 'c' AND id % 5 <> 0 THEN 'confirm' ELSE status END AS status, id * 7 % 400 < 160 AS small_image FROM stat", "leaf_probs")
def d_05(spark: SparkSession, d: str) -> DataFrame:
    r = status_rows(spark, d).withColumn("short_side", F.col("id") * 7 % 400).withColumn("has_memory", F.col("id") % 5 == 0)
    return predict.small_guard(r, "c").select("id", "status", "small_image")


@query("d_09_unknown_mask", f"WITH {TYPES}, {STATUS_IN} SELECT id, coalesce(knn > far, false) OR (coalesce(knn > thr, false) AND close) AS unknown FROM flags", "leaf_probs")
def d_09(spark: SparkSession, d: str) -> DataFrame:
    args = (F.col("type_confidence"), F.col("knn"), F.col("thr"), F.col("far"), F.lit(0.4), F.lit(False), F.lit(0.0))
    return status_rows(spark, d).select("id", (predict.status(*args) == "unknown").alias("unknown"))


@query("d_10_error_taxonomy", f"WITH {TYPES}, {STATUS_IN} SELECT id, CASE WHEN id % 23 = 0 THEN 'unreadable' WHEN status = 'unknown' THEN 'rejected_unknown' WHEN id % 3 > 0 AND type_confidence >= 0.45 THEN 'none' WHEN id % 3 > 0 THEN 'correct_low_confidence' WHEN type_confidence >= 0.45 THEN 'confidently_misclassified' ELSE 'misclassified_uncertain' END AS error_type FROM stat", "leaf_probs")
def d_10(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("id") % 3 > 0
    return status_rows(spark, d).select("id", predict.outcome(F.col("id") % 23 != 0, F.col("status"), ok, ok, F.col("type_confidence") >= 0.45).alias("error_type"))


@query("b_07_autofill", f"WITH {TYPES} SELECT id, CASE WHEN sub_type IN ('p', 'q') AND subtype_confidence >= 0.85 THEN sub_type ELSE 'unknown' END AS sub_type FROM rolled", "leaf_probs")
def b_07(spark: SparkSession, d: str) -> DataFrame:
    r = predict.roll_up(leaves(spark, d))
    return r.select("id", predict.autofill(F.col("sub_type"), F.col("subtype_confidence"), F.array(F.lit("p"), F.lit("q"))).alias("sub_type"))


@query("d_12_photo_verdict", "SELECT doc_id AS id, CASE WHEN n_chars < 160 THEN 'low' WHEN n_chars < 224 THEN 'fair' ELSE 'good' END AS verdict FROM documents")
def d_12(spark: SparkSession, d: str) -> DataFrame:
    from loopgrade.functions.labels import photo_verdict

    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), photo_verdict(F.col("n_chars")).alias("verdict"))


VOTE = """items AS (SELECT DISTINCT id, id // 3 AS item FROM leaf_probs), np AS (SELECT item, count(*) AS n FROM items GROUP BY 1),
    kept AS (SELECT * FROM leaf_probs WHERE (id + length(leaf)) % 5 <> 0 OR sub_type IS NOT NULL),
    mean AS (SELECT item AS id, leaf, waste_type, sub_type, sum(CAST(p AS DECIMAL(28,12)))::DOUBLE / any_value(n) AS p FROM kept JOIN items USING (id) JOIN np USING (item) GROUP BY ALL)"""


def photos(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = leaves(spark, d)
    items = rows.select("id", F.floor(F.col("id") / 3).alias("item")).distinct()
    return rows.where("(id + length(leaf)) % 5 <> 0 or sub_type is not null"), items


@query("d_06_vote", f"WITH {VOTE} SELECT id, leaf, round(p, 6) AS p FROM mean GROUP BY ALL", "leaf_probs")
def d_06(spark: SparkSession, d: str) -> DataFrame:
    return predict.vote(*photos(spark, d)).select("id", "leaf", F.round("p", 6).alias("p"))


@query("d_08_group_result", f"WITH {VOTE}, {TYPES.replace('leaf_probs', 'mean')} SELECT id, waste_type, sub_type, round(type_confidence, 4) AS type_confidence FROM rolled", "leaf_probs")
def d_08(spark: SparkSession, d: str) -> DataFrame:
    return predict.roll_up(predict.vote(*photos(spark, d)).drop("n_photos")).select("id", "waste_type", "sub_type", F.round("type_confidence", 4).alias("type_confidence"))


#: Photos with what was found about each: three of an item, every fourth item's photos show different things.
SHOWN = """SELECT id, item, item % 4 <> 0 AS same_item, CASE WHEN item % 7 = 0 AND id % 3 = 1 THEN NULL ELSE CAST(id * 13 % 100 AS DOUBLE) / 100 END AS knn, id * 7 % 400 < 320 AS small,
    CASE WHEN item % 5 = 0 OR id % 4 = 0 THEN id % 5 + 1 END AS n_similar, CAST(id % 10 AS DOUBLE) / 20 AS nearest, CAST(id % 7 AS DOUBLE) / 10 AS weight, CASE WHEN item % 10 = 0 THEN 'other' WHEN id % 2 = 0 THEN 'a,z' ELSE 'b' END AS label_list,
    CASE WHEN item % 10 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS other_mass FROM (SELECT id, CAST(floor(id / 3) AS BIGINT) AS item FROM {leaf_probs} GROUP BY id) AS i"""
GROUPED = f"""shown AS ({SHOWN.format(leaf_probs='leaf_probs')}), keyed AS (SELECT s.*, concat(item, '/', CASE WHEN same_item THEN '' ELSE CAST(id AS VARCHAR) END) AS k, r.waste_type AS best_type FROM shown s JOIN rolled r USING (id)),
    meank AS (SELECT k AS id, leaf, l.waste_type, l.sub_type, sum(CAST(p AS DECIMAL(28,12)))::DOUBLE / count(DISTINCT l.id) AS p FROM leaf_probs l JOIN keyed USING (id) GROUP BY ALL)"""
GROUP_ROWS = """g AS (SELECT k, item, any_value(CASE WHEN NOT same_item THEN id END) AS id, bool_and(same_item) AS same, count(*) AS n, count(knn) AS nk, sum(CAST(knn AS DECIMAL(28,12)))::DOUBLE / count(*) AS knn, bool_and(small) AS small, count(n_similar) AS nm, sum(n_similar)::BIGINT AS n_similar,
        min(nearest) FILTER (n_similar IS NOT NULL) AS nearest, max(weight) FILTER (n_similar IS NOT NULL) AS weight, coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(label_list, ',')) FILTER (n_similar IS NOT NULL)))), ','), '') AS labels, bool_or(label_list = 'other' AND n_similar IS NOT NULL) AS oo, max(other_mass) AS om FROM keyed GROUP BY k, item),
    th(waste_type, kt, ft) AS (VALUES ('a', 0.5::DOUBLE, 0.9::DOUBLE), ('b', 0.3::DOUBLE, 0.8::DOUBLE)),
    t AS (SELECT g.*, r.waste_type, r.sub_type, r.type_confidence AS c, coalesce(kt, 0.6) AS thr, ft AS far, CASE WHEN nk = n THEN g.knn END AS dist, NOT same OR nk = n AS cal, nm > 0 AS fam, CASE WHEN NOT same THEN om WHEN oo AND nm = n THEN 1.0 ELSE 0.0 END AS other FROM g JOIN krolled r ON r.id = g.k LEFT JOIN th ON th.waste_type = r.waste_type),
    f AS (SELECT *, coalesce(dist > thr, false) AND NOT fam AS odd, coalesce(dist > far, false) AND NOT fam AS very, c < 0.4 AS close FROM t),
    st AS (SELECT *, CASE WHEN NOT cal THEN 'detected' WHEN other > c OR very OR odd AND close THEN 'unknown' WHEN odd OR close THEN 'confirm' ELSE 'detected' END AS s0 FROM f),
    fin AS (SELECT *, CASE WHEN small AND s0 = 'detected' AND waste_type = 'c' AND NOT fam THEN 'confirm' ELSE s0 END AS status FROM st)
    SELECT fin.item, fin.id, n AS n_images, (SELECT count(*) FROM keyed k WHERE k.k = fin.k AND k.best_type = fin.waste_type) AS agreement, waste_type, sub_type, round(c, 4) AS type_confidence, status, c >= CASE WHEN cal THEN 0.45 ELSE 0.6 END AND status = 'detected' AS is_confident, small AS small_image, round(dist, 4) AS knn, n_similar, nearest, weight, labels FROM fin"""


def _rename(types: str) -> str:
    """The roll-up's tables under names of their own, over the averaged leaves."""
    for name in ("types", "best", "sub", "rolled"):
        types = types.replace(f"{name} AS (", f"k{name} AS (").replace(f"FROM {name} ", f"FROM k{name} ").replace(f"JOIN {name} ", f"JOIN k{name} ")
    return types.replace("leaf_probs", "meank")


@query("d_08_group_status", f"WITH {TYPES}, {GROUPED}, {_rename(TYPES)}, {GROUP_ROWS}", "leaf_probs")
def d_08b(spark: SparkSession, d: str) -> DataFrame:
    probs = leaves(spark, d)
    by_type = spark.sql("SELECT * FROM VALUES ('a', 0.5D, 0.9D), ('b', 0.3D, 0.8D) AS t(waste_type, knn_threshold, far_threshold)")
    shown = spark.sql(SHOWN, leaf_probs=probs).withColumn("labels", F.split("label_list", ","))
    own = predict.roll_up(probs).select("id", F.col("waste_type").alias("best_type"))
    out = predict.group_results(shown.join(own, "id"), probs, by_type, 0.6, 0.4, 0.45, "c")
    return out.withColumn("type_confidence", F.round("type_confidence", 4)).withColumn("knn", F.round("knn", 4))


@query(
    "d_07_legacy_combine",
    """WITH t AS (SELECT id, waste_type, round(sum(CAST(p AS DECIMAL(28,12))), 4)::DOUBLE AS p FROM leaf_probs GROUP BY ALL), n AS (SELECT id // 3 AS item, count(DISTINCT id) AS n FROM t GROUP BY 1),
    k AS (SELECT *, id // 3 AS item FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, waste_type) <= 3)
    SELECT item, waste_type, round(sum(CAST(p AS DECIMAL(20,6)))::DOUBLE / any_value(n), 5) AS p FROM k JOIN n USING (item) GROUP BY ALL""",
    "leaf_probs",
)
def d_07(spark: SparkSession, d: str) -> DataFrame:
    t = predict.type_probabilities(leaves(spark, d)).select("id", F.col("waste_type").alias("leaf"), F.round("p", 4).alias("p"))
    top = predict.top_leaves(t, 3)
    n = t.groupBy(F.floor(F.col("id") / 3).alias("item")).agg(F.count_distinct("id").alias("n"))
    g = top.groupBy(F.floor(F.col("id") / 3).alias("item"), F.col("leaf").alias("waste_type")).agg(F.sum(F.col("p").cast("decimal(20,6)")).cast("double").alias("s"))
    return g.join(n, "item").select("item", "waste_type", F.round(F.col("s") / F.col("n"), 5).alias("p"))


MEMORY_T, CURVE_T = 0.55, 0.75
DIST = "1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
NEAR = f"near AS (SELECT a.vec_id AS id, b.vec_id AS mem_id, b.label AS label, {DIST} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 7 <> 0 AND b.vec_id % 7 = 0 WHERE {DIST} <= {MEMORY_T})"


def memory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, d, "embeddings")
    return v.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("id"), "embedding"), v.where("vec_id % 7 = 0").select(F.col("vec_id").alias("mem_id"), "label", "embedding")


@query("j_07_radius_join", f"WITH {NEAR} SELECT id, mem_id, label, round(distance, 5) AS distance FROM near")
def j_07(spark: SparkSession, d: str) -> DataFrame:
    return vectors.within(*memory(spark, d), MEMORY_T).select("id", "mem_id", "label", F.round("distance", 5).alias("distance"))


MEM_LABEL = "CASE label % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'other' END AS mem_type, CASE WHEN label % 3 = 0 THEN 'p' WHEN label % 3 = 1 THEN 'zz' END AS mem_sub"


@query(
    "d_04_memory_blend",
    f"""WITH {NEAR}, m AS (SELECT id, {MEM_LABEL}, greatest(0, least(1, 1 - distance / {MEMORY_T})) AS w FROM near),
    tot AS (SELECT id, sum(w) AS ws, max(w) AS wm, sum(CASE WHEN mem_type = 'other' THEN w ELSE 0 END) AS wo FROM m GROUP BY 1 HAVING sum(w) > 0),
    lab AS (SELECT m.id, m.mem_type, l.sub_type AS s, sum(w) AS w FROM m LEFT JOIN leaf_probs l ON l.id = m.id AND l.waste_type = m.mem_type AND l.sub_type = m.mem_sub WHERE mem_type <> 'other' GROUP BY ALL),
    tp AS (SELECT id, waste_type, sum(p) AS pt FROM leaf_probs GROUP BY ALL),
    j AS (SELECT l.*, coalesce(e.w, 0) + coalesce(t.w * l.p / tp.pt, 0) AS target FROM leaf_probs l JOIN tp USING (id, waste_type) LEFT JOIN lab e ON e.id = l.id AND e.mem_type = l.waste_type AND e.s = l.sub_type LEFT JOIN lab t ON t.id = l.id AND t.mem_type = l.waste_type AND t.s IS NULL),
    su AS (SELECT id, sum(target) AS ts FROM j GROUP BY 1)
    SELECT j.id, leaf, round(CASE WHEN wm IS NOT NULL AND ts + wo > 0 THEN (1 - least(0.95, wm)) * p + least(0.95, wm) * target / (ts + wo) ELSE p END, 5) AS p, round(CASE WHEN wm IS NOT NULL AND ts + wo > 0 THEN least(0.95, wm) * wo / (ts + wo) ELSE 0 END, 5) AS other_mass FROM j JOIN su USING (id) LEFT JOIN tot ON tot.id = j.id""",
    "leaf_probs",
)
def d_04(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.within(*memory(spark, d), MEMORY_T)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("a", "b", "c", "other")]), (F.col("label") % 4 + 1).cast("int"))
    sub = F.when(F.col("label") % 3 == 0, "p").when(F.col("label") % 3 == 1, "zz")
    out = predict.blend(leaves(spark, d), near.select("id", kind.alias("mem_type"), sub.alias("mem_sub"), "distance"), MEMORY_T)
    return out.select("id", "leaf", F.round("p", 5).alias("p"), F.round("other_mass", 5).alias("other_mass"))


# ---- neighbours and calibration ----
NN = f"pairs AS (SELECT a.vec_id AS id, a.label AS truth, b.vec_id AS bank_id, b.label AS label, {DIST} AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, bank_id) AS r FROM pairs)"


def bank(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, d, "embeddings")
    return v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("id"), "embedding"), v.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("bank_id"), "label", "embedding")


@query("j_05_knn_distance", f"WITH {NN} SELECT id, round(avg(d), 5) AS knn FROM nn WHERE r <= 5 GROUP BY 1")
def j_05(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn_distance(*bank(spark, d), 5).select("id", F.round("knn", 5).alias("knn"))


@query("j_06_nearest_neighbour", f"WITH {NN} SELECT id, label, round(d, 5) AS distance FROM nn WHERE r = 1")
def j_06(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbours(*bank(spark, d), 1).select("id", "label", F.round("distance", 5).alias("distance"))


@query("t_05_k_smallest", f"WITH {NN} SELECT id, bank_id FROM nn WHERE r <= 5")
def t_05(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbours(*bank(spark, d), 5).select("id", "bank_id")


VAL = "val AS (SELECT id, milli::DOUBLE / 1001 AS confidence, ((id * 7919 % 10007)::DOUBLE / 10007) AS knn, truth AS waste_type, truth = pred AS correct FROM classified)"


def val_rows(spark: SparkSession, d: str) -> DataFrame:
    c = bind(spark, d, "classified")
    return c.select("id", (F.col("milli").cast("double") / 1001).alias("confidence"), ((F.col("id") * 7919 % 10007).cast("double") / 10007).alias("knn"), F.col("truth").alias("waste_type"), (F.col("truth") == F.col("pred")).alias("correct"))


THR = "thr AS (SELECT waste_type, quantile_cont(knn, 0.975) AS k, quantile_cont(knn, 0.995) AS f, count(*) AS n FROM val GROUP BY 1)"


@query("e_01_knn_thresholds", f"WITH {VAL}, {THR} SELECT waste_type, round(k, 6) AS knn_threshold, round(f, 6) AS far_threshold, n FROM thr", "classified")
def e_01(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.knn_thresholds(val_rows(spark, d)).select("waste_type", F.round("knn_threshold", 6).alias("knn_threshold"), F.round("far_threshold", 6).alias("far_threshold"), "n")


@query("e_02_msp_floor", f"WITH {VAL}, {THR}, p AS (SELECT v.*, knn <= k AS ok FROM val v JOIN thr USING (waste_type)), z AS (SELECT 0.05 * count(*) - count(*) FILTER (NOT ok) AS target, count(*) FILTER (ok) AS m FROM p), r AS (SELECT confidence, row_number() OVER (ORDER BY confidence, id) AS rank FROM p WHERE ok) SELECT round(coalesce(max(confidence), 0.0), 6) AS msp_threshold FROM r, z WHERE target > 0 AND rank = greatest(0, least(m - 1, floor(target))) + 1", "classified")
def e_02(spark: SparkSession, d: str) -> DataFrame:
    v = val_rows(spark, d)
    return calibrate.msp_floor(v, calibrate.knn_thresholds(v)).select(F.round("msp_threshold", 6).alias("msp_threshold"))


@query("e_03_min_confidence", f"WITH {VAL} SELECT round(quantile_cont(confidence, 0.05), 6) AS min_confidence FROM val WHERE correct", "classified")
def e_03(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.min_confidence(val_rows(spark, d)).select(F.round("min_confidence", 6).alias("min_confidence"))


AGREE = "ag AS (SELECT id, milli AS m, milli::DOUBLE / 1001 AS distance, NOT (milli > 500 AND id % 3 = 0) AS agree FROM classified), cp AS (SELECT *, row_number() OVER o AS rank, count(*) FILTER (agree) OVER o AS agreed FROM ag WINDOW o AS (ORDER BY distance, id ROWS UNBOUNDED PRECEDING))"


def agreeing(spark: SparkSession, d: str) -> DataFrame:
    c = bind(spark, d, "classified")
    return c.select("id", (F.col("milli").cast("double") / 1001).alias("distance"), (~((F.col("milli") > 500) & (F.col("id") % 3 == 0))).alias("agree"))


@query("w_02_cumulative_precision", f"WITH {AGREE} SELECT id, rank, round(agreed / rank, 6) AS precision FROM cp", "classified")
def w_02(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.cumulative_precision(agreeing(spark, d)).select("id", "rank", F.round("precision", 6).alias("precision"))


@query("e_04_memory_threshold", f"WITH {AGREE} SELECT round(coalesce(max_by(distance, rank) FILTER (agreed / rank >= 0.98 AND rank >= 50), quantile_cont(distance, 0.05)), 6) AS memory_threshold FROM cp", "classified")
def e_04(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.memory_threshold(agreeing(spark, d)).select(F.round("memory_threshold", 6).alias("memory_threshold"))


@query("e_05_calibration_report", f"WITH {VAL}, {THR} SELECT waste_type, round(avg((knn > k OR confidence < 0.1)::INT), 6) AS flagged, round(avg(CASE WHEN correct THEN (confidence >= 0.05)::INT END), 6) AS kept_confident, round(avg(CASE WHEN NOT correct THEN (confidence < 0.05)::INT END), 6) AS wrong_below FROM val JOIN thr USING (waste_type) GROUP BY 1", "classified")
def e_05(spark: SparkSession, d: str) -> DataFrame:
    v = val_rows(spark, d)
    j = v.join(bounded(calibrate.knn_thresholds(v)), "waste_type")
    c = F.col("confidence")
    return j.groupBy("waste_type").agg(evaluate.share((F.col("knn") > F.col("knn_threshold")) | (c < 0.1)).alias("flagged"), evaluate.share(F.when(F.col("correct"), c >= 0.05)).alias("kept_confident"), evaluate.share(F.when(~F.col("correct"), c < 0.05)).alias("wrong_below"))


@query(
    "e_05_totals",
    f"""WITH {VAL}, {THR}, {AGREE}, mt AS (SELECT coalesce(max_by(distance, rank) FILTER (agreed / rank >= 0.98 AND rank >= 50), quantile_cont(distance, 0.05)) AS t FROM cp), v AS (SELECT count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg((knn > k OR confidence < 0.1)::INT), 6) AS flagged,
        round(avg(CASE WHEN correct THEN (confidence >= 0.05)::INT END), 6) AS kept_confident, round(avg(CASE WHEN NOT correct THEN (confidence < 0.05)::INT END), 6) AS wrong_below FROM val JOIN thr USING (waste_type)),
    m AS (SELECT round(max(t), 6) AS memory_threshold, round(avg((distance <= t)::INT), 6) AS memory_coverage, round(avg(agree::INT) FILTER (distance <= t), 6) AS memory_precision FROM ag, mt) SELECT * FROM v, m""",
    "classified",
)
def e_05b(spark: SparkSession, d: str) -> DataFrame:
    v = val_rows(spark, d)
    return calibrate.report(v, calibrate.knn_thresholds(v), 0.1, 0.05, agreeing(spark, d))


@query("g_45_familiarity", f"WITH {VAL}, {THR} SELECT waste_type, round(quantile_cont(v.knn, 0.5), 6) AS median_knn, round(avg((knn > k)::INT), 6) AS unfamiliar, round(avg((knn > f)::INT), 6) AS far FROM val v JOIN thr USING (waste_type) GROUP BY 1", "classified")
def g_45(spark: SparkSession, d: str) -> DataFrame:
    v = val_rows(spark, d)
    j = v.join(bounded(calibrate.knn_thresholds(v)), "waste_type")
    median = ordered.quantiles(v, ["waste_type"], "knn", {"m": 0.5}).select("waste_type", F.round("m", 6).alias("median_knn"))
    return median.join(j.groupBy("waste_type").agg(evaluate.share(F.col("knn") > F.col("knn_threshold")).alias("unfamiliar"), evaluate.share(F.col("knn") > F.col("far_threshold")).alias("far")), "waste_type")


OPEN = """s AS (SELECT truth, milli::DOUBLE / 1001 AS confidence, (id * 7919 % 10007)::DOUBLE / 10007 AS knn FROM classified), k AS (SELECT DISTINCT truth AS unseen FROM s), r AS (SELECT k.unseen, s.truth = k.unseen AS ood, s.* FROM s, k),
    f AS (SELECT unseen, quantile_cont(confidence, 0.05) AS floor FROM r WHERE NOT ood GROUP BY 1),
    m AS (SELECT r.*, floor, rank() OVER (PARTITION BY unseen ORDER BY confidence DESC) + (count(*) OVER (PARTITION BY unseen, confidence) - 1) / 2.0 AS rc, rank() OVER (PARTITION BY unseen ORDER BY knn) + (count(*) OVER (PARTITION BY unseen, knn) - 1) / 2.0 AS rk FROM r JOIN f USING (unseen))"""


def _auc(rank: str) -> str:
    return f"round((sum(CASE WHEN ood THEN {rank} END) - count(*) FILTER (ood) * (count(*) FILTER (ood) + 1) / 2.0) / (count(*) FILTER (ood) * count(*) FILTER (NOT ood)), 6)"


@query("g_46_open_set", f"WITH {OPEN} SELECT unseen, count(*) FILTER (ood) AS n, round(avg(CASE WHEN ood THEN (confidence < floor)::INT END), 6) AS rejected_msp, round(avg(CASE WHEN ood THEN (knn > 0.9 OR confidence < 0.3)::INT END), 6) AS rejected_combined, {_auc('rc')} AS auroc_msp, {_auc('rk')} AS auroc_knn FROM m GROUP BY 1", "classified")
def g_46(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.open_set(val_rows(spark, d).withColumnRenamed("waste_type", "truth"), 0.3, 0.9)


# ---- evaluation ----
def classified(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "classified")


@query("g_15_confusion", "SELECT truth, pred, count(*) AS n FROM classified GROUP BY ALL", "classified")
def g_15(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(classified(spark, d))


@query("g_15_confusion_wide", "SELECT truth, " + ", ".join(f"count(*) FILTER (pred = '{c}') AS {c}" for c in ("click", "view", "purchase", "signup", "error")) + " FROM classified GROUP BY 1", "classified")
def g_15b(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion_wide(classified(spark, d), ["click", "view", "purchase", "signup", "error"])


PRF = "t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = pred) AS tp FROM classified GROUP BY 1), p AS (SELECT pred AS label, count(*) AS predicted FROM classified GROUP BY 1), prf AS (SELECT label, tp / predicted AS pr, tp / support AS re, support FROM t JOIN p USING (label))"


@query("g_16_per_class", f"WITH {PRF} SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1, support FROM prf", "classified")
def g_16(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_class(classified(spark, d)).withColumn("support", F.col("support").cast("long"))


@query("g_16_macro_f1", f"WITH {PRF} SELECT round(avg(round(2 * pr * re / (pr + re), 6)), 4) AS macro_f1 FROM prf", "classified")
def g_16b(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.macro_f1(classified(spark, d))


@query("g_17_top_accuracy", "WITH r AS (SELECT id, leaf, row_number() OVER (PARTITION BY id ORDER BY p DESC, leaf) AS rank FROM leaf_probs), e AS (SELECT vec_id AS id, ['a__p','a__q','a__r','b__p','b__q','c__p','c__q','c__r','c__s','d'][label + 1] AS truth FROM embeddings) SELECT truth, count(DISTINCT id) AS n, round(sum((leaf = truth AND rank = 1)::INT) / count(DISTINCT id), 6) AS top1, round(sum((leaf = truth AND rank <= 3)::INT) / count(DISTINCT id), 6) AS top3 FROM e JOIN r USING (id) GROUP BY 1", "leaf_probs")
def g_17(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("a__p", "a__q", "a__r", "b__p", "b__q", "c__p", "c__q", "c__r", "c__s", "d")])
    truth = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.element_at(names, F.col("label") + 1).alias("truth"))
    top = predict.top_leaves(leaves(spark, d), 3).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "leaf"))).alias("x"))
    j = truth.join(top, "id")
    return j.groupBy("truth").agg(F.count("*").alias("n"), evaluate.share(F.get("x", F.lit(0))["leaf"] == F.col("truth")).alias("top1"), evaluate.share(F.exists("x", lambda e: e["leaf"] == F.col("truth"))).alias("top3"))


TRUE_LEAVES = ("a__p", "a__q", "a__r", "b__p", "b__q", "c__p", "c__q", "c__r", "c__s", "d")


@query(
    "g_17_levels",
    f"""WITH {TYPES}, {STATUS_IN}, lr AS (SELECT id, leaf, row_number() OVER (PARTITION BY id ORDER BY p DESC, leaf) AS r FROM leaf_probs), tr AS (SELECT id, waste_type, row_number() OVER (PARTITION BY id ORDER BY tp DESC, waste_type) AS r FROM types),
    e AS (SELECT vec_id AS id, {list(TRUE_LEAVES)}[label + 1] AS true_leaf FROM embeddings),
    x AS (SELECT e.id, true_leaf, lr.r AS l, tr.r AS t, coalesce(knn > far, false) OR (coalesce(knn > thr, false) AND close) AS unknown FROM e JOIN lr ON lr.id = e.id AND lr.leaf = true_leaf JOIN tr ON tr.id = e.id AND tr.waste_type = split_part(true_leaf, '__', 1) JOIN flags f ON f.id = e.id)
    SELECT true_leaf, count(*) AS n, round(avg((l = 1)::INT), 6) AS leaf_top1, round(avg((l <= 3)::INT), 6) AS leaf_top3, round(avg((t = 1)::INT), 6) AS type_top1, round(avg((t <= 3)::INT), 6) AS type_top3, round(avg(unknown::INT), 6) AS flagged_unknown FROM x GROUP BY ROLLUP (true_leaf)""",
    "leaf_probs",
)
def g_17b(spark: SparkSession, d: str) -> DataFrame:
    r = cut(status_rows(spark, d))
    args = (F.col("type_confidence"), F.col("knn"), F.col("thr"), F.col("far"), F.lit(0.4), F.lit(False), F.lit(0.0))
    names = F.array(*[F.lit(x) for x in TRUE_LEAVES])
    truth = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.element_at(names, F.col("label") + 1).alias("true_leaf"))
    truth = truth.join(r.select("id", (predict.status(*args) == "unknown").alias("unknown")), "id").withColumn("true_type", F.split_part("true_leaf", F.lit("__"), F.lit(1)))
    return evaluate.top_accuracy(r, truth)


@query("g_18_accuracy_sets", "SELECT truth, split, count(*) AS n, round(avg((truth = pred)::INT), 6) AS accuracy, grouping(split)::INT AS all_of_b FROM classified GROUP BY GROUPING SETS ((truth), (truth, split))", "classified")
def g_18(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy_sets(classified(spark, d), "truth", "split")


@query("g_19_frequent_confusions", "SELECT truth, pred, count(*) AS n, count(*) FILTER (accepted) AS accepted, round(count(*) / any_value(total), 6) AS share FROM classified JOIN (SELECT truth, count(*) AS total FROM classified GROUP BY 1) USING (truth) WHERE truth <> pred GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10", "classified")
def g_19(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.frequent_confusions(classified(spark, d), 10)


@query("g_20_reliability", "SELECT CASE WHEN confidence < 0.5 THEN 0 WHEN confidence < 0.7 THEN 1 WHEN confidence < 0.9 THEN 2 WHEN confidence < 0.97 THEN 3 WHEN confidence < 0.99 THEN 4 ELSE 5 END AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg((truth = pred)::INT), 6) AS accuracy FROM classified GROUP BY 1", "classified")
def g_20(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.reliability(classified(spark, d))


@query("g_21_ece", "WITH b AS (SELECT ceil(round(confidence * 15, 9)) AS bin, count(*) AS n, avg(confidence) AS c, avg((truth = pred)::INT) AS a FROM classified GROUP BY 1) SELECT round(sum(CASE WHEN bin BETWEEN 1 AND 15 THEN n * abs(c - a) END) / sum(n), 6) AS ece FROM b", "classified")
def g_21(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ece(classified(spark, d))


@query("g_22_nll", "WITH " + TYPES + ", e AS (SELECT vec_id AS id, ['a', 'b', 'c', 'd', 'e'][label % 5 + 1] AS waste_type FROM embeddings) SELECT round(avg(-ln(greatest(least(tp, 1.0), 1e-6))), 6) AS nll FROM types JOIN e USING (id, waste_type)", "leaf_probs")
def g_22(spark: SparkSession, d: str) -> DataFrame:
    truth = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.element_at(F.array(*[F.lit(x) for x in "abcde"]), F.col("label") % 5 + 1).alias("waste_type"))
    return evaluate.nll(predict.type_probabilities(leaves(spark, d)).join(truth, ["id", "waste_type"]))


@query("g_23_auroc", "WITH m AS (SELECT truth = 1 AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored) SELECT round((sum(CASE WHEN pos THEN rk END) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auroc FROM m", "scored")
def g_23(spark: SparkSession, d: str) -> DataFrame:
    return ordered.auroc(bind(spark, d, "scored").withColumn("pos", F.col("truth") == 1), "score", "pos")


ACC = "round(avg((truth = pred)::INT), 6) AS accuracy, round(avg((status = 'unknown')::INT), 6) AS unknown_rate, round(avg(accepted::INT), 6) AS acceptance, round(avg((truth = pred AND accepted)::INT), 6) AS correct_acceptance, round(avg((truth <> pred AND accepted)::INT), 6) AS false_acceptance, round(count(*) FILTER (truth = pred AND accepted) / count(*) FILTER (accepted), 6) AS precision_of_accepted, round(avg(confidence) FILTER (truth = pred), 6) AS confidence_right, round(avg(confidence) FILTER (truth <> pred), 6) AS confidence_wrong"


@query("g_24_acceptance", f"SELECT condition, {ACC} FROM classified GROUP BY 1", "classified")
def g_24(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.acceptance(classified(spark, d), "condition")


WILSON = "round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS ci_low, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS ci_high"


def _category(by: str) -> str:
    """The measures of one grouping: per ``truth``, or of all rows."""
    n, hist = "count(*) FILTER (v)", "(SELECT string_agg(concat(x, '=', n), ',' ORDER BY x) FROM (SELECT {value} AS x, count(*) AS n FROM classified i WHERE status <> 'failed' {more} {same} GROUP BY 1))"
    same = "AND i.truth = c.truth" if by == "truth" else ""
    count = lambda x: f"count(*) FILTER (v AND {x})"
    rate = lambda x: f"round({count(x)} / {n}, 6)"
    measures = {
        "images": "count(*)", "valid": n, "correct": count("ok"), "incorrect": count("NOT ok"), "accuracy": rate("ok"), "accepted": count("a"), "acceptance_rate": rate("a"), "strong": count("ok AND a"), "weak": count("ok AND NOT a"),
        "wrong": count("NOT ok AND status <> 'unknown'"), "wrong_accepted": count("NOT ok AND a"), "rejected_unknown": count("status = 'unknown'"), "confirm": count("status = 'confirm'"), "unreadable": "count(*) FILTER (NOT v)",
        "best_guess_correct": count("best_guess_correct"), "memory_adjusted": count("memory_adjusted"), "conf_mean": "round(avg(confidence) FILTER (v), 5)", "conf_median": "round(quantile_cont(confidence, 0.5) FILTER (v), 6)",
        "conf_min": "min(confidence) FILTER (v)", "conf_max": "max(confidence) FILTER (v)", "ge90": rate("confidence >= 0.9"), "ge80": rate("confidence >= 0.8"), "ge50": rate("confidence >= 0.5"),
        "conf_correct_mean": "round(avg(confidence) FILTER (v AND ok), 5)", "conf_wrong_mean": "round(avg(confidence) FILTER (v AND NOT ok), 5)", "confidently_wrong_90": count("NOT ok AND status <> 'unknown' AND confidence >= 0.9"),
        "subtype_n": count("subtype_correct IS NOT NULL AND ok"), "subtype_correct": count("subtype_correct"),
    }
    low, high = (x.strip() for x in WILSON.replace("round(", "|round(").split("|")[1:])
    ci = ", ".join(x.rstrip(", ").replace("/ n", f"/ ({n})").replace("* n", f"* {n}").replace("k /", f"{count('ok')} /") for x in (low, high))
    every = ", ".join(f"{x} AS {name}" for name, x in measures.items())
    predicted = hist.format(value="pred", more="", same=same)
    subs = hist.format(value="concat(pred, '/', pred_sub)", more="AND status <> 'unknown'", same=same)
    key = "truth" if by == "truth" else "NULL"
    return f"SELECT {key} AS truth, {every}, {ci}, {predicted} AS predicted, {subs} AS predicted_subtypes FROM (SELECT *, status <> 'failed' AS v, truth = pred AS ok, status = 'detected' AS a FROM classified) c" + (" GROUP BY c.truth" if by == "truth" else "")


@query("g_25_per_category", f"WITH per AS ({_category('truth')}), every AS ({_category('all')}) SELECT * FROM per UNION ALL SELECT * FROM every", "classified")
def g_25(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_category(classified(spark, d))


@query("g_26_wilson", f"WITH g AS (SELECT condition, count(*)::DOUBLE AS n, count(*) FILTER (truth = pred) AS k FROM classified GROUP BY 1) SELECT condition, {WILSON} FROM g", "classified")
def g_26(spark: SparkSession, d: str) -> DataFrame:
    g = classified(spark, d).groupBy("condition").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("truth") == F.col("pred")).cast("double").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("condition", F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


#: A table for the rules of G-27 and G-28 in which every class and an unpassed threshold occur: four grades of recognition by truth.
GRADED = "graded AS (SELECT id, truth, CASE WHEN truth = 'click' AND id % 10 > 0 OR truth = 'view' AND id % 20 > 0 OR truth = 'purchase' AND id % 10 < 7 OR truth = 'signup' AND id % 2 = 0 THEN truth ELSE pred END AS pred, CASE WHEN truth = 'view' AND status = 'detected' AND id % 3 > 0 THEN 'confirm' ELSE status END AS status, confidence, best_guess_correct, pred_sub, memory_adjusted, subtype_correct FROM classified)"


def graded(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT * FROM (" + GRADED[len("graded AS (") : -1].replace("FROM classified", "FROM {c} AS classified") + ")", c=classified(spark, d))


@query("g_27_threshold_sweep", f"WITH {GRADED}, t(threshold) AS (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE), (1.5::DOUBLE)), m(mode) AS (VALUES ('pipeline'), ('confidence_only')), v AS (SELECT * FROM graded WHERE status <> 'failed'), z AS (SELECT count(*) AS total FROM v), a AS (SELECT threshold, mode, count(*) FILTER (confidence >= threshold AND (mode = 'confidence_only' OR status = 'detected')) AS n, count(*) FILTER (confidence >= threshold AND (mode = 'confidence_only' AND (truth = pred OR best_guess_correct) OR mode = 'pipeline' AND status = 'detected' AND truth = pred)) AS k FROM v, t, m GROUP BY ALL) SELECT threshold, mode, n AS accepted, round(n / total, 6) AS acceptance, round(k / total, 6) AS correct_acceptance, round((n - k) / total, 6) AS false_acceptance, CASE WHEN n > 0 THEN round(k / n, 6) END AS precision FROM a, z", "classified")
def g_27(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_sweep(graded(spark, d), [0.3, 0.5, 0.8, 0.95, 1.5])


@query("g_28_recognition", f"WITH {GRADED}, g AS (SELECT truth, avg((truth = pred)::INT) AS accuracy, avg((status = 'detected')::INT) AS acceptance, avg((truth = pred AND status = 'detected')::INT) AS strong FROM graded WHERE status <> 'failed' GROUP BY 1) SELECT truth, CASE WHEN accuracy >= 0.8 AND acceptance >= 0.5 AND strong >= 0.5 THEN 'strong' WHEN accuracy >= 0.6 THEN 'weak' ELSE 'misclassified' END AS recognition FROM g", "classified")
def g_28(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recognition(evaluate.per_category(graded(spark, d)))


@query("g_29_condition_matrix", "WITH c AS (SELECT grp, condition, avg((truth = pred)::INT) AS a, avg(accepted::INT) AS acc FROM classified GROUP BY ALL) SELECT grp, round(avg(a), 6) AS accuracy, round(avg(acc), 6) AS acceptance, count(*) AS conditions FROM c GROUP BY 1", "classified")
def g_29(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.condition_matrix(classified(spark, d))


@query("g_30_resolution", "SELECT milli // 200 AS size, round(avg((truth = pred)::INT), 6) AS accuracy, round(avg(CASE WHEN truth <> 'click' THEN (pred = 'click')::INT END), 6) AS others_called, round(avg(CASE WHEN truth = 'click' THEN (pred = 'click')::INT END), 6) AS recall FROM classified GROUP BY 1", "classified")
def g_30(spark: SparkSession, d: str) -> DataFrame:
    c = classified(spark, d)
    called = F.col("pred") == "click"
    g = c.groupBy(F.floor(F.col("milli") / 200).alias("size"))
    return g.agg(evaluate.share(F.col("truth") == F.col("pred")).alias("accuracy"), evaluate.share(F.when(F.col("truth") != "click", called)).alias("others_called"), evaluate.share(F.when(F.col("truth") == "click", called)).alias("recall"))


AFTER = "ba AS (SELECT id, condition, truth, pred AS before, CASE WHEN id % 10 = 0 THEN truth WHEN id % 10 = 1 THEN 'error' ELSE pred END AS after FROM classified)"


def before_after(spark: SparkSession, d: str) -> DataFrame:
    after = F.when(F.col("id") % 10 == 0, F.col("truth")).when(F.col("id") % 10 == 1, "error").otherwise(F.col("pred"))
    return classified(spark, d).withColumn("before", F.col("pred")).withColumn("after", after)


@query("g_33_memory_simulation", f"WITH {AFTER} SELECT condition, count(*) AS n, round(avg((truth = before)::INT), 6) AS accuracy_before, round(avg((truth = after)::INT), 6) AS accuracy_after, count(*) FILTER (truth <> before AND truth = after) AS fixed, count(*) FILTER (truth = before AND truth <> after) AS broken FROM ba GROUP BY 1", "classified")
def g_33(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.before_after(before_after(spark, d), "condition")


def _curve_sql(curve: str, w: str) -> str:
    return f"""SELECT '{curve}' AS curve, id, mem_type, mem_sub, {w} AS w FROM nearest"""


#: A third of the vectors is the validation half: every other one of it is a memory for the rest; all of it is the memory of the other vectors.
CURVE = f"""WITH v AS (SELECT vec_id, label, embedding, CASE WHEN vec_id % 3 <> 0 THEN 'test' WHEN vec_id % 2 = 1 THEN 'validation' ELSE 'memory' END AS phase FROM embeddings),
    truths AS (SELECT vec_id AS id, phase, CASE label % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS true_type, CASE WHEN label % 4 = 3 THEN NULL WHEN label % 2 = 0 THEN 'p' ELSE 'q' END AS sub, CASE WHEN label % 4 = 3 THEN 'd' ELSE concat(CASE label % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END, '__', CASE WHEN label % 2 = 0 THEN 'p' ELSE 'q' END) END AS true_leaf FROM v)"""
CURVE_ORACLE = CURVE + f""", dist AS (SELECT a.vec_id AS id, b.vec_id AS mem_id, {DIST} AS distance FROM v a JOIN v b ON a.phase = 'validation' AND b.phase = 'memory' OR a.phase = 'test' AND b.phase <> 'test'),
    nearest AS (SELECT d.id, t.true_type AS mem_type, t.sub AS mem_sub, greatest(0, least(1, distance / {CURVE_T})) AS x FROM dist d JOIN truths t ON t.id = d.mem_id WHERE distance <= {CURVE_T}),
    m AS ({_curve_sql('linear', '1 - x')} UNION ALL {_curve_sql('quadratic', '1 - x * x')} UNION ALL {_curve_sql('step', '1.0')}), tot AS (SELECT curve, id, max(w) AS wm FROM m GROUP BY ALL HAVING sum(w) > 0),
    asked AS (SELECT l.*, curve FROM leaf_probs l JOIN truths USING (id) CROSS JOIN (VALUES ('linear'), ('quadratic'), ('step')) AS c(curve) WHERE phase <> 'memory'), tp AS (SELECT id, waste_type, sum(p) AS pt FROM leaf_probs GROUP BY ALL),
    ex AS (SELECT curve, id, mem_type, mem_sub, sum(w) AS w FROM m WHERE mem_sub IS NOT NULL GROUP BY ALL), ty AS (SELECT curve, id, mem_type, sum(w) AS w FROM m WHERE mem_sub IS NULL GROUP BY ALL),
    j AS (SELECT q.*, coalesce(ex.w, 0) + coalesce(ty.w * q.p / tp.pt, 0) AS target FROM asked q JOIN tp USING (id, waste_type) LEFT JOIN ex ON ex.curve = q.curve AND ex.id = q.id AND ex.mem_type = q.waste_type AND ex.mem_sub = q.sub_type LEFT JOIN ty ON ty.curve = q.curve AND ty.id = q.id AND ty.mem_type = q.waste_type),
    su AS (SELECT curve, id, sum(target) AS ts FROM j GROUP BY ALL), b AS (SELECT j.curve, j.id, leaf, waste_type, p AS before, wm IS NOT NULL AND ts > 0 AS matched, CASE WHEN wm IS NOT NULL AND ts > 0 THEN (1 - least(0.95, wm)) * p + least(0.95, wm) * target / ts ELSE p END AS after FROM j JOIN su USING (curve, id) LEFT JOIN tot ON tot.curve = j.curve AND tot.id = j.id),
    lf AS (SELECT curve, id, bool_or(matched) AS matched, arg_min(leaf, struct_pack(m := -CAST(before AS DECIMAL(28,9)), l := leaf)) AS lb, arg_min(leaf, struct_pack(m := -CAST(after AS DECIMAL(28,9)), l := leaf)) AS la FROM b GROUP BY ALL),
    tt AS (SELECT curve, id, waste_type, sum(CAST(before AS DECIMAL(28,9))) AS sb, sum(CAST(after AS DECIMAL(28,9))) AS sa FROM b GROUP BY ALL), tf AS (SELECT curve, id, arg_min(waste_type, struct_pack(m := -sb, l := waste_type)) AS tb, arg_min(waste_type, struct_pack(m := -sa, l := waste_type)) AS ta FROM tt GROUP BY ALL),
    r AS (SELECT phase, curve, count(*) AS n, count(*) FILTER (matched) AS matched, round(avg((tb = true_type)::INT), 6) AS type_before, round(avg((ta = true_type)::INT), 6) AS type_after, count(*) FILTER (tb <> true_type AND ta = true_type) AS type_fixed, count(*) FILTER (tb = true_type AND ta <> true_type) AS type_broken,
        round(avg((lb = true_leaf)::INT), 6) AS leaf_before, round(avg((la = true_leaf)::INT), 6) AS leaf_after, count(*) FILTER (lb <> true_leaf AND la = true_leaf) AS leaf_fixed, count(*) FILTER (lb = true_leaf AND la <> true_leaf) AS leaf_broken FROM lf JOIN tf USING (curve, id) JOIN truths USING (id) GROUP BY ALL)
    SELECT *, curve = (SELECT curve FROM r WHERE phase = 'validation' ORDER BY type_fixed - type_broken + 0.5 * (leaf_fixed - leaf_broken) DESC, curve LIMIT 1) AS chosen FROM r"""


@query("g_33_curve_choice", CURVE_ORACLE, "leaf_probs")
def g_33b(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings")
    truths = spark.sql(CURVE.replace("FROM embeddings", "FROM {e}") + " SELECT id, phase, true_type, sub, true_leaf, embedding FROM truths JOIN {e} ON vec_id = id", e=v)
    vec = lambda where, name: truths.where(where).select(F.col("id").alias(name), "embedding")
    bank = lambda where: truths.where(where).select(F.col("id").alias("mem_id"), F.col("true_type").alias("mem_type"), F.col("sub").alias("mem_sub"), "embedding")
    near = lambda asks, holds: vectors.within_folded(vec(asks, "id"), bank(holds), CURVE_T, predict.CURVES, ["mem_type", "mem_sub"])
    met = cut(near("phase = 'validation'", "phase = 'memory'").unionByName(near("phase = 'test'", "phase <> 'test'")))
    asked = truths.where("phase <> 'memory'").select("id", "phase", "true_type", "true_leaf")
    return evaluate.choose_curve(cut(evaluate.folded_curves(leaves(spark, d), met, asked)))


@query("g_34_old_new", f"WITH {AFTER} SELECT truth, count(*) AS n, round(avg((truth = before)::INT), 6) AS accuracy_before, round(avg((truth = after)::INT), 6) AS accuracy_after FROM ba WHERE id NOT IN (SELECT id FROM classified WHERE regexp_matches(concat('img_', id), '^img_[0-9]*7$')) GROUP BY 1", "classified")
def g_34(spark: SparkSession, d: str) -> DataFrame:
    rows = before_after(spark, d)
    seen = rows.select(F.regexp_extract(F.concat(F.lit("img_"), F.col("id")), r"^img_([0-9]*7)$", 1).alias("stem")).where("stem <> ''").select(F.col("stem").cast("long").alias("id"))
    return evaluate.before_after(rows.join(seen, "id", "left_anti"), "truth").drop("fixed", "broken")


@query("g_34_new_types", f"WITH {AFTER}, h AS (SELECT truth, before, count(*) AS n FROM ba GROUP BY ALL) SELECT truth, count(*) AS n, round(avg((truth = after)::INT), 6) AS accuracy_after, (SELECT string_agg(concat(before, '=', h.n), ',' ORDER BY before) FROM h WHERE h.truth = ba.truth) AS called_before FROM ba WHERE truth NOT IN ('view', 'click') GROUP BY truth", "classified")
def g_34b(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.new_types(before_after(spark, d), ["view", "click"])


@query("j_12_unseen", "SELECT id FROM classified WHERE NOT regexp_matches(concat('img_', id), '^img_[0-9]*7$')", "classified")
def j_12(spark: SparkSession, d: str) -> DataFrame:
    rows = classified(spark, d).select("id")
    seen = rows.select(F.regexp_extract(F.concat(F.lit("img_"), F.col("id")), r"^img_([0-9]*7)$", 1).alias("stem")).where("stem <> ''").select(F.col("stem").cast("long").alias("id"))
    return rows.join(seen, "id", "left_anti")


@query("g_35_promotion_gate", f"WITH {AFTER}, m AS (SELECT avg((truth = before)::INT) AS ot, avg((truth = after)::INT) AS nt, avg((truth = before AND id % 2 = 0)::INT) AS ol, avg((truth = after AND id % 2 = 0)::INT) AS nl FROM ba) SELECT round(nt - ot, 6) AS type_change, round(nl - ol, 6) AS leaf_change, nt >= ot - 0.005 AND nl >= ol - 0.01 AS promote FROM m", "classified")
def g_35(spark: SparkSession, d: str) -> DataFrame:
    r = before_after(spark, d)
    of = lambda c: r.agg(F.avg((F.col("truth") == F.col(c)).cast("double")).alias("type_accuracy"), F.avg(((F.col("truth") == F.col(c)) & (F.col("id") % 2 == 0)).cast("double")).alias("leaf_accuracy"))
    return evaluate.gate(of("before"), of("after"))


@query("w_06_parity_split", "SELECT id, (row_number() OVER (PARTITION BY truth ORDER BY id) - 1) % 2 AS half FROM classified", "classified")
def w_06(spark: SparkSession, d: str) -> DataFrame:
    ranked = ordered.rank_within(classified(spark, d).select("id", "truth"), ["truth"], [F.col("id").asc()])
    return ranked.select("id", F.pmod(F.col("rank") - 1, F.lit(2)).alias("half"))
