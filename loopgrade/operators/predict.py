"""Post-processing of leaf probabilities: roll-up, status rules, memory blending, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.session import bounded

MAX_WEIGHT, SMALL_SIDE, MIN_CONFIDENCE, SUB_CONFIDENCE = 0.95, 160, 0.6, 0.85
OTHER = "other"


def type_probabilities(leaves: DataFrame) -> DataFrame:
    """``id, waste_type, p``: leaf probabilities summed per type; decimals, so the order of the rows doesn't matter."""
    return leaves.groupBy("id", "waste_type").agg(F.sum(F.col("p").cast("decimal(28,12)")).cast("double").alias("p"))


def roll_up(leaves: DataFrame) -> DataFrame:
    """Best type, best sub-type within it and P(sub | type) per id; ties go to the label that sorts first.

    One shuffle by id: the leaves of an id, a bounded hierarchy, are folded as an array.
    """
    e = F.struct("leaf", "waste_type", "sub_type", "p")
    row = leaves.groupBy("id").agg(F.array_sort(F.collect_list(e)).alias("leaves"))
    types = F.array_distinct(F.transform("leaves", lambda x: x["waste_type"]))
    total = lambda t: F.aggregate(F.filter("leaves", lambda x: x["waste_type"] == t), F.lit(0).cast("decimal(28,12)"), lambda s, x: (s + x["p"].cast("decimal(28,12)")).cast("decimal(28,12)")).cast("double")
    ranked = F.array_sort(F.transform(types, lambda t: F.struct((-total(t)).alias("minus"), t.alias("t"))))
    row = row.withColumn("types", ranked).withColumn("best_type", F.get("types", F.lit(0))["t"]).withColumn("type_confidence", -F.get("types", F.lit(0))["minus"])
    inside = F.array_sort(F.transform(F.filter("leaves", lambda x: x["waste_type"] == F.col("best_type")), lambda x: F.struct((-x["p"]).alias("minus"), x["leaf"].alias("leaf"), x["sub_type"].alias("s"))))
    row = row.withColumn("_in", F.get(inside, F.lit(0)))
    return row.select(
        "id", F.col("best_type").alias("waste_type"), F.col("_in.s").alias("sub_type"), "type_confidence", (-F.col("_in.minus")).alias("leaf_confidence"),
        F.coalesce(F.try_divide(-F.col("_in.minus"), "type_confidence"), F.lit(0.0)).alias("subtype_confidence"), F.transform("types", lambda x: x["t"]).alias("ranked_types"), "leaves",
    )


def top_leaves(leaves: DataFrame, k: int) -> DataFrame:
    """The ``k`` (at least 1) likeliest leaves per id, as rows with their rank."""
    e = F.struct((-F.col("p")).alias("minus"), F.col("leaf").alias("leaf"))
    top = leaves.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(e)), 1, max(1, k)).alias("x"))
    return top.select("id", F.posexplode("x").alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), "x.leaf", F.round(-F.col("x.minus"), 4).alias("p"))


def status(conf: Column, knn: Column, thr: Column, far: Column, msp: Column, familiar: Column, other_mass: Column) -> Column:
    """unknown / confirm / detected; comparisons are strict, a null distance and a familiar row skip the distance tests."""
    odd = F.coalesce(knn > thr, F.lit(False)) & ~familiar
    very = F.coalesce(knn > far, F.lit(False)) & ~familiar
    close = conf < msp
    return F.when(other_mass > conf, "unknown").when(very, "unknown").when(odd & close, "unknown").when(odd | close, "confirm").otherwise("detected")


def reasons(conf: Column, knn: Column, thr: Column, far: Column, msp: Column, familiar: Column, other_mass: Column) -> Column:
    """Why a row isn't simply detected, joined by ``; ``; null where it is."""
    odd = F.coalesce(knn > thr, F.lit(False)) & ~familiar
    very = F.coalesce(knn > far, F.lit(False)) & ~familiar
    close = conf < msp
    return (
        F.when(other_mass > conf, "other_material")
        .when(very, "very_far")
        .when(odd & close, "odd+close")
        .when(odd, "odd")
        .when(close, "close")
    )


def small_guard(df: DataFrame, guarded_type: str) -> DataFrame:
    """A small photo detected as the guarded type without memory is only to be confirmed."""
    hit = (F.col("short_side") < SMALL_SIDE) & (F.col("status") == "detected") & (F.col("waste_type") == guarded_type) & ~F.col("has_memory")
    return df.withColumn("status", F.when(hit, "confirm").otherwise(F.col("status"))).withColumn("small_image", F.col("short_side") < SMALL_SIDE)


#: The weight of a match at a share of the threshold, a column or numpy values, in the order that decides between equal curves.
CURVES = {"linear": lambda x: 1 - x, "quadratic": lambda x: 1 - x * x, "step": lambda x: 1.0 + 0 * x}


def memory_weight(distance: Column, threshold: float, curve: str = "linear") -> Column:
    return CURVES[curve](F.least(F.greatest(distance / threshold, F.lit(0.0)), F.lit(1.0)))


def blend(leaves: DataFrame, near: DataFrame, threshold: float, curve: str = "linear") -> DataFrame:
    """:func:`blend_weighted` with the weights of one curve of the distance."""
    return blend_weighted(leaves, near.withColumn("w", memory_weight(F.col("distance"), threshold, curve)))


def blend_weighted(leaves: DataFrame, w: DataFrame) -> DataFrame:
    """Leaf probabilities pulled towards confirmed labels: ``id, leaf, waste_type, sub_type, p, other_mass, familiar``.

    ``w``: id, mem_type, mem_sub (nullable), w, the weight of a match within the threshold; a row may stand for several matches by their
    sum ``w`` and their largest ``top``. A label of a type only keeps the
    row's own split over the type's leaves; ``other`` moves mass out of all leaves. A row whose matches all
    lie at the threshold has total weight 0 and counts as without match.
    """
    tot = w.groupBy("id").agg(F.sum("w").alias("w_sum"), F.max("top" if "top" in w.columns else "w").alias("w_max"), F.sum(F.when(F.col("mem_type") == OTHER, F.col("w")).otherwise(F.lit(0.0))).alias("w_other")).where("w_sum > 0")
    labels = w.where(F.col("mem_type") != OTHER).groupBy("id", "mem_type", "mem_sub").agg(F.sum("w").alias("w"))
    in_type = leaves.groupBy("id", "waste_type").agg(F.sum("p").alias("p_type"))
    known = leaves.select("id", F.col("waste_type").alias("mem_type"), F.col("sub_type").alias("mem_sub"), F.lit(True).alias("known")).where("mem_sub is not null")
    lab = labels.join(known, ["id", "mem_type", "mem_sub"], "left").withColumn("mem_sub", F.when(F.col("known"), F.col("mem_sub"))).groupBy("id", "mem_type", "mem_sub").agg(F.sum("w").alias("w"))
    exact = lab.where("mem_sub is not null").select("id", F.col("mem_type").alias("waste_type"), F.col("mem_sub").alias("sub_type"), F.col("w").alias("w_leaf"))
    typed = lab.where("mem_sub is null").select("id", F.col("mem_type").alias("waste_type"), F.col("w").alias("w_type"))
    j = leaves.join(in_type, ["id", "waste_type"]).join(exact, ["id", "waste_type", "sub_type"], "left").join(typed, ["id", "waste_type"], "left")
    target = F.coalesce("w_leaf", F.lit(0.0)) + F.coalesce(F.col("w_type") * F.coalesce(F.try_divide("p", "p_type"), F.lit(0.0)), F.lit(0.0))
    j = j.withColumn("target", target)
    mass = j.groupBy("id").agg(F.sum("target").alias("t_sum"))
    lam = F.least(F.lit(MAX_WEIGHT), F.col("w_max"))
    total = F.col("t_sum") + F.col("w_other")
    j = j.join(tot, "id", "left").join(mass, "id").withColumn("familiar", F.col("w_max").isNotNull() & (total > 0))
    p = F.when(F.col("familiar"), (1 - lam) * F.col("p") + lam * F.try_divide("target", total)).otherwise(F.col("p"))
    other = F.when(F.col("familiar"), lam * F.try_divide("w_other", total)).otherwise(F.lit(0.0))
    return j.select("id", "leaf", "waste_type", "sub_type", p.alias("p"), other.alias("other_mass"), "familiar")


def vote(leaves: DataFrame, items: DataFrame) -> DataFrame:
    """Mean leaf probability over the photos of an item: a leaf missing in a photo counts 0. ``items``: id, item."""
    n = items.groupBy("item").agg(F.count_distinct("id").alias("n_photos"))
    p = leaves.withColumn("p", F.col("p").cast("decimal(28,12)")).join(items, "id").groupBy("item", "leaf", "waste_type", "sub_type").agg(F.sum("p").alias("s"))
    return p.join(n, "item").select(F.col("item").alias("id"), "leaf", "waste_type", "sub_type", (F.col("s").cast("double") / F.col("n_photos")).alias("p"), "n_photos")


def vote_distance(knn: DataFrame, items: DataFrame) -> DataFrame:
    """Mean distance of an item's photos, null unless all have one."""
    g = items.join(knn, "id", "left").groupBy("item")
    return g.agg(F.when(F.count("*") == F.count("knn"), F.avg("knn")).alias("knn"))


def group_results(
    photos: DataFrame, leaves: DataFrame, by_type: DataFrame, knn: float, msp: float, min_confidence: float, guarded_type: str, uncalibrated: float = MIN_CONFIDENCE
) -> DataFrame:
    """One result per item whose photos show the same thing (``same_item``), else one per photo (``id`` is null for an item's).

    ``photos``: id, item, same_item, best_type (the photo's own), knn (nullable), small, other_mass, and n_similar, nearest, weight,
    labels, which are null where no confirmed photo is near. ``leaves``: leaf probabilities by id. An item's leaves are averaged
    over its photos; its distance is their mean if all have one, else it isn't tested at all; confirmed photos near any of them
    make it familiar, and all of them near and one near ``other`` alone makes it ``other``; it is small if all are. ``agreement``
    counts photos whose own best type is the item's. Photos are folded per (item, type) before their shuffle, an item's types after it.
    """
    key = F.struct("item", F.when(~F.col("same_item"), F.col("id")).alias("photo"))
    rows = photos.withColumn("grp", key)
    near = F.col("n_similar").isNotNull()
    exact = lambda c: F.col(c).cast("decimal(28,12)")
    cell = rows.groupBy("grp", "best_type").agg(
        F.count("*").alias("n"), F.count("knn").alias("n_knn"), F.sum(exact("knn")).alias("knn"), F.bool_and("small").alias("small"), F.count("n_similar").alias("n_near"), F.sum("n_similar").alias("n_similar"),
        F.min(F.when(near, F.col("nearest"))).alias("nearest"), F.max(F.when(near, F.col("weight"))).alias("weight"), F.array_distinct(F.flatten(F.collect_set(F.when(near, F.col("labels"))))).alias("labels"),
        F.bool_or(near & (F.col("labels") == F.array(F.lit(OTHER)))).alias("only_other"), F.max("other_mass").alias("other_mass"), F.bool_and("same_item").alias("same"),
    )
    merged = cell.groupBy(F.col("grp").alias("_grp")).agg(
        F.sum("n").alias("n_images"), F.sum("n_knn").alias("n_knn"), F.sum("knn").cast("double").alias("total"), F.bool_and("small").alias("small_image"), F.sum("n_near").alias("n_near"), F.sum("n_similar").alias("n_similar"),
        F.min("nearest").alias("nearest"), F.max("weight").alias("weight"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))), ",").alias("labels"),
        F.bool_or("only_other").alias("only_other"), F.max("other_mass").alias("other_mass"), F.bool_and("same").alias("same"), F.collect_list(F.struct("best_type", "n")).alias("votes"),
    )
    mean = roll_up(vote(leaves, rows.select("id", F.col("grp").alias("item"))).drop("n_photos")).drop("leaves", "ranked_types")
    j = with_thresholds(mean.join(merged, F.col("id") == F.col("_grp")), by_type, knn, None)
    familiar, calibrated = F.col("n_near") > 0, ~F.col("same") | (F.col("n_knn") == F.col("n_images"))
    distance = F.when(F.col("n_knn") == F.col("n_images"), F.col("total") / F.col("n_images"))
    other = F.when(~F.col("same"), F.col("other_mass")).when(F.col("only_other") & (F.col("n_near") == F.col("n_images")), 1.0).otherwise(0.0)
    tested = status(F.col("type_confidence"), distance, F.col("thr"), F.col("far"), F.lit(msp), familiar, other)
    j = j.withColumn("status", F.when(calibrated, tested).otherwise("detected"))
    guarded = F.col("small_image") & (F.col("status") == "detected") & (F.col("waste_type") == guarded_type) & ~familiar
    j = j.withColumn("status", F.when(guarded, "confirm").otherwise(F.col("status")))
    sure = (F.col("type_confidence") >= F.when(calibrated, min_confidence).otherwise(uncalibrated)) & (F.col("status") == "detected")
    agreement = F.aggregate(F.filter("votes", lambda v: v["best_type"] == F.col("waste_type")), F.lit(0).cast("long"), lambda a, v: a + v["n"])
    return j.select(
        "_grp.item", F.col("_grp.photo").alias("id"), "n_images", agreement.alias("agreement"), "waste_type", "sub_type", "type_confidence", "status", sure.alias("is_confident"), "small_image", distance.alias("knn"),
        "n_similar", "nearest", "weight", "labels",
    )


def outcome(readable: Column, status_: Column, best_ok: Column, correct: Column, confident: Column) -> Column:
    """Error taxonomy of an evaluated photo, first match wins."""
    return (
        F.when(~readable, "unreadable")
        .when(status_ == "unknown", "rejected_unknown")
        .when(correct & confident, "none")
        .when(correct, "correct_low_confidence")
        .when(confident, "confidently_misclassified")
        .otherwise("misclassified_uncertain")
    )


def autofill(sub: Column, confidence: Column, vocabulary: Column, least: float = SUB_CONFIDENCE) -> Column:
    """The predicted sub-type where it is in the vocabulary and sure enough, else ``unknown``."""
    return F.when(F.coalesce(F.array_contains(vocabulary, sub), F.lit(False)) & (confidence >= least), sub).otherwise("unknown")


def with_thresholds(df: DataFrame, by_type: DataFrame, knn: float, far: float | None) -> DataFrame:
    """Adds ``thr`` and ``far`` of the row's type, or the global ones."""
    t = by_type.select(F.col("waste_type").alias("_t"), F.col("knn_threshold").alias("_k"), F.col("far_threshold").alias("_f"))
    j = df.join(bounded(t), F.col("waste_type") == F.col("_t"), "left")
    return j.withColumn("thr", F.coalesce("_k", F.lit(knn))).withColumn("far", F.coalesce("_f", F.lit(far).cast("double"))).drop("_t", "_k", "_f")
