"""The feedback log: derivation of records, latest answer per key, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.labels import known
from loopgrade.functions.session import bounded


def latest(answers: DataFrame, key: str = "item_key", seq: str = "seq") -> DataFrame:
    """The last answer of every key in ingest order; combined before the shuffle, so a hot key is no hot task."""
    whole = F.struct(*[F.col(c) for c in answers.columns])
    return answers.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col(seq)).alias("row")).select("row.*")


def since(answers: DataFrame, cutoff: str) -> DataFrame:
    """Latest answers that are not older than the reset cut-off and name a label; the cut-off is applied after latest-wins."""
    label = F.col("actual")
    return latest(answers).where((F.col("created_at") >= F.lit(cutoff).cast("timestamp_ntz")) & label.isNotNull() & (label != "unknown"))


def usability(answers: DataFrame, children: DataFrame, cutoff: str) -> DataFrame:
    """The latest answer of every set with its ``leaf`` and the first ``reason``, in order, why it can't be used for retraining; ``used`` otherwise.

    ``children``: waste_type, subs (array): the model's classes. A missing sub-type is that of a type with one, else the predicted
    one where the answer confirms the type. ``n_files`` counts the photos that still exist.
    """
    c = children.select(F.col("waste_type").alias("actual"), "subs")
    j = latest(answers).join(bounded(c), "actual", "left")
    blank = lambda x: F.nullif(x, F.lit(""))
    confirmed = F.when(F.col("is_correct") & (F.col("predicted") == F.col("actual")), blank(F.col("predicted_sub")))
    sub = F.coalesce(blank(F.col("actual_sub")), F.when(F.size("subs") == 1, F.get("subs", F.lit(0))), confirmed)
    j = j.withColumn("_sub", sub)
    reason = (
        F.when(F.col("created_at") < F.lit(cutoff).cast("timestamp_ntz"), "before_reset")
        .when(F.col("subs").isNull(), "no_class")
        .when(~F.coalesce(F.array_contains("subs", F.col("_sub")), F.lit(False)), "no_sub_type")
        .when(F.col("n_files") < 1, "no_photo")
        .otherwise("used")
    )
    return j.withColumn("reason", reason).withColumn("leaf", F.when(F.col("reason") == "used", F.concat_ws("__", "actual", "_sub"))).drop("_sub", "subs")


def summary(answers: DataFrame) -> DataFrame:
    """One row over the latest answers: n, correct, accuracy (null without answers), n_other."""
    s = latest(answers).agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct"), F.count_if(F.col("actual") == "other").alias("n_other"))
    return s.select("n", "correct", F.round(F.try_divide("correct", "n"), 6).alias("accuracy"), "n_other")


def corrections(answers: DataFrame) -> DataFrame:
    """How often each prediction was corrected to each label."""
    wrong = latest(answers).where(~F.col("is_correct") & F.col("actual").isNotNull())
    return wrong.groupBy(F.concat_ws(" -> ", "predicted", "actual").alias("correction")).agg(F.count("*").alias("n"))


def memory_stats(answers: DataFrame) -> DataFrame:
    """Per label of the latest answers: sets and photos."""
    return latest(answers).where("actual is not null").groupBy("actual").agg(F.count("*").alias("sets"), F.sum("n_photos").alias("photos"))


def derive(raw: DataFrame, children: DataFrame) -> DataFrame:
    """A record from an answer: key, actual label, correctness, and ``error`` (null: valid).

    ``raw``: shas array, predicted, predicted_sub, confidence, is_correct, answer, answer_sub.
    ``children``: waste_type, subs (array). A type with one sub-type implies it; ``subtype_correct`` is
    null where either side is unknown.
    """
    key = F.substring(F.sha2(F.array_join("shas", ""), 256), 1, 16)
    actual = F.when(F.col("is_correct") & (F.col("predicted") == "unknown"), "other").when(F.col("is_correct"), F.col("predicted")).otherwise(F.col("answer"))
    given = F.when(F.col("is_correct"), F.col("predicted_sub")).otherwise(F.col("answer_sub"))
    j = raw.withColumn("item_key", key).withColumn("actual", actual).withColumn("given", F.when(known(given), given))
    c = children.select(F.col("waste_type").alias("actual"), "subs")
    j = j.join(bounded(c), "actual", "left").withColumn("actual_sub", F.when(F.size("subs") == 1, F.get("subs", F.lit(0))).otherwise(F.col("given")))
    error = (
        F.when(F.size("shas") < 1, "no image")
        .when(F.col("actual").isNull(), "no_label")
        .when(F.col("given").isNotNull() & ~F.coalesce(F.array_contains("subs", F.col("given")), F.lit(False)), "foreign_sub_type")
    )
    same = F.col("actual") == F.col("predicted")
    sub = F.when(F.col("actual_sub").isNotNull() & known(F.col("predicted_sub")), same & (F.col("actual_sub") == F.col("predicted_sub")))
    return j.select("id", "item_key", "actual", "actual_sub", same.alias("type_correct"), sub.alias("subtype_correct"), F.round("confidence", 4).alias("confidence"), error.alias("error"))


def belongs(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records whose (waste_type, sub_type) is a pair of the hierarchy."""
    return records.join(bounded(pairs.select("waste_type", "sub_type").distinct()), ["waste_type", "sub_type"], "left_semi")
