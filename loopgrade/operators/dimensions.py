"""Static guidance per waste type, and the table of facts that joins it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.session import bounded

def facts(types: DataFrame, routes_: DataFrame, factors: DataFrame, recycler_counts: DataFrame) -> DataFrame:
    """Per type: its route (null where there is none; ``routes_``: waste_type, recyclability, handling, steps, broken_from, the first
    step, 1-based, that isn't a recovery route), CO2e of 1 kg by the mean factor, and the recyclers that accept it."""
    mean = factors.groupBy("waste_type").agg(F.round(F.avg("factor"), 6).alias("co2e_per_kg"))
    j = types.join(bounded(routes_), "waste_type", "left").join(bounded(mean), "waste_type", "left").join(recycler_counts, "waste_type", "left")
    open_steps = F.when(F.col("steps").isNotNull(), F.coalesce(F.col("broken_from") - 1, F.size("steps")))
    return j.select("waste_type", "recyclability", "handling", open_steps.alias("open_steps"), "co2e_per_kg", F.coalesce("recyclers", F.lit(0)).alias("recyclers"))


def memory_entries(answers: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per confirmed photo that has a vector: ``sha, label, embedding``. ``answers``: shas array, label."""
    return answers.select(F.explode("shas").alias("sha"), "label").join(vectors, "sha").select("sha", "label", "embedding")


def missing_vectors(answers: DataFrame, vectors: DataFrame) -> DataFrame:
    """Photos of the answers that still have to be embedded, each once."""
    return answers.select(F.explode("shas").alias("sha")).distinct().join(vectors.select("sha"), "sha", "left_anti")
