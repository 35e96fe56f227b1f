"""Thresholds from validation rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopgrade.functions.session import bounded, cut
from loopgrade.operators.ordered import quantiles, running

LEAST_ROWS = 20


def knn_thresholds(val: DataFrame, retention: float = 0.95, far_q: float = 0.995) -> DataFrame:
    """Per predicted type: quantiles of the distance, the global ones where a type has fewer than 20 rows."""
    q = 1 - (1 - retention) / 2
    every = quantiles(val, [], "knn", {"g": q, "gf": far_q}).drop("n")
    rows = val.groupBy("waste_type").agg(F.count("*").alias("n"))
    per = rows.join(quantiles(val, ["waste_type"], "knn", {"k": q, "f": far_q}).drop("n"), "waste_type", "left")
    enough = F.col("n") >= LEAST_ROWS
    return per.crossJoin(F.broadcast(every)).select("waste_type", F.when(enough, F.col("k")).otherwise(F.col("g")).alias("knn_threshold"), F.when(enough, F.col("f")).otherwise(F.col("gf")).alias("far_threshold"), "n")


def msp_floor(val: DataFrame, thresholds: DataFrame, retention: float = 0.95, cells: int = 1024) -> DataFrame:
    """One row ``msp_threshold``: the confidence at which the combined rule rejects 1 - retention of all rows.

    It is the row of one rank among those within the distance. Rows are counted per distinct confidence and per cell of
    confidences; the cells, a thousand rows, say which holds the rank, and only that cell is ordered.
    """
    j = val.join(bounded(thresholds.select("waste_type", "knn_threshold")), "waste_type")
    inside = F.col("knn") <= F.col("knn_threshold")
    c = F.col("confidence").cast("double")
    cell = F.least(F.greatest(F.floor(c * cells), F.lit(-1)), F.lit(cells))
    per = cut(j.groupBy(cell.alias("cell"), F.when(inside, c).alias("confidence"), inside.alias("inside")).agg(F.count("*").alias("n")))
    of = lambda x, name: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(name)
    found = per.where("cell is not null").groupBy("cell").agg(of(F.col("inside"), "within"), of(~F.col("inside"), "beyond"), F.sum("n").alias("rows")).collect()  # a row a cell
    sums = {r["cell"]: r.within for r in found}
    n, beyond, total = sum(sums.values()), sum(r.beyond for r in found), sum(r.rows for r in found)
    rows = per.select(F.max(F.lit(0.0)).alias("msp_threshold")).select(F.coalesce("msp_threshold", F.lit(0.0)).alias("msp_threshold"))
    target = (1 - retention) * total - beyond
    if target <= 0 or not n:
        return rows
    place, before = max(0, min(n - 1, math.floor(target))), 0
    for k in sorted(sums):
        if before + sums[k] > place:
            break
        before += sums[k]
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("confidence").rowsBetween(Window.unboundedPreceding, 0))
    pick = per.where(F.col("inside") & (F.col("cell") == k)).withColumn("upto", upto).where(F.col("upto") > place - before)
    return pick.agg(F.coalesce(F.min("confidence"), F.lit(0.0)).alias("msp_threshold"))


def min_confidence(val: DataFrame) -> DataFrame:
    return quantiles(val.where("correct"), [], "confidence", {"min_confidence": 0.05}).drop("n")


def cumulative_precision(nn: DataFrame) -> DataFrame:
    """Precision of the neighbour's label among the closest rows, along ascending (distance, id)."""
    run = running(nn, [F.col("distance").asc(), F.col("id").asc()], {"agreed": F.col("agree").cast("long")})
    return run.withColumn("precision", F.col("agreed") / F.col("rank"))


def memory_threshold(nn: DataFrame, precision: float = 0.98, least: int = 50) -> DataFrame:
    """One row: the last distance with cumulative precision and rank high enough, else the 5 % quantile."""
    ok = cumulative_precision(nn).where((F.col("precision") >= precision) & (F.col("rank") >= least)).agg(F.max_by("distance", "rank").alias("t"))
    return ok.crossJoin(F.broadcast(quantiles(nn, [], "distance", {"q": 0.05}))).select(F.coalesce("t", "q").alias("memory_threshold"))


def report(val: DataFrame, thresholds: DataFrame, msp: float, confident: float, nn: DataFrame) -> DataFrame:
    """One row on all validation rows: n, accuracy, share flagged by the combined rule, right ones kept as confident, wrong ones below
    that confidence; and of the memory: its threshold, the share of rows within it, and how often the neighbour there agrees.

    ``val``: waste_type, knn, confidence, correct. ``nn``: id, distance, agree.
    """
    j = val.join(bounded(thresholds.select("waste_type", "knn_threshold")), "waste_type")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    c = F.col("confidence")
    rows = j.agg(
        F.count("*").alias("n"), share(F.col("correct")).alias("accuracy"), share((F.col("knn") > F.col("knn_threshold")) | (c < msp)).alias("flagged"),
        share(F.when(F.col("correct"), c >= confident)).alias("kept_confident"), share(F.when(~F.col("correct"), c < confident)).alias("wrong_below"),
    )
    inside = F.col("distance") <= F.col("memory_threshold")
    memory = nn.crossJoin(F.broadcast(memory_threshold(nn))).agg(
        F.round(F.max("memory_threshold"), 6).alias("memory_threshold"), share(inside).alias("memory_coverage"), share(F.when(inside, F.col("agree"))).alias("memory_precision"),
    )
    return rows.crossJoin(F.broadcast(memory))
