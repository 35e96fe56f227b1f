"""Global order statistics without one global partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopgrade.functions.session import bounded, cut


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with inclusive running sums in the global ``order``, and ``rank`` (1-based).

    Rows are range-partitioned on the order; each partition's totals are added up (a row per partition),
    and the sums run inside the partitions. ``order`` must be a total order for a stated result.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).withColumns({f"_v_{k}": c for k, c in sums.items()} | {"_v_rank": F.lit(1).cast("long")}))
    names = [*sums, "rank"]
    totals = ranged.groupBy("_pid").agg(*[F.sum(f"_v_{k}").alias(k) for k in names])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_o_{k}") for k in names])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = ranged.join(offsets, "_pid").withColumns({k: F.col(f"_o_{k}") + F.sum(f"_v_{k}").over(inside) for k in names})
    return j.drop("_pid", *[f"_v_{k}" for k in names], *[f"_o_{k}" for k in names])


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row ``auroc``: chance that a positive outscores a negative, ties half; null without both kinds.

    Counts per distinct score come first, so the ordered part has a row per score.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    run = running(per, [F.col("s").asc()], {"below": F.col("n")})
    won = F.col("p").cast("decimal(30,1)") * (F.col("below") - F.col("n")) + F.col("p").cast("decimal(30,1)") * F.col("n") * F.lit("0.5").cast("decimal(2,1)")
    t = run.agg(F.sum(won).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(F.round(F.try_divide(F.col("w").cast("double"), F.col("p").cast("double") * F.col("n")), 6).alias("auroc"))


def rank_within(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``rank`` (1-based) within its group, by one global order: no group is sorted in one task."""
    run = running(df, [*[F.col(b).asc_nulls_first() for b in by], *order], {})
    start = run.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg((F.min("rank") - 1).alias("_start"))
    same = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by]
    return run.join(bounded(start), same).withColumn("rank", F.col("rank") - F.col("_start")).drop("_start", *[f"_g_{b}" for b in by])


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], times: str | None = None) -> DataFrame:
    """Exact interpolated quantiles per group, and ``n``, the group's values (nulls left out): columns ``by``, ``n`` and the names of ``qs``.
    A row stands for ``times`` equal ones, where that column is named.

    Values are counted first, combined before the shuffle, and placed by prefix sums over the global order, so neither a group's
    rows nor its different values meet in one task.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*[F.col(b).alias(f"_g_{b}") for b in by], F.col(value).cast("double").alias("_x")).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    keys = [f"_g_{b}" for b in by]
    run = running(per, [*[F.col(k).asc_nulls_first() for k in keys], F.col("_x").asc()], {"_upto": F.col("_n")}).drop("rank")
    ends = run.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_total"))
    ends = ends.select(*[F.col(k).alias(f"_e{k}") for k in keys], "_start", "_total")
    same = [F.col(k).eqNullSafe(F.col(f"_e{k}")) for k in keys]
    j = run.join(bounded(ends), same) if keys else run.crossJoin(F.broadcast(ends))
    last = F.col("_upto") - F.col("_start") - 1  # 0-based places of a value: first to last
    first = last - F.col("_n") + 1
    place = {name: F.lit(q) * (F.col("_total") - 1) for name, q in qs.items()}
    at = lambda p: F.max(F.when((first <= p) & (last >= p), F.col("_x")))
    ends_of = [a for name, p in place.items() for a in (at(F.floor(p)).alias(f"_lo_{name}"), at(F.ceil(p)).alias(f"_hi_{name}"))]
    g = j.groupBy(*keys).agg(F.max("_total").alias("n"), *ends_of)
    value_of = lambda name, q: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)))
    return g.select(*[F.col(f"_g_{b}").alias(b) for b in by], "n", *[value_of(name, q).alias(name) for name, q in qs.items()])
