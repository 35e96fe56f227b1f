"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in an order shuffled by a seeded md5, gets a virtual finish time: the words of
its source up to and with it, divided by the source's target. A source whose target exceeds its size
passes several times, each pass behind the one before, three times at most. All passes are put in one
global order of finish time and the mix is cut where it reaches the total size.

No group is ordered as a whole in one task: prefix sums are taken in two levels, over a fixed number of
buckets of the order (a small table) and inside each bucket. The number of sources is the only thing that
reaches one task (their rank), and it doesn't grow with the documents.

Defined results: a null text has size 0 and is taken 0 times; null sources are one source, ranked last;
repeated rows are documents of their own; a total of 0 words gives targets of 0; an empty table an empty
result. Rows that tie in the whole order (same doc_id and text) are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopgrade.functions.session import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words of the whole text: word starts are non-space characters after the start or a space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source, sk, source_size, target)`` from ``(source, sk, source_size)``: shares by weight, stopping at ``most`` times a
    source's size, the excess shared anew by weight until no source is above.

    Sources fill up in the order of size per weight. Where those before a source are full, what is left over is shared by the
    weights from it on; the first source whose share of that isn't above its limit, and all after it, take their share.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    table = sizes.select("source", "sk", "source_size", w.alias("w"))
    order = Window.orderBy(F.col("source_size").cast("double") / F.col("w"), "sk")  # a row per source
    full = F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("source_size").over(Window.partitionBy()) - full
    share = rest.cast("double") / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("share", share).withColumn("k", F.row_number().over(order))
    free = F.when(F.col("share") * F.col("w") <= most * F.col("source_size"), F.struct("k", "share"))
    table = table.withColumn("first", F.min(free).over(Window.partitionBy()))
    target = F.when(F.col("k") < F.col("first.k"), (most * F.col("source_size")).cast("double")).otherwise(F.col("first.share") * F.col("w"))
    return cut(table.select("source", "sk", "source_size", target.alias("target")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", buckets: int = 4096) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, copies, taken (words the mix takes, repeats counted)."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))).cast("binary"))
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("sk")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), named, word_count().alias("size"), key.alias("key"))
    slice_of = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")
    rows = cut(rows.withColumn("bucket", slice_of).withColumn("rid", F.monotonically_increasing_id()))
    per_bucket = rows.groupBy("source", "sk", "bucket").agg(F.sum("size").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = targets(per_bucket.groupBy("source", "sk").agg(F.sum("sum").alias("source_size")), weights, most)
    starts = per_bucket.select("sk", "bucket", before.alias("start")).join(share.drop("source"), "sk")
    inside = F.sum("size").over(Window.partitionBy("sk", "bucket").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        rows.withColumn("inside", inside)
        .join(starts, ["sk", "bucket"])
        .select("rid", "doc_id", "size", "source", "sk", "source_size", "target", "key", (F.col("start") + F.col("inside")).alias("upto"))
    )
    placed = cut(placed)
    total = placed.agg(F.sum("size")).first()[0] or 0
    passes = placed.where("size > 0 and target > 0").select("rid", "size", "sk", "source_size", "target", "key", "upto", F.explode(F.array(*[F.lit(i) for i in range(most)])).alias("pass"))
    finish = (F.col("pass") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    slot = F.least(F.floor(finish * buckets), F.lit(2 * buckets))
    queue = passes.withColumn("finish", finish).withColumn("slot", slot)
    slots = queue.groupBy("slot").agg(F.sum("size").alias("sum"))
    slot_start = F.coalesce(F.sum("sum").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = cut(slots.select("slot", slot_start.alias("slot_start")).where(F.col("slot_start") < total))
    last = slots.agg(F.max("slot")).first()[0]
    queue = queue.where(F.col("slot") <= F.lit(-1 if last is None else last))  # later slots begin beyond the budget: they aren't shuffled
    order = Window.partitionBy("slot").orderBy("finish", "sk", "key", "rid").rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        queue.join(slots, "slot")
        .withColumn("global", F.col("slot_start") + F.sum("size").over(order))
        .where(F.col("global") <= total)
        .groupBy("rid")
        .agg(F.count("*").alias("copies"), F.sum("size").alias("taken"))
    )
    return placed.join(taken, "rid", "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
