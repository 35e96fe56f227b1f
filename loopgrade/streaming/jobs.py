"""Structured Streaming jobs over the feedback log; each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from loopgrade.operators import feedback


def read_log(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def latest_stream(answers: DataFrame) -> DataFrame:
    """Streaming twin of :func:`feedback.latest`; run in ``update`` or ``complete`` mode."""
    whole = F.struct(*[F.col(c) for c in answers.columns])
    return answers.groupBy(F.col("item_key").alias("_key")).agg(F.max_by(whole, F.col("seq")).alias("row")).select("row.*")


def _numbers(spark: SparkSession, store: str, kind: str) -> list[int]:
    """Numbers of the finished folders ``<kind>=<number>`` in ``store``, ascending, from names alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[len(kind) + 1 :]) for n in done if n.startswith(f"{kind}="))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_generation(rows: DataFrame, store: str, n: int) -> None:
    """``rows`` as generation ``n``. The one before, and the batches after it, stay for a replay of this batch; older ones go."""
    rows.write.mode("overwrite").parquet(f"{store}/gen={n}")
    spark = rows.sparkSession
    before = max((g for g in _numbers(spark, store, "gen") if g < n), default=-1)
    for kind in ("gen", "new"):
        for old in _numbers(spark, store, kind):
            if old < before or (kind == "new" and old == before):
                _remove(spark, f"{store}/{kind}={old}")


def read_last(spark: SparkSession, store: str) -> DataFrame:
    """The last generation, by its path."""
    return spark.read.parquet(f"{store}/gen={_numbers(spark, store, 'gen')[-1]}")


def _folders(spark: SparkSession, store: str, before: int | None = None) -> list[str]:
    """The last generation, if any, and the batches after it; only those of numbers below ``before``, if given."""
    gens, news = ([n for n in _numbers(spark, store, kind) if before is None or n < before] for kind in ("gen", "new"))
    return [f"{store}/gen={n}" for n in gens[-1:]] + [f"{store}/new={n}" for n in news if not gens or n > gens[-1]]


def read_latest(spark: SparkSession, store: str) -> DataFrame:
    """The table of latest answers that :func:`upsert_latest` keeps."""
    return feedback.latest(spark.read.parquet(*_folders(spark, store)))


def _merge(batch: DataFrame, batch_id: int, store: str, every: int, fold: Callable[[DataFrame], DataFrame] = feedback.latest) -> None:
    spark, rows = batch.sparkSession, fold(batch)
    old = _folders(spark, store, batch_id)
    if 0 < len(old) < every:
        rows.write.mode("overwrite").parquet(f"{store}/new={batch_id}")
        return
    if old:
        rows = fold(spark.read.schema(batch.schema).parquet(*old).unionByName(rows))
    write_generation(rows, store, batch_id)


def upsert_latest(answers: DataFrame, store: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Keep a table of latest answers in ``store``; :func:`read_latest` reads it.

    A micro-batch writes only its own latest answers, and every ``every``-th one merges what came since the last generation
    into the next, so the whole table is rewritten once in ``every`` batches. A batch that is replayed after a failure finds
    the same folders before it and writes the same one again. Two generations are kept.
    """
    return answers.writeStream.foreachBatch(lambda batch, n: _merge(batch, n, store, every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What an answer adds to the summary, and takes away when a later one supersedes it.
CHANGE = "n long, correct long, n_other long"


def retractions(answers: DataFrame) -> DataFrame:
    """Changes of the summary: plus one row for every answer that becomes its key's latest, minus one for the answer it supersedes.

    The latest answer of every key is keyed state, so nothing is read but the micro-batch. Before the rows meet their key
    each Arrow batch is cut to a row a key, so a key that sends a third of all answers sends few rows to its task.
    """
    rows = answers.select("item_key", "seq", "is_correct", "actual")
    kinds = dict(rows.dtypes)
    state = f"seq {kinds['seq']}, correct long, other long"

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values("seq").drop_duplicates("item_key", keep="last").assign(correct=lambda x: (x["is_correct"] == True).astype(int), other=lambda x: (x["actual"] == "other").astype(int))[["item_key", "seq", "correct", "other"]]  # noqa: E712

    def step(key: tuple, batches: Iterator[pd.DataFrame], now: GroupState) -> Iterator[pd.DataFrame]:
        old = now.getOption
        new = old
        for b in batches:
            for seq, correct, other in zip(b["seq"], b["correct"], b["other"], strict=True):
                if new is None or seq >= new[0]:
                    new = (int(seq), int(correct), int(other))
        if new != old:
            now.update(new)
            total = [new, *([old] if old else [])]
            yield pd.DataFrame({"n": [1 if old is None else 0], "correct": [total[0][1] - sum(t[1] for t in total[1:])], "n_other": [total[0][2] - sum(t[2] for t in total[1:])]})

    one = rows.mapInPandas(last, f"item_key {kinds['item_key']}, {state}")
    return one.groupBy("item_key").applyInPandasWithState(step, CHANGE, state, "update", "NoTimeout")


def _added(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "correct", "n_other")])


def summary_stream(answers: DataFrame, store: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """A running summary that forgets superseded answers: a micro-batch adds the sum of its :func:`retractions`, one row, to ``store``; :func:`read_summary` reads it."""
    put = lambda batch, n: _merge(batch, n, store, every, _added)
    return retractions(answers).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_summary(spark: SparkSession, store: str) -> DataFrame:
    total = _added(spark.read.parquet(*_folders(spark, store)))
    return total.select("n", "correct", F.round(F.try_divide("correct", "n"), 6).alias("accuracy"), "n_other")


def trend_stream(answers: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The trend's changed windows of every micro-batch, in ``target/batch=<id>``; the watermark drops the state of windows that are past."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return trend(answers).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_trend(spark: SparkSession, target: str) -> DataFrame:
    """Every window as its last batch left it."""
    rows = spark.read.parquet(target)
    whole = F.struct(*[c for c in rows.columns if c != "batch"])
    return rows.groupBy(F.col("start").alias("_s")).agg(F.max_by(whole, "batch").alias("row")).select("row.*")


def new_photos(photos: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Each sha once within the watermark's horizon; photos stored earlier are left to the store's anti-join."""
    return photos.withWatermark("created_at", horizon).dropDuplicatesWithinWatermark(["sha"])


def deliver(rows: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write micro-batches to ``target/batch=<id>``: a retried batch replaces itself, so nothing is lost or doubled."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    w = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def restore(spark: SparkSession, log: str, backup: str, schema: str) -> DataFrame:
    """The log, or its backup where the log has no rows yet; called once before a stream starts."""
    try:
        rows = spark.read.schema(schema).parquet(log)
        if rows.limit(1).count():
            return rows
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.read.schema(schema).parquet(backup)


def with_memory(predictions: DataFrame, memory: Callable[[SparkSession], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Predictions adjusted by the memory as it stands when their micro-batch runs.

    ``memory`` reads a table that is published by version (:func:`write_generation`, :func:`read_last`), so a new version takes
    effect with the next micro-batch and none is recomputed there.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        apply(batch, memory(batch.sparkSession)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return predictions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trend(answers: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Accuracy per event-time window; the same code runs on a batch."""
    rows = answers.withWatermark("created_at", late) if answers.isStreaming else answers
    w: Column = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    g = rows.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct"))
    return g.select(F.col("w.start").alias("start"), "n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"))


def sessions(answers: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Answers per user session; a session ends after ``gap`` without an answer."""
    rows = answers.withWatermark("created_at", late) if answers.isStreaming else answers
    g = rows.groupBy(F.session_window("created_at", gap).alias("w"), "item_key").agg(F.count("*").alias("n"))
    return g.select("item_key", F.col("w.start").alias("start"), "n")
