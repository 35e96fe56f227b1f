"""What the operators of this subpackage share: inputs, folds and batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the whole text; null reads as empty."""
    return F.coalesce(F.col(text).cast("string").cast("binary"), F.expr("X''"))


def text_key(text: str = "text") -> Column:
    """64-bit key of the text; with the doc_id it names a row's content."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two 64-bit keys, never null, by which a row's verdict finds the row again; rows that share them are copies."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id)), text_key(text)


def fold_of(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; a null doc_id falls in fold 0, which is never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def add_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept input columns, untouched, beside the computed ones."""
    cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    return pa.RecordBatch.from_arrays([*cols, *new.values()], names=[*keep, *new])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that one batch of long texts stays small in Python."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def term_bytes(digits: bool = False) -> bytes:
    """Table for ``bytes.translate`` that leaves terms between spaces: A-Z in lower case, a-z, bytes from 0x80 and, where wanted, 0-9; all else is a space."""
    kept = bytes(range(0x30, 0x3A)) if digits else b""
    return bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A or c in kept else 0x20 for c in range(256))


def fields(df: DataFrame, *names: str) -> str:
    """DDL of the named columns of ``df``, for the schema of a ``mapInArrow``."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", most: int = 1_000_000, salts: int = 16, width: int = 32) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``, where one key may hold a third of ``many``.

    ``few``, computed already, is broadcast while it has at most ``most`` rows of about ``width`` bytes (counted); beyond
    that the rows of ``many`` are dealt to ``salts`` copies of ``few``, so a key's rows meet in that many tasks.
    """
    if few.limit(most + 1).count() <= max(0, most * 32 // width):
        return many.join(F.broadcast(few), keys, how)
    salt = F.pmod(F.xxhash64(*many.columns), F.lit(salts))
    copies = few.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])))
    return many.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``b, y`` of at most ``rows`` different labelled texts outside fold 0: those whose text hashes lowest.

    A text with both labels counts as two.
    """
    known = labels.where(F.col(label).isNotNull() & (fold_of() != 0)).select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y")).distinct()
    marked = docs.select("doc_id", text_key().alias("k")).distinct().join(known, F.col("doc_id") == F.col("l_id"))
    return text_sample(docs, marked.select("k", "y"), rows)


def text_sample(docs: DataFrame, marked: DataFrame, rows: int) -> DataFrame:
    """``b, y``: the whole texts of the ``rows`` lowest hashed different ``(k, y)`` of ``marked`` (``k``: :func:`text_key`), each once.

    The bound is on what is chosen after all joins: keys without texts are compared, copies of a chosen text go where they
    stand, and at most ``rows`` keys are broadcast.
    """
    chosen = marked.distinct().orderBy(F.xxhash64("k"), "k", "y").limit(rows)
    texts = docs.select(text_key().alias("k"), text_bytes().alias("b")).join(F.broadcast(chosen), "k")
    return texts.groupBy("k", "y").agg(F.min("b").alias("b")).select("b", "y")
