"""Quality rules: base counts of each text, and cross-document line frequency per host.

Every line with a word is normalised (ASCII lower case, words joined by one space, digits as 0) and hashed,
whatever its length. It is boilerplate of a host when it stands in more than ``max_docs`` distinct documents of
that host; copies of one text count as one document, so a popular document is not mistaken for boilerplate.
Boilerplate lines are removed from all documents but the first (smallest doc_id) that holds them: near copies of one
document share their lines, too, and so of a group of them one stays whole, and no text vanishes with all its copies.
A document is depleted, and rejected, where more than ``max_removed`` of its words go, or where fewer than the
``MIN_WORDS`` that every document needs are left.

Defined results: a null text is an empty text (no words, base_failed); a null host is a host of its own;
repeated rows are judged alike; an empty table gives an empty result; other columns are ignored here and
carried through by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.session import cut
from loopgrade.llm.common import add_columns, fields, row_keys, slices, spread_join, text_bytes, text_key

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
_TAILS = bytes(range(0x80, 0xC0))


def code_points(b: bytes) -> int:
    return len(b.translate(None, _TAILS))


def normal_line(words: list[bytes]) -> bytes:
    return b" ".join(words).lower().translate(_DIGITS)


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that stand twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, place, times = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = times[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base_counts(b: bytes) -> tuple[int, int, int, int, int, list[list[bytes]]]:
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    return len(words), code_points(b"".join(words)), len(b.translate(None, _NOT_SYMBOLS)), dup, repeated_words(words), [x.split() for x in lines]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _host(host: str) -> Column:
    return F.xxhash64(F.col(host).isNull(), F.col(host).cast("string"))


def _normal(line: Column) -> Column:
    """The column form of :func:`normal_line`; XXH64 with seed 42 is Spark's ``xxhash64`` of it."""
    words = F.array_join(F.regexp_extract_all(line, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    return F.translate(words, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def line_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: the base counts, and hash and words of each line. No shuffle."""
    base = docs.select(
        F.col("doc_id"), _host(host).alias("host"), text_key().alias("th"), text_bytes().alias("b")
    )
    keep = ["doc_id", "host", "th"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for b in batch.column("b"):
                *counts, lines = base_counts(b.as_py())
                hashes = [_signed(xxhash.xxh64_intdigest(normal_line(x), 42)) for x in lines]
                for o, v in zip(out, [*counts, hashes, [len(x) for x in lines]], strict=True):
                    o.append(v)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words"]
            yield add_columns(batch, keep, {n: pa.array(o, k) for n, o, k in zip(names, out, kinds, strict=True)})

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<int>"
    return base.mapInArrow(run, f"{fields(base, *keep)}, {counts}")


def judge(docs: DataFrame, host: str = "source", max_docs: int = 10, max_removed: float = 0.5) -> DataFrame:
    """Per row of ``docs``: counts, ``base_failed``, ``removed_words``, ``removed_lines`` (hashes) and ``kept``.

    A boilerplate line stays in the first document that holds it, by doc_id (null last), then text key.
    The line table is combined to (line, text) before its first shuffle and to counts before the second, so a
    line that stands in a third of all documents reaches no task as a third of the rows; the boilerplate lines
    come back by a join that is spread over a hot line.
    """
    feats = cut(line_features(docs, host).withColumn("rid", F.monotonically_increasing_id()))
    line = F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("th").alias("text"))
    lines = feats.select("rid", "host", "th", first.alias("doc"), line).select(
        "rid", "th", "doc", F.xxhash64("host", "x.line_hashes").alias("key"), F.col("x.line_hashes").alias("h"), F.col("x.line_words").cast("long").alias("w")
    )
    texts = lines.groupBy("key", "th").agg(F.min("doc").alias("doc"))
    common = cut(texts.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("owner")).where(F.col("n") > max_docs).select("key", "owner"))
    gone = spread_join(lines, common, ["key"]).where(~F.col("doc").eqNullSafe(F.col("owner"))).groupBy("rid").agg(F.sum("w").alias("removed_words"), F.collect_set("h").alias("removed_lines"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        feats.drop("line_hashes", "line_words")
        .join(gone, "rid", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words")) & (F.col("n_words") - F.col("removed_words") >= MIN_WORDS))
        .drop("rid")
    )


def clean(docs: DataFrame, host: str = "source", **limits: float) -> DataFrame:
    """The rows that are kept, with all their columns, and their text without boilerplate lines.

    Rows meet their verdict by (doc_id, text key); ``n_chars``, where the table has it, follows the text.
    """
    verdict = judge(docs, host, **limits).where("kept")
    verdict = verdict.select(F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id")).alias("key_1"), F.col("th").alias("key_2"), F.xxhash64("host").alias("key_3"), "removed_lines")
    verdict = verdict.groupBy("key_1", "key_2", "key_3").agg(F.first("removed_lines").alias("v_lines"))
    key_1, key_2 = row_keys()
    keyed = docs.select(F.struct("*").alias("row"), key_1.alias("key_1"), key_2.alias("key_2"), F.xxhash64(_host(host)).alias("key_3"))
    joined = keyed.join(verdict, ["key_1", "key_2", "key_3"])
    lines = F.filter(F.split(F.col("row.text"), "\n"), lambda x: ~F.array_contains("v_lines", F.xxhash64(_normal(x))))
    text = F.when(F.col("v_lines").isNull(), F.col("row.text")).otherwise(F.array_join(lines, "\n"))
    same = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return joined.select("row", text.alias("clean")).select(*[same[c].alias(c) if c in same else F.col("row")[c].alias(c) for c in docs.columns])
