"""Ranked lexical search: exact top documents of each item by norm buckets.

A document's impact of a term is the term's weight times its saturated frequency, all in 64-bit integers; an item's
score of a document is the sum of the document's impacts on the item's terms. So a score is the product of an
impact vector with a 0/1 vector, and bounded by the product of their lengths.

Impact vectors over the terms of a block of items are written in the order of their length, longest first. Buckets
of neighbours are read in that order: an item whose length times that of the bucket's longest vector doesn't
reach its k-th best score leaves the bucket out (Cauchy-Schwarz). Inside a bucket the item's heaviest terms are
read as coordinates: their exact share and the lengths of what remains on both sides bound the score again.
Documents that pass are scored exactly, in integers. The longest vectors are searched first and give each item
its first k-th best score; vectors too short for every item aren't read at all.

Items are taken in blocks of bounded number and size, so what is broadcast (terms of the items, weights, k-th
best scores) is bounded, too. Documents are counted where they stand; a task keeps ``k`` documents an item.

Defined results: a null or empty text has no terms, isn't counted and is never found; repeated rows of ``docs``
are documents of their own, with ranks of their own; rows of ``items`` that agree in id and text are one item, equal
ids with other texts are others; null ids are allowed, a null doc_id comes last among equal scores; an item without
known terms and empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loopgrade.functions.session import cut, written
from loopgrade.llm.common import add_columns, fields, slices, term_bytes, text_bytes

#: Most items, and bytes of their texts, that are searched for at a time.
ITEMS, ITEM_BYTES = 4096, 8 << 20
#: Vectors of a bucket, and the heaviest terms of an item that are its focus.
BUCKET, FOCUS = 1024, 8
#: Slack of the bounds, which are taken in doubles.
SLACK = 1 + 1e-9
_TABLE = term_bytes(digits=True)


@dataclass
class Asked:
    """A block of items over the terms of all of them, by number."""

    ids: list
    terms: list[np.ndarray]  # of each item, heaviest first once weighed
    vocabulary: dict[bytes, int]
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    docs: int = 0
    length: int = 0

    def weigh(self, df: np.ndarray, docs: int, length: int) -> None:
        self.docs, self.length = docs, length
        self.weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64) if len(df) else df
        # terms that no document holds, or that weigh nothing, are coordinates of 0 for all
        self.terms = [t[np.argsort(-self.weight[t], kind="stable")] for t in (t[(df[t] > 0) & (self.weight[t] > 0)] for t in self.terms)]


def ask(rows: list) -> Asked:
    vocabulary: dict[bytes, int] = {}
    terms = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in sorted(set(bytes(r.b).translate(_TABLE).split()))], np.int64) for r in rows]
    return Asked([r.item_id for r in rows], terms, vocabulary)


def _packed(a: np.ndarray) -> bytes:
    return a.astype(np.int32).tobytes()


def vectors(docs: DataFrame, asked: Asked) -> DataFrame:
    """``doc_id, n, terms, tfs``: all terms of a document counted, those of the items kept, packed; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(asked.vocabulary)
    base = docs.select("doc_id", text_bytes().alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in slices(batches, 256):
            n, terms, tfs = [], [], []
            for b in batch.column("b"):
                words = b.as_py().translate(_TABLE).split()
                n.append(len(words))
                hits = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                terms.append(_packed(np.array([t for t, _ in hits])))
                tfs.append(_packed(np.array([c for _, c in hits])))
            yield add_columns(batch, ["doc_id"], {"n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.binary()), "tfs": pa.array(tfs, pa.binary())})

    return base.mapInArrow(run, f"{fields(base, 'doc_id')}, n long, terms binary, tfs binary").where("n > 0")


def statistics(counted: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Document frequencies of the items' terms, the number of documents and of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            docs, length = docs + batch.num_rows, length + (pc.sum(batch.column("n")).as_py() or 0)
            df += np.bincount(np.concatenate([np.frombuffer(t.as_py(), np.int32) for t in batch.column("terms")] or [np.zeros(0, np.int32)]), minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at], pa.int64()), pa.array([docs, length, *df[at]], pa.int64())], names=["term", "c"])

    got = {r.term: r.c for r in counted.select("n", "terms").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()}  # a row a term of the items
    df = np.zeros(terms, np.int64)
    for t, c in got.items():
        if t >= 0:
            df[t] = c
    return df, got.get(-2, 0), got.get(-1, 0)


def saturated(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The integer frequency part of an impact; ``n`` is the length of the document of each ``tf``."""
    m = 10 + 90 * n * docs // length
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def by_length(counted: DataFrame, asked: Asked) -> DataFrame:
    """``doc_id, norm, terms, impacts`` in the order of the norm, longest first; equal ones are spread by doc_id."""
    sent = counted.sparkSession.sparkContext.broadcast((asked.weight, asked.docs, asked.length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, docs, length = sent.value
        for batch in batches:
            norms, impacts = [], []
            for n, terms, tfs in zip(*[batch.column(c) for c in ("n", "terms", "tfs")], strict=True):
                t, tf = np.frombuffer(terms.as_py(), np.int32), np.frombuffer(tfs.as_py(), np.int32).astype(np.int64)
                v = weight[t] * saturated(tf, np.int64(n.as_py()), docs, length)
                norms.append(float(np.sqrt((v.astype(float) ** 2).sum())))
                impacts.append(v.tobytes())
            yield add_columns(batch, ["doc_id", "terms"], {"norm": pa.array(norms, pa.float64()), "impacts": pa.array(impacts, pa.binary())})

    rows = counted.mapInArrow(run, f"{fields(counted, 'doc_id')}, terms binary, norm double, impacts binary").where("norm > 0")
    order = [F.desc("norm"), F.xxhash64("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def search_bucket(asked: Asked, least: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``item, row, score`` of the bucket's vectors that reach the item's ``least`` score; equal scores stay.

    The vectors are rows ``ptr[r]:ptr[r + 1]`` of ``term`` and ``impact``. ``seen`` counts pairs by what became of them.
    """
    rows = len(ptr) - 1
    owner = np.repeat(np.arange(rows), np.diff(ptr))
    square = np.bincount(owner, impact.astype(float) ** 2, rows)
    longest = np.sqrt(square.max(initial=0))
    order = np.argsort(term, kind="stable")
    sorted_term = term[order]
    out: list[tuple] = []
    seen = Counter() if seen is None else seen
    for i, terms in enumerate(asked.terms):
        if not len(terms) or np.sqrt(len(terms)) * longest * SLACK < least[i]:
            seen["bucket"] += rows
            continue
        focus = terms[:FOCUS]
        lo, hi = np.searchsorted(sorted_term, focus, "left"), np.searchsorted(sorted_term, focus, "right")
        at = order[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])]
        value = impact[at].astype(float)
        part, away = np.bincount(owner[at], value, rows), np.bincount(owner[at], value * value, rows)
        bound = part + np.sqrt(len(terms) - len(focus)) * np.sqrt(np.maximum(square - away, 0))
        alive = np.flatnonzero(bound * SLACK >= least[i])
        seen["coordinate"] += rows - len(alive)
        seen["scored"] += len(alive)
        if not len(alive):
            continue
        member = np.zeros(len(asked.weight), bool)
        member[terms] = True
        size = ptr[alive + 1] - ptr[alive]
        start = np.cumsum(size) - size
        flat = np.repeat(ptr[alive] - start, size) + np.arange(size.sum())
        score = np.add.reduceat(np.where(member[term[flat]], impact[flat], 0), start)
        good = score >= least[i]
        out.append((np.full(good.sum(), i), alive[good], score[good]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _best(found: pa.Table, k: int) -> pa.Table:
    """The ``k`` first of each item, by score and doc_id."""
    found = found.take(pc.sort_indices(found, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
    item = found.column("item").to_numpy()
    first = np.flatnonzero(np.append(True, np.diff(item) != 0)) if len(item) else np.zeros(0, int)
    place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return found.filter(pa.array(place < k))


def candidates(ordered: DataFrame, asked: Asked, least: np.ndarray, k: int) -> DataFrame:
    """``item, score, doc_id``: of each task's vectors, in buckets of their order, at most ``k`` an item."""
    sent = ordered.sparkSession.sparkContext.broadcast((asked, least))
    kind = dict(ordered.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = sent.value
        bar, best = start.copy(), None
        for batch in slices(batches, BUCKET):
            packed = [np.frombuffer(t.as_py(), np.int32) for t in batch.column("terms")]
            ptr = np.append(0, np.cumsum([len(p) for p in packed]))
            impact = np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in batch.column("impacts")] or [np.zeros(0, np.int64)])
            item, row, score = search_bucket(known, bar, ptr, np.concatenate(packed or [np.zeros(0, np.int32)]), impact)
            new = pa.table({"item": pa.array(item, pa.int32()), "score": pa.array(score, pa.int64()), "doc_id": batch.column("doc_id").take(pa.array(row))})
            best = _best(new if best is None else pa.concat_tables([best, new]), k)
            at, n = np.unique(best.column("item").to_numpy(), return_counts=True)
            last = best.column("score").to_numpy()[np.cumsum(n) - 1]
            bar[at[n == k]] = np.maximum(bar[at[n == k]], last[n == k])
        if best is not None:
            yield from best.to_batches()

    return ordered.select("doc_id", "terms", "impacts").mapInArrow(run, f"item int, score long, doc_id {kind}")


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, asked: Asked, k: int, heads: tuple[float, ...] = (0.99, 0.9)) -> DataFrame:
    """``item, rank, doc_id, score``. The vectors above each quantile of the norm in ``heads`` are searched before the rest."""
    counted = written(vectors(docs, asked))
    asked.weigh(*statistics(counted, len(asked.vocabulary)))
    ordered = written(by_length(counted, asked))
    cuts = ordered.approxQuantile("norm", list(heads), 0.001)
    least = np.ones(len(asked.terms), np.int64)
    best, above = None, None
    for low in [*cuts, None]:
        part = ordered if above is None else ordered.where(F.col("norm") < above)
        # vectors too short for every item are skipped by the files' statistics
        reach = min((s / np.sqrt(len(t)) for s, t in zip(least, asked.terms, strict=True) if len(t)), default=np.inf) / SLACK
        part = part.where(F.col("norm") >= (float(reach) if low is None else low))
        found = candidates(part, asked, least, k).select("item", "score", "doc_id")
        best = cut(top(found if best is None else found.unionByName(best.select("item", "score", "doc_id")), k))
        for r in best.where(F.col("rank") == k).collect():  # a row an item
            least[r.item] = r.score
        above = low
    return best


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of every item, with a score above 0."""
    spark = docs.sparkSession
    rows = cut(items.select("item_id", text_bytes().alias("b")).distinct().withColumn("size", F.octet_length("b")))
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    kind = StructType([StructField("item", IntegerType()), StructField("item_id", items.schema["item_id"].dataType)])
    out = None
    for block in range(blocks):
        asked = ask(rows.where(F.pmod(F.xxhash64("item_id", "b"), F.lit(blocks)) == block).select("item_id", "b").collect())  # ITEMS rows of ITEM_BYTES on average
        names = spark.createDataFrame(list(enumerate(asked.ids)), kind)
        part = search_block(docs, asked, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
