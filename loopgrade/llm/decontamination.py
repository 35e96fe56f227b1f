"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment over words.

Seeds are the word n-grams of the test items that are rare: their expected number in the corpus, from the
corpus frequencies of their words taken as independent, is below ``expected``. Rarity is judged by the
words, not by how often the n-gram itself occurs, so an item that leaked into a third of all documents
keeps its seeds. Equal items are one item until the end. A seed that more than ``most_owners`` items own (a
phrase that questions begin with) is left out for those items that keep at least ``least`` others and whose words in
such seeds are too few to reach the threshold by themselves, so that it doesn't pair every passage with every item.

Items fall into classes by length, powers of two. A map over the documents emits, for each class, the passages
that hold a seed of it: overlapping chunks three times as long as the class's longest item. Passages join the items of their
class that own the seed, and every (passage, item) pair is aligned locally. The share of the best possible score
decides, which admits edited and reordered-by-gap copies.

The map knows the seeds as a sorted array of hashes while the table of (seed, item) is within ``most_seeds``
(checked; 16 bytes each at the driver, 24 in a broadcast). A larger benchmark is looked up by a join of all document n-grams instead.

Defined results: null and empty texts and items give no pair; items of fewer than ``n`` words are matched
as one seed of all their words, for which the documents give their shorter n-grams of these lengths, too; repeated rows
of documents give one pair, repeated items one each; an empty table gives an empty result; a null doc_id or item_id is
reported as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopgrade.functions.session import cut
from loopgrade.llm.common import fields, row_keys, slices, text_bytes

N, EXPECTED, LEAST, SHARE, MOST_SEEDS, MOST_OWNERS = 4, 1.0, 4, 0.5, 2_000_000, 100
#: Cells of one row of the alignments that run together.
CELLS = 1 << 18
#: Bytes that end a word here: all ASCII but letters and digits.
_BREAK = bytes(c for c in range(128) if not chr(c).isalnum())
_SPACED = bytes.maketrans(_BREAK, b" " * len(_BREAK))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(b: bytes) -> list[bytes]:
    """ASCII-lower-cased words of letters, digits and non-ASCII characters."""
    return b.lower().translate(_SPACED).split()


def word_hashes(ws: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = []
    for w in ws:
        h = memo.get(w)
        if h is None:
            if len(memo) > 500_000:
                memo.clear()
            h = memo[w] = xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash per window of ``n`` words (of all words, where there are fewer)."""
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x = out * _ODD + h[k : len(h) - n + 1 + k]
        out = x ^ (x >> np.uint64(29))
    return out


def align_many(docs: list[np.ndarray], items: list[np.ndarray], match: float = 2.0, miss: float = -1.0, gap: float = -1.0) -> list[tuple[float, int, int]]:
    """Smith-Waterman over word hashes for many pairs at once, none of them empty.

    Per pair: the best local score as a share of a full match of the item, and the span [start, end) in the document.
    """
    count, width = len(docs), max(map(len, items))
    item, real = np.zeros((count, width), np.int64), np.zeros((count, width), bool)
    for k, x in enumerate(items):
        item[k, : len(x)], real[k, : len(x)] = x, True
    row, start = np.zeros((count, width + 1)), np.zeros((count, width + 1), np.int64)
    best, span = np.zeros(count), np.zeros((count, 2), np.int64)
    steps, cells = np.arange(width + 1) * gap, np.arange(width + 1)
    for i in range(max(map(len, docs))):
        word = np.array([d[i] if i < len(d) else 0 for d in docs])[:, None]
        here = np.array([i < len(d) for d in docs])[:, None]
        across = row[:, :-1] + np.where((item == word) & real & here, match, miss)
        down = row[:, 1:] + gap
        new = np.maximum(np.maximum(across, down), 0)
        begin = np.where(across >= down, np.where(row[:, :-1] > 0, start[:, :-1], i), start[:, 1:])
        new, begin = np.pad(new, ((0, 0), (1, 0))), np.pad(begin, ((0, 0), (1, 0)), constant_values=i)
        # a gap in the document: the best cell to the left, less the gap for every step
        lead = np.maximum.accumulate(new - steps, axis=1)
        owner = np.maximum.accumulate(np.where(new - steps >= lead, cells, 0), axis=1)
        row, start = np.maximum(lead + steps, 0), np.take_along_axis(begin, owner, 1)
        top = row.argmax(axis=1)
        score = np.take_along_axis(row, top[:, None], 1)[:, 0]
        better = score > best
        best = np.where(better, score, best)
        span[better, 0], span[better, 1] = np.take_along_axis(start, top[:, None], 1)[better, 0], i + 1
    return [(float(b) / (match * len(x)), int(s), int(e)) for b, x, (s, e) in zip(best, items, span, strict=True)]


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, hashes``: one row per item with words."""
    base = benchmark.select("item_id", text_bytes().alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in slices(batches):
            ws = [words(b.as_py()) for b in batch.column("b")]
            hs = [word_hashes(w, memo).view(np.int64).tolist() for w in ws]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(hs, pa.list_(pa.int64()))], names=["item_id", "hashes"])

    return base.mapInArrow(run, f"{fields(base, 'item_id')}, hashes array<long>").where(F.size("hashes") > 0)


def _seed_table(items: DataFrame, n: int) -> DataFrame:
    """``item_no, seed, parts``: the n-grams of every item and the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, hs in zip(batch.column("item_no").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                grams = ngram_hashes(np.array(hs, np.int64).view(np.uint64), n).view(np.int64).tolist()
                rows += [(i, s, hs[k : k + n]) for k, s in enumerate(grams)]
            kinds = (("item_no", pa.int64()), ("seed", pa.int64()), ("parts", pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[x for x, _ in kinds])

    return items.select("item_no", "hashes").mapInArrow(run, "item_no long, seed long, parts array<long>")


def _word_counts(docs: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """``word, n``: how often the words of the test items stand in the corpus (every word, where no vocabulary is given); word null: all words."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in slices(batches):
            h = np.concatenate([word_hashes(words(b.as_py()), memo) for b in batch.column("b")] or [np.zeros(0, np.uint64)]).view(np.int64)
            total = len(h)
            if sent.value is not None:
                h = h[_in_sorted(h, sent.value)]
            w, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*w.tolist(), None], pa.int64()), pa.array([*n.tolist(), total], pa.int64())], names=["word", "n"])

    return docs.select(text_bytes().alias("b")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.searchsorted(table, x).clip(max=len(table) - 1)] == x


def rare_seeds(docs: DataFrame, items: DataFrame, n: int = N, expected: float = EXPECTED, least: int = LEAST, most_seeds: int = MOST_SEEDS, most_owners: int = MOST_OWNERS, share: float = SHARE) -> DataFrame:
    """``item_no, seed`` of the rare n-grams of every item, less those of too many owners where the item has others."""
    grams = cut(_seed_table(items, n))
    parts = grams.select("item_no", "seed", F.posexplode("parts").alias("k", "word"))
    own = parts.select("word").distinct()
    known = None
    if own.limit(most_seeds + 1).count() <= most_seeds:  # so many hashes at most reach the driver: the benchmark's vocabulary, not the corpus
        known = np.sort(own.toArrow()["word"].to_numpy())
    counts = cut(_word_counts(docs, known))
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    log_share = F.log(F.coalesce("n", F.lit(0)).cast("double") + 1) - F.log(F.lit(float(total + 1)))
    chance = parts.join(counts, "word", "left").groupBy("item_no", "seed").agg((F.sum(log_share) + F.log(F.lit(float(total + 1)))).alias("chance"))
    place = F.row_number().over(Window.partitionBy("item_no").orderBy("chance", "seed"))
    rare = cut(chance.withColumn("place", place).where((F.col("chance") <= float(np.log(expected))) | (F.col("place") <= least)).select("item_no", "seed"))
    common = rare.groupBy("seed").agg(F.count("*").alias("owners")).where(F.col("owners") > most_owners)
    marked = rare.join(common, "seed", "left").join(items.select("item_no", F.size("hashes").alias("words")), "item_no")
    count = lambda c: F.count(F.when(c, 1)).over(Window.partitionBy("item_no"))  # noqa: E731 - an item's seeds: at most its words
    enough = (count(F.col("owners").isNull()) >= least) & (n * count(F.col("owners").isNotNull()) < share * F.col("words"))
    return marked.withColumn("enough", enough).where(F.col("owners").isNull() | ~F.col("enough")).select("item_no", "seed")


def passages(docs: DataFrame, seeds: tuple[np.ndarray, np.ndarray] | None, longest: dict[int, int], lengths: tuple[int, ...] = (N,)) -> DataFrame:
    """``key_1, key_2, doc_id, class, start, hashes, hits``: overlapping chunks that hold a seed, and the seeds they hold.

    ``longest`` gives the words of the longest item of each class. Its chunks are three times as long and begin every so
    many words, so an alignment that reaches half the score, which spans at most twice its item, lies whole in one. ``seeds`` are sorted, each with the bits of its classes;
    ``lengths`` are those of the seeds in words. Without ``seeds`` every chunk comes with all its n-grams, for the join to choose.
    """
    sent = docs.sparkSession.sparkContext.broadcast(seeds)
    key_1, key_2 = row_keys()
    base = docs.select(key_1.alias("key_1"), key_2.alias("key_2"), "doc_id", text_bytes().alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in slices(batches):
            rows: list[tuple[int, int, int, list[int], list[int]]] = []
            for k, b in enumerate(batch.column("b")):
                h = word_hashes(words(b.as_py()), memo)
                by_length = [ngram_hashes(h, n).view(np.int64) for n in lengths if n <= len(h)] or [np.zeros(0, np.int64)]
                every, where = np.concatenate(by_length), np.concatenate([np.arange(len(g)) for g in by_length])
                bits = np.full(len(every), -1)
                if sent.value is not None:
                    held = _in_sorted(every, sent.value[0])
                    every, where = every[held], where[held]
                    bits = sent.value[1][np.searchsorted(sent.value[0], every)]
                for c, size in longest.items() if len(every) else ():
                    mine = (bits >> c) & 1 > 0
                    grams, place = every[mine], where[mine]
                    for n in np.unique(np.concatenate([place // size - k for k in range(3)])).tolist():
                        lo, hi = n * size, (n + 3) * size
                        inside = (place >= lo) & (place < hi)
                        if n >= 0 and inside.any():
                            rows.append((k, c, lo, h[lo:hi].view(np.int64).tolist(), np.unique(grams[inside]).tolist()))
            at = pa.array([r[0] for r in rows], pa.int64())
            same = [batch.column(c).take(at) for c in ("key_1", "key_2", "doc_id")]
            own = [pa.array([r[k] for r in rows], t) for k, t in enumerate((None, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))) if k]
            yield pa.RecordBatch.from_arrays([*same, *own], names=["key_1", "key_2", "doc_id", "class", "start", "hashes", "hits"])

    return base.mapInArrow(run, f"{fields(base, 'key_1', 'key_2', 'doc_id')}, class int, start long, hashes array<long>, hits array<long>")


def leaks(
    docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE, expected: float = EXPECTED, most_seeds: int = MOST_SEEDS, most_owners: int = MOST_OWNERS
) -> DataFrame:
    """``key_1, key_2, doc_id, item_id, score, start_word, end_word``: the best alignment of every leaked (document, item) pair."""
    every = cut(_items(benchmark))
    size = F.size("hashes")
    items = every.select("hashes").distinct().withColumn("item_no", F.monotonically_increasing_id()).withColumn("class", F.ceil(F.log2(size)).cast("int"))
    items = cut(items)
    named = every.join(items.select("hashes", "item_no"), "hashes").select("item_no", "item_id")
    longest = {r["class"]: r.n for r in items.groupBy("class").agg(F.max(size).alias("n")).collect()}  # a row per power of two
    lengths = tuple(sorted(r.n for r in items.select(F.least(size, F.lit(n)).alias("n")).distinct().collect()))  # n values at most
    seeds = rare_seeds(docs, items, n, expected, most_seeds=most_seeds, most_owners=most_owners, share=share)
    seeds = cut(seeds.join(items.select("item_no", "class"), "item_no"))
    small = seeds.limit(most_seeds + 1).count() <= most_seeds
    known = None
    if small:
        got = seeds.groupBy("seed").agg(F.bit_or(F.expr("shiftleft(1L, class)")).alias("bits")).toArrow()
        order = np.argsort(got["seed"].to_numpy())
        known = (got["seed"].to_numpy()[order], got["bits"].to_numpy()[order])
    found = cut(passages(docs, known, longest, lengths).withColumn("passage", F.monotonically_increasing_id()))
    sent = F.broadcast(seeds) if small else seeds  # at most most_seeds rows of 24 bytes
    pairs = found.select("passage", "class", F.explode("hits").alias("seed")).join(sent, ["seed", "class"]).select("passage", "item_no").distinct()
    both = found.drop("hits").join(pairs, "passage").join(items.select("item_no", F.col("hashes").alias("item")), "item_no")
    both = both.select("key_1", "key_2", "doc_id", "item_no", "start", "hashes", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            doc = [np.array(x, np.int64) for x in batch.column("hashes").to_pylist()]
            item = [np.array(x, np.int64) for x in batch.column("item").to_pylist()]
            got: list[tuple[float, int, int]] = [(0.0, 0, 0)] * len(item)
            todo = sorted(range(len(item)), key=lambda i: len(item[i]))
            while todo:  # items of like length run together, within a bound of cells
                width = max(1, CELLS // len(item[todo[-1]]))
                now, todo = todo[-width:], todo[:-width]
                for i, g in zip(now, align_many([doc[i] for i in now], [item[i] for i in now]), strict=True):
                    got[i] = g
            first = batch.column("start").to_pylist()
            same = [batch.column(c) for c in ("key_1", "key_2", "doc_id", "item_no")]
            own = [pa.array([g[0] for g in got], pa.float64()), pa.array([f + g[1] for f, g in zip(first, got, strict=True)], pa.int64()), pa.array([f + g[2] for f, g in zip(first, got, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*same, *own], names=["key_1", "key_2", "doc_id", "item_no", "score", "start_word", "end_word"])

    kinds = f"{fields(both, 'key_1', 'key_2', 'doc_id', 'item_no')}, score double, start_word long, end_word long"
    scored = both.mapInArrow(run, kinds).where(F.col("score") >= share)
    best = scored.groupBy("key_1", "key_2", "item_no").agg(F.first("doc_id").alias("doc_id"), F.max(F.struct("score", (-F.col("start_word")).alias("s"), F.col("end_word").alias("e"))).alias("x"))
    best = best.join(named, "item_no")
    return best.select("key_1", "key_2", "doc_id", "item_id", F.col("x.score").alias("score"), (-F.col("x.s")).alias("start_word"), F.col("x.e").alias("end_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    dirty = leaks(docs, benchmark, **limits).select("key_1", "key_2").distinct()
    key_1, key_2 = row_keys()
    keyed = docs.select(F.struct("*").alias("row"), key_1.alias("key_1"), key_2.alias("key_2"))
    return keyed.join(dirty, ["key_1", "key_2"], "left_anti").select("row.*")
