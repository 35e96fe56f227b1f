"""Source divergence audit: how far the sources of a language differ in their word use.

Every language keeps the terms that stand in at least ``least`` of its documents. A group (language, source)
gives each kept term a smoothed share p in billionths, and two groups differ by the sum of
floor((p - q)^2 / (p + q)) over the kept terms. p depends on a term's count only, so terms are sums over cells:
for every group and count the ids of its terms are a bitset, the AND of two bitsets and its set bits give how
many terms have that pair of counts, and the cell is multiplied by f once. Cells with a count of zero come by
complement: a bitset's terms less those that meet any bitset of the other group. As f enters linearly, a met cell
(a, b) carries f(a, b) - f(a, 0) - f(0, b) + f(0, 0), and what is left are sums over each group's own counts.

Terms are dealt to chunks of like totals, so a word of 64 terms has few counts; a chunk keeps only the words of
a bitset that have a bit. Texts are counted where they stand and leave a task as (group, term) sums; no group's
terms and no pair's terms meet in one task. The result has a row for each ordered pair of sources of a language.

Defined results: null text, lang and source read as ''; a text without terms makes its group occur all the same;
repeated rows are documents of their own; a language without kept terms has pairs of value 0 and no term rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopgrade.functions.session import bounded, written
from loopgrade.llm.common import slices, term_bytes, text_bytes

UNIT = 1_000_000_000
#: Terms counted in a task before they are passed on, and (term, source) entries of a chunk.
HELD, CHUNK = 300_000, 100_000
#: ANDs taken at once.
STEP = 1 << 21


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: sums per task; the term b'' marks that the group occurs."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    table = term_bytes()
    names = ["lang", "source", "term", "n", "df"]

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = [b"", *n]
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                cols = [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array([c[t] for t in part], pa.int64()) for c in (n, df)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in slices(batches, 256):
            for lang, source, b in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "b")], strict=True):
                words = b.translate(table).split()
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                df.update(set(words))
            if sum(len(n) + 1 for n, _ in held.values()) > HELD:
                yield from flush(held)
                held = {}
        yield from flush(held)

    base = docs.select(text("lang"), text("source"), text_bytes().alias("b"))
    return base.mapInArrow(run, "lang string, source string, term binary, n long, df long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)) by long division in three steps, exact up to 9 * 10^15 words."""
    whole, rest, out = total + 2 * terms, count + 2, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, whole)
        rest = rest * 1000 % whole
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def met_cells(term: np.ndarray, source: np.ndarray, count: np.ndarray, p: np.ndarray, zero: np.ndarray, sources: int) -> np.ndarray:
    """``(sources, sources)`` sums over the cells that both groups count, upper triangle, of one chunk's entries.

    ``term`` are ids from 0 on; ``p`` is the share of ``count``, ``zero`` that of a count of 0 in the same group.
    """
    order = np.lexsort((count, source))
    term, source, count, p, zero = (x[order] for x in (term, source, count, p, zero))
    new = np.append(True, (np.diff(source) != 0) | (np.diff(count) != 0))
    level = np.cumsum(new) - 1  # a bitset for each (source, count)
    of, share_of, zero_of = source[new], p[new], zero[new]
    order = np.lexsort((level, term >> 6))
    word, level, bit = term[order] >> 6, level[order], np.uint64(1) << (term[order] & 63).astype(np.uint64)
    first = np.flatnonzero(np.append(True, (np.diff(word) != 0) | (np.diff(level) != 0)))
    bits, word, level = np.bitwise_or.reduceat(bit, first), word[first], level[first]  # the words of bitsets that have a bit
    total = np.zeros((sources, sources), np.int64)
    ends = np.append(np.flatnonzero(np.append(True, np.diff(word) != 0)), len(word))
    for lo, hi in zip(ends, ends[1:], strict=False):
        rows = max(1, STEP // (hi - lo))
        for at in range(lo, hi, rows):
            n = np.bitwise_count(bits[at : min(hi, at + rows), None] & bits[None, lo:hi])
            n[of[level[at : min(hi, at + rows)]][:, None] >= of[level[lo:hi]][None, :]] = 0
            i, j = np.nonzero(n)
            a, b = level[at + i], level[lo + j]
            pa_, qb, p0, q0 = share_of[a], share_of[b], zero_of[a], zero_of[b]
            np.add.at(total, (of[a], of[b]), n[i, j].astype(np.int64) * (_gap(pa_, qb) - _gap(pa_, q0) - _gap(p0, qb) + _gap(p0, q0)))
    return total


def _met(entries: DataFrame, chunk: int) -> DataFrame:
    """``lang, source, item, value`` of the met cells, in both directions, summed per chunk."""
    like = F.floor(2 * F.log2(F.col("total").cast("double")))
    e = entries.withColumn("like", like)
    size = e.groupBy(F.col("lang").alias("_l"), F.col("like").alias("_k")).agg(F.ceil(F.count("*") / chunk).alias("_n"))
    e = e.join(bounded(size), (F.col("lang") == F.col("_l")) & (F.col("like") == F.col("_k")))
    e = e.select("lang", "like", F.pmod(F.col("tid"), F.col("_n")).alias("salt"), "tid", "source", "n", "p", "p0")

    def pairs(part: pa.Table) -> pa.Table:
        names = part.column("source").combine_chunks().dictionary_encode()
        term = np.unique(part.column("tid").to_numpy(), return_inverse=True)[1]
        total = met_cells(term, names.indices.to_numpy().astype(np.int64), *[part.column(c).to_numpy() for c in ("n", "p", "p0")], len(names.dictionary))
        i, j = np.nonzero(total)
        one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        value = np.tile(total[i, j], 2)
        lang = pa.repeat(part.column("lang")[0], len(value))
        return pa.table({"lang": lang, "source": names.dictionary.take(one), "item": names.dictionary.take(two), "value": pa.array(value, pa.int64())})

    return e.groupBy("lang", "like", "salt").applyInArrow(pairs, "lang string, source string, item string, value long")


def audit(docs: DataFrame, least: int = 10, top: int = 10, chunk: int = CHUNK) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source of the language by divergence, and the ``top`` terms that a source overuses."""
    # one shuffle: all that a (lang, term) has meets there
    sums = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    per = sums.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("x"))
    kept = written(per.where((F.col("df") >= least) | (F.octet_length("term") == 0)))
    terms, marks = kept.where(F.octet_length("term") > 0), kept.where(F.octet_length("term") == 0)
    flat = terms.select("lang", "term", "total", F.explode("x").alias("x")).select("lang", "term", "total", "x.source", "x.n").where("n > 0")

    langs = terms.groupBy(F.col("lang").alias("_l")).agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    words = flat.groupBy(F.col("lang").alias("_gl"), F.col("source").alias("_gs")).agg(F.sum("n").alias("words"))
    every = marks.select("lang", F.explode("x.source").alias("source")).join(langs, F.col("lang") == F.col("_l"), "left").drop("_l")
    every = every.join(words, (F.col("lang") == F.col("_gl")) & (F.col("source") == F.col("_gs")), "left").drop("_gl", "_gs").fillna(0, ["v", "all", "words"])
    zero = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("words"), F.col("v"))).otherwise(1)
    groups = written(every.withColumn("p0", zero))  # a row per group; the result has a row per pair of them
    near = bounded(groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "words", "v", "all", "p0"))
    entries = flat.join(near, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).drop("_l", "_s")
    entries = entries.withColumn("tid", F.xxhash64("term")).withColumn("p", share(F.col("n"), F.col("words"), F.col("v")))
    entries = written(entries.withColumn("q", share(F.col("total"), F.col("all"), F.col("v"))))

    over = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    others = bounded(groups.select(F.col("lang").alias("_l"), F.col("source").alias("item"), F.col("p0").alias("q0")))
    beside = lambda df: df.join(others, (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("item")))
    none = F.when(F.col("v") > 0, F.col("v") * gap(F.col("p0"), F.col("q0"))).otherwise(0)
    base = beside(groups).select("lang", "source", "item", none.alias("value"))
    levels = entries.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("terms"))  # bits of each (group, count)
    alone = beside(levels).select("lang", "source", "item", (F.col("terms") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("value"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pair = base.unionByName(alone).unionByName(turned).unionByName(_met(entries, chunk)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    pair = ranked(pair).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pair.unionByName(ranked(over).where(F.col("rank") <= top))
