"""SimHash near-duplicates by multi-index hashing.

Fingerprints are collapsed first, so exact copies cost one row. The 64 bits are cut into segments with
radii that fulfil the pigeonhole rule sum(radius + 1) = limit + 1: two fingerprints within ``limit`` bits
agree in at least one segment up to its radius. Every fingerprint puts its segment value in a table and
probes the small Hamming ball around it; a hit is verified over all 64 bits. A pair differs in a bit that
is 0 on one side, so only the balls whose lowest flipped bit is 0 are enumerated: half the probes, no loss.

A table bucket of many fingerprints (a large group of near copies) isn't expanded into pairs by a join:
its fingerprints are dealt into blocks, every pair of blocks is compared in numpy, and a spanning forest of
the links found is kept, which leaves the components unchanged. Nothing is capped.

Defined results: a null or empty text has fingerprint zero and links like any other; a null doc_id is
grouped too but is no component_id unless its component has no other; repeated rows stay rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.session import cut
from loopgrade.llm.common import add_columns, fields, row_keys, slices, spread_join, text_bytes, text_key
from loopgrade.operators.components import connected_components

SEED = 42
#: (width, radius) of the segments from the low bits on, for links of up to 4 bits; the second for more than MANY fingerprints,
#: which fill the tables of 22 bits: about 300 instead of 24 probes each, and 2**13 times fewer accidental matches.
SEGMENTS = ((22, 1), (22, 1), (20, 0))
WIDE_SEGMENTS = ((33, 2), (31, 1))
MANY = 100_000_000


def fingerprint(b: bytes, shingle: int = 4) -> int:
    """Majority of the bits of the XXH64 of each word shingle, as a signed 64-bit number."""
    words = b.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - shingle + 1)
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[s:e], SEED) for s, e in zip(starts, ends, strict=False)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        votes += np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, th, fp`` per row; no shuffle."""
    base = docs.select("doc_id", text_key().alias("th"), text_bytes().alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = pa.array([fingerprint(b.as_py(), shingle) for b in batch.column("b")], pa.int64())
            yield add_columns(batch, ["doc_id", "th"], {"fp": fp})

    return base.mapInArrow(run, f"{fields(base, 'doc_id', 'th')}, fp long")


def ball(width: int, radius: int) -> list[int]:
    """Masks of 1 to ``radius`` flipped bits of a segment."""
    return [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(width), r)]


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _entries(seg: Column, tag: Column, masks: list[int]) -> Column:
    """Structs (bucket, probe) of one segment: its own value, then those reached by flipping a mask whose lowest bit is 0 here."""
    own = F.array(F.struct((seg + tag).alias("bucket"), F.lit(False).alias("probe")))
    if not masks:
        return own
    flips = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: seg.bitwiseAND(m.bitwiseAND(-m)) == 0)
    return F.concat(own, F.transform(flips, lambda m: F.struct((seg.bitwiseXOR(m) + tag).alias("bucket"), F.lit(True).alias("probe"))))


def index_rows(fps: DataFrame, segments: tuple[tuple[int, int], ...] = SEGMENTS) -> DataFrame:
    """``bucket, fp, probe``: the table entry of each segment, and the probes around it."""
    parts, low = [], 0
    for k, (width, radius) in enumerate(segments):
        parts.append(_entries(_segment(F.col("fp"), low, width), F.lit(k << 40), ball(width, radius)))
        low += width
    return fps.select("fp", F.explode(F.concat(*parts)).alias("x")).select("x.bucket", "x.probe", "fp")


def _forest(table: np.ndarray, probe: np.ndarray, limit: int, inside: bool) -> list[tuple[int, int]]:
    """Edges that span the links within ``limit`` bits: ``inside`` the table, or from the table to the probes."""
    every = np.concatenate([table, probe])
    parent = np.arange(len(every))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(table)):
        start = i + 1 if inside else len(table)
        rest = np.flatnonzero(np.bitwise_count(every[start:] ^ table[i]) <= limit) + start
        for j in rest[parent[rest] != parent[i]].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                edges.append((i, j))
            parent[j] = parent[i] = a
    return [(i, j) for i, j in np.array([(every[i], every[j]) for i, j in edges], np.uint64).reshape(-1, 2).view(np.int64).tolist()]


def links(fps: DataFrame, limit: int = 4, segments: tuple[tuple[int, int], ...] | None = None, large: int = 64, block: int = 512) -> DataFrame:
    """Edges ``src, dst`` between distinct fingerprints whose components are those of all links within ``limit`` bits.

    ``segments`` are chosen by the number of fingerprints, where they aren't given. Buckets of up to ``large`` table entries are joined pair by pair; larger ones are compared by blocks.
    """
    if segments is None:
        segments = SEGMENTS if fps.count() <= MANY else WIDE_SEGMENTS
    if sum(r + 1 for _, r in segments) != limit + 1 or sum(w for w, _ in segments) != 64:
        raise ValueError("segments must cover 64 bits and their radii + 1 sum to limit + 1")
    rows = index_rows(fps, segments)
    table = rows.where("not probe").select("bucket", "fp")
    size = table.groupBy("bucket").agg(F.count("*").alias("n"))
    rows = cut(rows.join(size, "bucket"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= limit
    few = rows.where(F.col("n") <= large)
    other = few.where("not probe").select("bucket", F.col("fp").alias("other"))
    pairs = few.join(other, ["bucket"]).where(near & (F.col("probe") | (F.col("fp") < F.col("other")))).select(F.col("fp").alias("src"), F.col("other").alias("dst"))

    # kind 0: two blocks of the table (or one with itself); kind 1: a block of the table and a block of the probes
    many = rows.where(F.col("n") > large).withColumn("nb", F.ceil(F.col("n") / block))
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    entries, probes = many.where("not probe"), many.where("probe")

    def task(df: DataFrame, kind: int, i: Column, j: Column) -> DataFrame:
        return df.select("bucket", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), "fp", "probe")

    own, to = F.col("own"), F.col("other")
    tasks = task(entries, 0, F.least(own, to), F.greatest(own, to)).unionByName(task(entries, 1, own, to)).unionByName(task(probes, 1, to, own))

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        fp, probe = part["fp"].to_numpy(np.int64).view(np.uint64), part["probe"].to_numpy(bool)
        return pd.DataFrame(_forest(fp[~probe], fp[probe], limit, key[1] == 0), columns=["src", "dst"], dtype="int64")

    spans = tasks.groupBy("bucket", "kind", "i", "j").applyInPandas(compare, "src long, dst long")
    return pairs.unionByName(spans)


def components(docs: DataFrame, limit: int = 4, shingle: int = 4) -> DataFrame:
    """Per row: doc_id, th (text key), fp, comp (a fingerprint that names the component), component_id (smallest doc_id that links reach)."""
    rows = cut(fingerprints(docs, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = connected_components(links(fps.select("fp"), limit))
    linked = fps.join(comp.withColumnRenamed("node", "fp"), "fp")  # fingerprints with a link; the others name themselves
    least = cut(linked.groupBy("comp").agg(F.min("first_id").alias("component_id")))
    linked = spread_join(linked.drop("first_id"), least, ["comp"])
    named = fps.join(linked, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), F.when(F.col("comp").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "th", "fp", "comp", "component_id")


def deduplicate(docs: DataFrame, limit: int = 4, shingle: int = 4) -> DataFrame:
    """One whole row of each component stays: that with the smallest doc_id, then the smallest text key.

    A row without doc_id stays only where its component has no doc_id at all. Of rows equal in doc_id and text the one whose
    other columns hash lowest stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("th").alias("th"))).alias("x")
    stay = components(docs, limit, shingle).groupBy("comp").agg(first)
    stay = stay.select(F.xxhash64(F.col("x.no_id"), F.col("x.id")).alias("key_1"), F.col("x.th").alias("key_2"))
    key_1, key_2 = row_keys()
    keyed = docs.select(F.struct("*").alias("row"), key_1.alias("key_1"), key_2.alias("key_2"))
    hashed = F.xxhash64(*[F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind])
    best = keyed.join(stay, ["key_1", "key_2"]).groupBy("key_1", "key_2").agg(F.min_by("row", hashed).alias("row"))
    return best.select("row.*")
