"""Suffix-array dedup: bytes covered by a repeated string of ``LENGTH`` bytes are removed.

The suffixes that begin a window of LENGTH bytes are sorted, so that equal windows become neighbours; a
suffix comparison finds the common extension by binary search over prefix polynomial hashes, the sort is a
bottom-up mergesort, and neighbours that claim LENGTH common bytes are verified byte by byte.

To do this over a corpus, windows that can't be equal are kept apart and most are never sorted:

1. The anchor of a window is its GRAM-byte string of lowest hash, so equal windows have equal anchors at
   equal offsets. A map emits each text's anchors (about one per 75 bytes); texts that occur several times
   (same SHA-256) are represented by one row and are removed whole.
2. Anchors of one place only are dropped (counts combined before the shuffle, then an equi-join).
3. The windows of a repeated anchor go, in up to three units, to the core of 3 * GRAM bytes that all
   windows of the unit contain. Units meet by the hash of their core; equal units are duplicates outright,
   and only cores with different units have their suffixes sorted, alignment by alignment.
4. An anchor of more than ``hot`` places (a line that a third of all documents share) isn't gathered. All
   its windows at a place are one block; equal blocks are counted by their SHA-256, which combines before
   the shuffle, and are duplicates outright. One block of each kind is cut into finer units with cores of
   LENGTH - 25 bytes, treated alike. One unit of each kind goes on: to the sort where its core has up to
   ``hot`` kinds, else its single windows are counted the same way.

Defined results: a null or empty text has no bytes; repeated rows and equal texts are copies of each other,
so all of them lose their windows; texts shorter than LENGTH lose nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.session import cut, written
from loopgrade.llm.common import add_columns, fields, row_keys, slices, text_bytes

LENGTH, GRAM = 200, 50
HOT, SMALL, CHUNK = 4000, 150_000, 2 << 20
#: Windows of a unit of a hot anchor.
FINE = 25
_UNIT = "core long, kind binary, key_1 long, key_2 long, first int, count int, offset int, body binary, times int, runs array<int>"
BASE = np.uint64(0x9E3779B97F4A7C15)
_SPAN = LENGTH - GRAM  # a window of LENGTH bytes has _SPAN + 1 grams
_BLOCK = 1 << 17
_LOW = np.uint64((1 << 18) - 1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BLOCK + 2 * LENGTH, BASE)
_INV = _powers(_BLOCK + 2 * LENGTH, np.uint64(pow(int(BASE), -1, 1 << 64)))


def prefix_hashes(x: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (x[t] + 1) * BASE**t over [i, j), modulo 2**64."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[: len(x)], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: anchor positions, their gram hashes, and the first and last window start each of them owns."""
    x = np.frombuffer(b, np.uint8)
    parts = []
    for lo in range(0, len(x) - LENGTH + 1, _BLOCK):
        starts = min(_BLOCK, len(x) - LENGTH + 1 - lo)
        part = x[lo : lo + starts + LENGTH - 1]
        s = prefix_hashes(part, _POW)
        h = _mix((s[GRAM:] - s[:-GRAM]) * _INV[: len(part) - GRAM + 1])
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= _SPAN + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = _SPAN + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:])
        at = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], starts) - 1
        parts.append((at[first] + lo, h[at[first]].view(np.int64), first + lo, last + lo))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    p, h, first, last = (np.concatenate(c) for c in zip(*parts, strict=True))
    same = np.flatnonzero(np.diff(p) == 0)  # an anchor that owns windows on both sides of a block's end
    last[same] = last[same + 1]
    keep = np.ones(len(p), bool)
    keep[same + 1] = False
    return p[keep], h[keep], first[keep], last[keep]


def split(b: bytes, p: int, first: int, last: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first window start, windows, core offset, core hash)`` of the windows ``first`` to ``last`` of the anchor at ``p``,
    in units of up to ``step`` windows whose core is LENGTH - step bytes long."""
    for j in range(_SPAN // step):
        core = p - j * step
        furthest = p - _SPAN if (j + 1) * step >= _SPAN else core - step + 1
        lo, hi = max(first, furthest), min(last, core)
        if lo <= hi:
            key = xxhash.xxh64_intdigest(b[core : core + LENGTH - step], j)
            yield lo, hi - lo + 1, core - lo, key - (1 << 64) if key >> 63 else key


def kind_of(body: bytes, offset: int) -> bytes:
    """SHA-256 of a body and its offset: bodies of one kind are equal, as no two strings of one SHA-256 are known."""
    return hashlib.sha256(offset.to_bytes(2, "big") + body).digest()


class Suffixes:
    """Comparisons of suffixes of one byte array, up to LENGTH bytes, by prefix hashes."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.powers = _powers(len(x) + 1, BASE)
        self.sums = prefix_hashes(x, self.powers)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.powers[b] == (self.sums[b + n] - self.sums[b]) * self.powers[a]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix, LENGTH at most, by binary search."""
        out = np.full(len(a), LENGTH)
        differ = np.flatnonzero(~self.same(a, b, LENGTH))
        a, b = a[differ], b[differ]
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), LENGTH - 1)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.same(a, b, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        out[differ] = lo
        return out

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; ``ties`` for equal ones."""
        n = self.extension(a, b)
        at = np.minimum(n, LENGTH - 1)
        return np.where(n == LENGTH, ties, self.x[a + at] < self.x[b + at])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Indices that sort the suffixes ``at`` within their groups (``group`` ascending), by bottom-up mergesort.

        Every suffix finds its rank in the neighbouring run by binary search; all runs of all groups at once.
        """
        order = np.arange(len(at))
        first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        size = np.diff(np.append(first, len(at)))
        start, length = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            i = np.flatnonzero(length > width)
            own = i - start[i]
            block = own // (2 * width) * (2 * width)
            right = own - block >= width
            lo = start[i] + np.minimum(np.where(right, block, block + width), length[i])
            hi = start[i] + np.minimum(np.where(right, block + width, block + 2 * width), length[i])
            base, me = lo.copy(), at[order[i]]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                ahead = self.before(at[order[mid]], me[open_], right[open_])  # equal ones of the left run stay ahead
                lo[open_] = np.where(ahead, mid + 1, lo[open_])
                hi[open_] = np.where(ahead, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            to = start[i] + block + np.where(right, own - block - width, own - block) + (lo - base)
            moved = order[i]
            order[to] = moved
            width *= 2
        return order


def repeated(bodies: list[bytes], counts: list[int], cores: list[int], group: list[int]) -> list[np.ndarray]:
    """Per unit, which of its windows stand in another unit of its group too. Units of a group (ascending) are different bodies."""
    sizes, c, k = np.array([len(b) for b in bodies]), np.array(counts), np.array(cores)
    base = np.cumsum(sizes) - sizes
    unit = np.repeat(np.arange(len(bodies)), c)
    window = np.arange(len(unit)) - np.repeat(np.cumsum(c) - c, c)
    align = np.array(group)[unit] * (LENGTH + 1) + (k[unit] - window)  # same core, same offset to it
    by = np.argsort(align, kind="stable")
    text = Suffixes(np.frombuffer(b"".join(bodies), np.uint8))
    at, align = base[unit[by]] + window[by], align[by]
    order = text.sort(at, align)
    at, where = at[order], by[order]
    near = np.flatnonzero((align[1:] == align[:-1]) & (text.extension(at[:-1], at[1:]) == LENGTH)) if len(at) > 1 else np.zeros(0, np.int64)
    whole = np.lib.stride_tricks.sliding_window_view(text.x, LENGTH)
    true = np.ones(len(near), bool)
    for i in range(0, len(near), 4096):  # collisions: claimed neighbours are compared byte by byte
        j = near[i : i + 4096]
        true[i : i + 4096] = (whole[at[j]] == whole[at[j + 1]]).all(axis=1)
    near = near[true]
    found = np.zeros(len(unit), bool)
    found[where[near]] = found[where[near + 1]] = True
    return np.split(found, np.cumsum(c)[:-1])


def _runs(flags: np.ndarray, first: int) -> list[tuple[int, int]]:
    """[start, end) in bytes of the windows flagged, neighbours and overlaps joined."""
    on = np.flatnonzero(flags)
    if not len(on):
        return []
    gap = np.flatnonzero(np.diff(on) > LENGTH)
    return list(zip((first + on[np.append(0, gap + 1)]).tolist(), (first + on[np.append(gap, len(on) - 1)] + LENGTH).tolist(), strict=True))


def _solve(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """``(key_1, key_2, start, end)`` removed by the units of whole cores: (core, key_1, key_2, first, count, offset, body)."""
    classes: dict[tuple[int, int, bytes], list[tuple]] = {}
    for r in rows:
        classes.setdefault((r[0], r[5], r[6]), []).append(r)
    several: dict[int, list[tuple[int, int, bytes]]] = {}
    for c in classes:
        several.setdefault(c[0], []).append(c)
    work = [c for n, cs in enumerate(several.values()) if len(cs) > 1 for c in cs]
    ids = {core: n for n, core in enumerate(several)}
    flags = dict(zip(work, repeated([c[2] for c in work], [len(c[2]) - LENGTH + 1 for c in work], [c[1] for c in work], [ids[c[0]] for c in work]), strict=True)) if work else {}
    for c, members in classes.items():
        found = np.ones(len(c[2]) - LENGTH + 1, bool) if len(members) > 1 else flags.get(c)
        if found is not None:
            for r in members:
                for a, b in _runs(found, r[3]):
                    yield r[1], r[2], a, b


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of units, with their SHA-256."""
    names = ("key_1", "key_2", "start", "window")
    for batch in slices(batches):
        out: list[tuple] = []
        for k1, k2, first, body in zip(*(batch.column(c).to_pylist() for c in ("key_1", "key_2", "first", "body")), strict=True):
            for s in range(len(body) - LENGTH + 1):
                out.append((k1, k2, first + s, hashlib.sha256(body[s : s + LENGTH]).digest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 3 + [pa.binary()])], names=list(names))


def _bounded(df: DataFrame, arrays: str, most: int) -> DataFrame:
    """A broadcast where ``df`` has at most so many rows and array elements together; otherwise the join shuffles."""
    n = df.agg(F.count("*") + F.coalesce(F.sum(F.size(arrays)), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= most else df


def _unit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()] + [pa.int32()] * 3 + [pa.binary(), pa.int32(), pa.list_(pa.int32())]
    names = [x.split()[0] for x in _UNIT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of hot anchors cut into finer units."""
    for batch in slices(batches):
        out: list[tuple] = []
        for k1, k2, first, count, offset, body in zip(*(batch.column(c).to_pylist() for c in ("key_1", "key_2", "first", "count", "offset", "body")), strict=True):
            for lo, n, at, core in split(body, offset, 0, count - 1, FINE):
                part = body[lo : lo + n + LENGTH - 1]
                out.append((core, kind_of(part, at), k1, k2, first + lo, n, at, part, 1, [first + lo, first + lo + len(part)]))
        yield _unit_batch(out)


def _kinds(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of each kind whose core has several kinds, with their number ``k``; and the spans of all rows whose kind stands twice."""
    rows = cut(parts.withColumn("uid", F.monotonically_increasing_id()))
    kind = ["core", "kind"]
    kinds = cut(rows.groupBy(kind).agg(F.sum("times").alias("n"), F.min("uid").alias("uid")))
    several = kinds.groupBy("core").agg(F.count("*").alias("k")).where("k > 1")
    pair = lambda i: F.struct(F.get("runs", 2 * i).cast("long").alias("start"), F.get("runs", 2 * i + 1).cast("long").alias("end"))
    runs = F.explode(F.transform(F.sequence(F.lit(0), (F.size("runs") / 2 - 1).cast("int")), pair)).alias("x")
    equal = rows.join(kinds.where("n > 1").select(kind), kind).select("key_1", "key_2", runs).select("key_1", "key_2", "x.start", "x.end")
    return rows.join(kinds.join(several, "core").select("uid", "k"), "uid"), equal


def repeats(docs: DataFrame, hot: int = HOT, small: int = SMALL) -> DataFrame:
    """``key_1, key_2, whole, spans``: per row key with repeated bytes, either all windows (copies) or the [start, end) spans."""
    key_1, key_2 = row_keys()
    base = docs.select(key_1.alias("key_1"), key_2.alias("key_2"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key_3"), text_bytes().alias("b"))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(anchors(b.as_py())[1], return_counts=True) for b in batch.column("b")]
            new = {"found": pa.array([f for f, _ in found], pa.list_(pa.int64())), "times": pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))}
            yield add_columns(batch, ["key_1", "key_2", "key_3"], new)

    rows = cut(base.mapInArrow(seed, "key_1 long, key_2 long, key_3 binary, found array<long>, times array<int>").withColumn("rid", F.monotonically_increasing_id()))
    texts = cut(rows.groupBy("key_3").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")))
    one = rows.join(texts.select("rid"), "rid", "left_semi").select("rid", "key_1", "key_2", F.explode(F.arrays_zip("found", "times")).alias("x"))
    one = one.select("rid", "key_1", "key_2", F.col("x.found").alias("anchor"), F.col("x.times").alias("times"))
    twice = one.groupBy("anchor").agg(F.sum("times").alias("places")).where("places > 1")
    shared = one.join(twice, "anchor").groupBy("rid", "key_1", "key_2").agg(F.collect_set(F.struct("anchor", (F.col("places") > hot).alias("hot"))).alias("chosen"))
    shared = cut(shared.drop("rid"))

    hold = written(base.select("key_1", "key_2", "b").join(_bounded(shared, "chosen", small), ["key_1", "key_2"]))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: list[tuple] = []
            for k1, k2, b, chosen in zip(*(batch.column(c).to_pylist() for c in ("key_1", "key_2", "b", "chosen")), strict=True):
                is_hot = {c["anchor"]: c["hot"] for c in chosen}
                own: dict[tuple, list] = {}  # equal blocks of one text are one row: how often they stand, and what they cover
                for p, h, first, last in zip(*(c.tolist() for c in anchors(b)), strict=True):
                    if is_hot.get(h):
                        body = b[first : last + LENGTH]
                        row = own.setdefault((h, kind_of(body, p - first)), [k1, k2, first, last - first + 1, p - first, body, 0, [first, first]])
                        row[6] += 1
                        if first <= row[7][-1]:
                            row[7][-1] = last + LENGTH
                        else:
                            row[7] += [first, last + LENGTH]
                    elif h in is_hot:
                        out += [(core, None, k1, k2, lo, n, at, b[lo : lo + n + LENGTH - 1], 1, None) for lo, n, at, core in split(b, p, first, last, GRAM)]
                out += [(*k, *row) for k, row in own.items()]
            yield _unit_batch(out)

    parts = hold.mapInArrow(expand, _UNIT)
    blocks, equal_blocks = _kinds(parts.where("kind is not null"))
    fine, equal_units = _kinds(blocks.mapInArrow(_refine, _UNIT))
    single = fine.where(F.col("k") > hot).mapInArrow(_windows, "key_1 long, key_2 long, start long, window binary")
    place = F.xxhash64("key_1", "key_2", "start")
    both = single.groupBy("window").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("window")
    hits = single.join(both, "window").select("key_1", "key_2", "start", (F.col("start") + LENGTH).alias("end"))
    equal = equal_blocks.unionByName(equal_units)
    gathered = parts.where("kind is null").drop("kind", "times", "runs").unionByName(fine.where(F.col("k") <= hot).select("core", "key_1", "key_2", "first", "count", "offset", "body"))
    cold = gathered.repartition("core").sortWithinPartitions("core")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("core", "key_1", "key_2", "first", "count", "offset", "body")

        def out(rows: list[tuple]) -> pa.RecordBatch:
            got = list(_solve(rows))
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate([pa.int64()] * 4)], names=["key_1", "key_2", "start", "end"])

        held: list[tuple] = []
        size, last = 0, None
        for batch in slices(batches, 4096):
            for r in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if size > CHUNK and r[0] != last:  # cores are sorted: what is held is whole
                    yield out(held)
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r[6]), r[0]
        yield out(held)

    spans = cold.mapInArrow(solve, "key_1 long, key_2 long, start long, end long")
    spans = cut(spans.unionByName(equal).unionByName(hits)).groupBy("key_1", "key_2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    copies = texts.where("copies > 1").select("key_3")
    whole = rows.select("key_1", "key_2", "key_3").join(copies, "key_3", "left_semi").select("key_1", "key_2").distinct()
    return cut(whole.withColumn("whole", F.lit(True)).join(spans, ["key_1", "key_2"], "full")).withColumn("whole", F.coalesce("whole", F.lit(False)))


def keep_mask(n: int, whole: bool, spans: list[tuple[int, int]]) -> np.ndarray:
    if whole:
        return np.full(n, n < LENGTH)
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge)[:n] == 0


def remove(docs: DataFrame, hot: int = HOT, small: int = SMALL) -> DataFrame:
    """Per row: ``doc_id, kept`` (remaining bytes), ``n_bytes, n_removed, n_spans, kept_sha256``."""
    found = repeats(docs, hot, small)
    key_1, key_2 = row_keys()
    base = docs.select("doc_id", key_1.alias("key_1"), key_2.alias("key_2"), text_bytes().alias("b"))
    both = base.join(_bounded(found, "spans", small), ["key_1", "key_2"], "left").drop("key_1", "key_2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for b, whole, spans in zip(*(batch.column(c).to_pylist() for c in ("b", "whole", "spans")), strict=True):
                left, n_spans = b, 0
                if whole or spans:
                    keep = keep_mask(len(b), bool(whole), [(s["start"], s["end"]) for s in spans or []])
                    left = np.frombuffer(b, np.uint8)[keep].tobytes()
                    n_spans = int((np.diff(np.concatenate([[False], ~keep]).astype(np.int8)) == 1).sum())
                out.append((left, len(b), len(b) - len(left), n_spans, hashlib.sha256(left).hexdigest()))
            kinds = (("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))
            yield add_columns(batch, ["doc_id"], {n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate(kinds)})

    return both.mapInArrow(run, f"{fields(base, 'doc_id')}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
