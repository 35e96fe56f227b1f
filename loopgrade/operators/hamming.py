"""Pairs of bit strings within a Hamming distance, by bands and blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.session import bounded, cut

#: Strings of one band value that meet by a join; more are compared by blocks of BLOCK.
LARGE, BLOCK = 64, 1024


def _band(words: Column, low: int, high: int) -> Column:
    """Bits [low, high) of an array of 64-bit words, as one long of up to 63 bits."""
    parts, at = [], low
    while at < high:
        end = min(high, (at // 64 + 1) * 64)
        bits = F.shiftrightunsigned(F.get(words, F.lit(at // 64)), at % 64).bitwiseAND(F.lit((1 << (end - at)) - 1))
        parts.append(F.shiftleft(bits, at - low))
        at = end
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def bands(limit: int, width: int, n: int) -> list[tuple[int, int, int]]:
    """``(low, high, radius)`` of segments whose radii + 1 sum to ``limit`` + 1, so a pair within ``limit`` bits agrees in one up to its radius.

    Radius 1 while that makes a segment wide enough to tell ``n`` strings apart (10 bits more than log2 n), which costs a probe
    for every bit; otherwise narrower segments of radius 0.
    """
    need = max(1, n).bit_length() + 10
    most = max(1, width // min(need, 60))  # segments of that width
    count = limit + 1
    ones = min(count // 2, max(0, count - most))  # so many segments take a radius of 1
    count -= ones
    radii = [1] * ones + [0] * (count - ones)
    cuts = [width * k // count for k in range(count + 1)]
    return [(lo, hi, r) for lo, hi, r in zip(cuts, cuts[1:], radii, strict=False)]


def pairs(rows: DataFrame, limit: int, width: int, payload: DataFrame | None = None, accept: Callable[[dict[str, np.ndarray], int, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``a, b, bits``: pairs a < b of different ``id`` whose ``words`` (array of longs) differ in at most ``limit`` of ``width`` bits.

    ``rows`` are distinct strings, computed already. Each puts its band values in a table and probes around those of radius 1;
    band values of more than LARGE strings are dealt into blocks that meet in numpy, so no bucket is gathered or joined with
    itself. A pair is kept in its first band only.

    For groups, where only what hangs together counts, give a ``payload`` (id and more columns, packed doubles as a matrix) and ``accept``
    (of its columns, a row and further rows: which of these belong with it): every two blocks then return a forest of accepted pairs, which connects what
    their accepted pairs connect. Pairs of small buckets are few and come as they are, not yet accepted.
    """
    plan = bands(limit, width, rows.count())
    size = -(-width // 64)

    def entries(k: int, low: int, high: int, radius: int) -> Column:
        own = _band(F.col("words"), low, high)
        item = lambda v, probe: F.struct(F.lit(k).alias("band"), v.alias("value"), F.lit(probe).alias("probe"))
        # a pair that differs in one bit of the band: the side that has a 0 there probes
        flips = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(high - low)]), lambda m: own.bitwiseAND(m) == 0)
        return F.concat(F.array(item(own, False)), F.transform(flips, lambda m: item(own.bitwiseOR(m), True))) if radius else F.array(item(own, False))

    every = rows.select("id", "words", F.explode(F.concat(*[entries(k, *b) for k, b in enumerate(plan)])).alias("x")).select("id", "words", "x.band", "x.value", "x.probe")
    own_values = F.array(*[F.struct(F.lit(k).alias("band"), _band(F.col("words"), low, high).alias("value")) for k, (low, high, _) in enumerate(plan)])
    table = rows.select(F.col("id").alias("oid"), F.col("words").alias("other"), F.explode(own_values).alias("x")).select("oid", "other", "x.band", "x.value")
    large = cut(table.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > LARGE))
    hot = bounded(large)

    # small buckets: a join of probes and entries with the entries
    x, y = F.col("words"), F.col("other")
    differ = lambda p, q, low, high: F.bit_count(_band(p, low, high).bitwiseXOR(_band(q, low, high)))
    first = F.coalesce(*[F.when(differ(x, y, lo, hi) <= r, F.lit(k)) for k, (lo, hi, r) in enumerate(plan)])
    bits = sum((F.bit_count(F.get(x, F.lit(w)).bitwiseXOR(F.get(y, F.lit(w)))) for w in range(size)), F.lit(0))
    near = every.join(hot, ["band", "value"], "left_anti").join(table, ["band", "value"]).where((F.col("probe") | (F.col("id") < F.col("oid"))) & (bits <= limit) & (first == F.col("band")))
    near = near.select(F.least("id", "oid").alias("a"), F.greatest("id", "oid").alias("b"), bits.alias("bits"))

    # large buckets: blocks of the entries with one another, and with blocks of the probes
    # who asks for a large bucket follows from its value: its own strings, and those of the values with one bit less
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(max(high - low for low, high, _ in plan))])
    ask = lambda own, probe: F.struct(own.alias("own"), F.lit(probe).alias("probe"))
    less = F.transform(F.filter(masks, lambda m: F.col("value").bitwiseAND(m) != 0), lambda m: ask(F.col("value").bitwiseXOR(m), True))
    asks = F.concat(F.array(ask(F.col("value"), False)), F.filter(less, lambda _: F.col("band").isin([k for k, b in enumerate(plan) if b[2]])))
    asks = large.select(F.col("band").alias("of"), F.col("value").alias("to"), "n", F.explode(asks).alias("x")).select("of", "to", "n", "x.own", "x.probe")
    met = table.join(bounded(asks), (F.col("band") == F.col("of")) & (F.col("value") == F.col("own")))
    met = cut(met.select(F.col("oid").alias("id"), F.col("other").alias("words"), "band", F.col("to").alias("value"), "probe", "n"))
    many = met.withColumn("nb", F.ceil(F.col("n") / BLOCK))
    many = many.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    if payload is not None:
        many = many.join(payload, "id")
    more = [c for c in payload.columns if c != "id"] if payload is not None else []
    task = lambda df, kind, i, j: df.select("band", "value", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), "own", "id", "words", "probe", *more)
    own, to = F.col("own"), F.col("to")
    tables, probes = many.where("not probe"), many.where("probe")
    tasks = task(tables, 0, F.least(own, to), F.greatest(own, to)).unionByName(task(tables, 1, own, to)).unionByName(task(probes, 1, to, own))

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        band, _, kind, i, j = key
        ids, probe = part["id"].to_numpy(), part["probe"].to_numpy(bool)
        w = np.stack(part["words"].to_numpy()).astype(np.int64).view(np.uint64)
        mine = part["own"].to_numpy()
        left, right = np.flatnonzero(~probe & ((mine == i) | (kind == 1))), np.flatnonzero(probe if kind else mine == j)
        out = []
        for p in left:
            diff = w[right] ^ w[p]
            total = np.bitwise_count(diff).sum(axis=1)
            hit = (total <= limit) & ((ids[right] > ids[p]) if kind == 0 and i == j else True)
            at, diff, total = right[hit], diff[hit], total[hit]
            lead = np.full(len(at), -1)
            for k, (lo, hi, r) in reversed(list(enumerate(plan))):
                lead[_count(diff, lo, hi) <= r] = k
            at, total = at[lead == band], total[lead == band]
            out.append(pd.DataFrame({"a": np.minimum(ids[p], ids[at]), "b": np.maximum(ids[p], ids[at]), "bits": total.astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "bits": []}, dtype="int64")

    def connect(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, _, kind, i, j = key
        part = part.sort_values("id", ignore_index=True)
        ids, probe, mine = part["id"].to_numpy(), part["probe"].to_numpy(bool), part["own"].to_numpy()
        w = np.stack(part["words"].to_numpy()).astype(np.int64).view(np.uint64)
        tree, out = np.unique(ids, return_inverse=True)[1], []  # a row's tree; equal ids are one
        columns = {c: np.frombuffer(b"".join(part[c])).reshape(len(part), -1) if part[c].dtype == object else part[c].to_numpy() for c in more}

        def link(left: np.ndarray, right: np.ndarray, told: bool) -> None:
            for p in left:
                apart = right[tree[right] != tree[p]]
                bits_ = np.bitwise_count(w[apart] ^ w[p]).sum(axis=1)
                apart, bits_ = apart[bits_ <= limit], bits_[bits_ <= limit]
                if len(apart):
                    good = accept(columns, p, apart)
                    apart, bits_ = apart[good], bits_[good]
                    _, first = np.unique(tree[apart], return_index=True)  # one link to each tree
                    if told:
                        out.append(pd.DataFrame({"a": np.minimum(ids[p], ids[apart[first]]), "b": np.maximum(ids[p], ids[apart[first]]), "bits": bits_[first].astype(np.int32)}))
                    tree[np.isin(tree, tree[apart])] = tree[p]

        if kind:
            link(np.flatnonzero(~probe), np.flatnonzero(probe), True)
        else:
            one, two = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            link(one, one, bool(i == j))
            if i != j:  # what hangs together inside a block is told by the block's own task
                link(two, two, False)
                link(one, two, True)
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "bits": []}, dtype="int64")

    blocks = tasks.groupBy("band", "value", "kind", "i", "j").applyInPandas(connect if accept else compare, "a long, b long, bits int")
    return near.unionByName(blocks.distinct() if accept else blocks)


def _count(diff: np.ndarray, low: int, high: int) -> np.ndarray:
    """Set bits in [low, high) of rows of 64-bit words."""
    out = np.zeros(len(diff), np.int64)
    for w in range(low // 64, (high - 1) // 64 + 1):
        a, b = max(low - 64 * w, 0), min(high - 64 * w, 64)
        mask = np.uint64(((1 << b) - 1) ^ ((1 << a) - 1))
        out += np.bitwise_count(diff[:, w] & mask)
    return out
