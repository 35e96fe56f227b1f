"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed terms (ASCII-lower-cased words without outer punctuation). Its logit is
bias + sum of term weights + sum over term pairs of the dot products of their factors, so a pair such as
an insult with the mention of a group has a weight of its own. The machine is fitted on the driver on at
most ``rows`` labelled documents (a documented bound, equal texts once) and keeps the terms whose
association with the label passes a likelihood-ratio test, alone or as a pair, so two terms that are toxic only
together keep their factors and rare words of a few toxic texts aren't learnt by heart; scoring is a map over the documents without a shuffle.

Defined results: null and empty texts have no terms and score the bias; repeated rows score alike; an
empty table gives an empty result; without any label outside fold 0 every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopgrade.llm.common import add_columns, fields, fold_of, labelled_sample, slices, text_bytes

ROWS, BUCKETS, FACTORS = 10000, 1 << 20, 4
_EDGES = b".,;:!?\"'()[]{}<>|*#$%&_-"


def terms(b: bytes) -> list[int]:
    """Hashed terms of the text, each once, in ascending order."""
    return sorted({crc32(w) & (BUCKETS - 1) for x in set(b.lower().split()) if (w := x.strip(_EDGES))})


@dataclass
class Machine:
    bias: float
    place: np.ndarray  # sorted hashed terms that have weights
    linear: np.ndarray  # (n,)
    factors: np.ndarray  # (n, FACTORS)

    def logit(self, found: list[int]) -> float:
        if not found or not len(self.place):
            return self.bias
        t = np.array(found)
        i = np.searchsorted(self.place, t).clip(max=len(self.place) - 1)
        i = i[self.place[i] == t]
        v = self.factors[i]
        return self.bias + float(self.linear[i].sum()) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())


def ratio(hit: np.ndarray, n: np.ndarray, pos: float, rows: int) -> np.ndarray:
    """Likelihood ratio G against the label of what stands in ``n`` of ``rows`` documents, ``hit`` of the ``pos`` toxic ones."""
    cells = [(hit, n * pos), (n - hit, n * (rows - pos)), (pos - hit, (rows - n) * pos), (rows - n - pos + hit, (rows - n) * (rows - pos))]
    return 2 * sum(x * np.log(np.where(x > 0, x * rows / np.maximum(e, 1e-9), 1)) for x, e in cells)


def associated(docs: list[np.ndarray] | list[list[int]], y: np.ndarray, least: float = 12.0, min_docs: int = 3, least_pair: float = 30.0, block: int = 512) -> np.ndarray:
    """Terms, sorted, whose G is ``least`` or more (12: p of about 0.0005), and those of a pair whose G exceeds that of
    each of its terms by ``least_pair`` (30: p of about 4e-8, as pairs are many).

    Only pairs of terms that stand in enough documents for such a G are counted: all others can't reach it.
    """
    flat = np.concatenate([np.array(d, np.int64) for d in docs] or [np.zeros(0, np.int64)])
    seen, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
    hit = np.bincount(place, y[of], len(seen)) if len(seen) else np.zeros(0)
    rows, pos = len(y), float(y.sum())
    g = ratio(hit, n, pos, rows)
    kept = (g >= least) & (n >= min_docs)
    if not 0 < pos < rows:
        return seen[kept]
    # a pair of h toxic and c other documents has a G of at most that of h toxic ones alone or of c others alone
    reach = lambda k, p: ratio(np.minimum(k, p), np.minimum(k, p), p, rows) >= least_pair
    can = np.flatnonzero(reach(hit, pos) | reach(n - hit, rows - pos))
    slot = np.full(len(seen), -1, np.int32)
    slot[can] = np.arange(len(can))
    first = np.empty(rows, np.int32)  # toxic documents before the others
    first[np.argsort(y <= 0, kind="stable")] = np.arange(rows)
    col = slot[place]
    inside = np.flatnonzero(col >= 0)
    col, row, split = col[inside], first[of[inside]], int((y > 0).sum())
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]

    def dense(lo: int, hi: int) -> np.ndarray:
        x = np.zeros((rows, hi - lo), np.float32)
        a, b = np.searchsorted(col, [lo, hi])
        x[row[a:b], col[a:b] - lo] = 1
        return x

    for i in range(0, len(can), block):
        x = dense(i, min(i + block, len(can)))
        for j in range(i, len(can), block):
            z = x if j == i else dense(j, min(j + block, len(can)))
            h = (x[:split].T @ z[:split]).astype(float)
            both = h + x[split:].T @ z[split:]
            p, q = can[i : i + block], can[j : j + block]
            a, b = np.nonzero(ratio(h, both, pos, rows) - np.maximum(g[p][:, None], g[q][None, :]) >= least_pair)
            kept[p[a]], kept[q[b]] = True, True
    return seen[kept]


def fit(docs: list[np.ndarray] | list[list[int]], y: np.ndarray, epochs: int = 200, rate: float = 0.05, decay: float = 1e-4, positive: float = 3.0, seed: int = 7) -> Machine:
    """Adam on the log loss over all sampled documents at once; a toxic one weighs ``positive``."""
    place = associated(docs, y)
    mean = float(y.mean())
    bias = np.array([np.log((mean + 1e-3) / (1 - mean + 1e-3))])
    linear, factors = np.zeros(len(place)), np.random.default_rng(seed).normal(0, 0.01, (len(place), FACTORS))
    if not len(place):
        return Machine(float(bias[0]), place, linear, factors)
    known = [np.flatnonzero(np.isin(place, np.array(d, np.int64))) for d in docs]
    weight = np.where(y > 0, positive, 1.0) / len(y)
    of = np.repeat(np.arange(len(docs)), [len(k) for k in known])
    at = np.concatenate(known)
    total = lambda x: np.bincount(of, x, len(docs))
    params, m, v = [bias, linear, factors], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for step in range(1, epochs + 1):
        f = factors[at]
        sums = np.stack([total(f[:, k]) for k in range(FACTORS)], 1)
        z = bias[0] + total(linear[at]) + 0.5 * (sums**2 - np.stack([total(f[:, k] ** 2) for k in range(FACTORS)], 1)).sum(1)
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        e = err[of]
        cross = e[:, None] * (sums[of] - f)
        g_factors = np.stack([np.bincount(at, cross[:, k], len(place)) for k in range(FACTORS)], 1) + decay * factors
        grads = [err.sum(keepdims=True), np.bincount(at, e, len(place)) + decay * linear, g_factors]
        for k, (p, g) in enumerate(zip(params, grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(bias[0]), place, linear.copy(), factors.copy())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS) -> Machine | None:
    sample = labelled_sample(docs, labels, label, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [np.array(terms(b.as_py()), np.int32).tobytes() for b in batch.column("b")]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("y")], names=["terms", "y"])

    got = sorted({(bytes(r.terms), r.y) for r in sample.mapInArrow(run, "terms binary, y int").collect()})  # 4 bytes a term
    return fit([np.frombuffer(t, np.int32) for t, _ in got], np.array([y for _, y in got], float)) if got else None


def score(docs: DataFrame, machine: Machine | None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row. The machine (at most BUCKETS terms) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    base = docs.select("doc_id", (fold_of() == 0).alias("held_out"), text_bytes().alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = sent.value
        for batch in slices(batches):
            z = np.array([fm.logit(terms(b.as_py())) if fm else 0.0 for b in batch.column("b")])
            yield add_columns(batch, ["doc_id", "held_out"], {"score": pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())})

    scored = base.mapInArrow(run, f"{fields(base, 'doc_id', 'held_out')}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
