"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over every window of the whole document, the windows are
max-pooled in overlapping chunks (neighbours share ``width - 1`` bytes, so no window is cut), a chunk's
pooled vector gives a chunk logit, and the logits, weighted by the chunks' windows, combine into one
probability. The network is fitted on the driver on the whole texts of at most ``rows`` labelled documents (a
documented bound), pooled as in scoring; scoring is a map over the documents without a shuffle.

Defined results: null and empty texts are scored as zero bytes; repeated rows score alike; an empty table
gives an empty result; without any label outside fold 0 every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopgrade.llm.common import add_columns, fields, fold_of, labelled_sample, slices, text_bytes

ROWS, EPOCHS = 2000, 4
WIDTH, EMBED, FILTERS, CHUNK = 6, 6, 24, 1024


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    conv: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    shift: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.shift]


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(draw(256, EMBED, scale=0.5), draw(WIDTH * EMBED, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32), draw(FILTERS, scale=0.1), np.zeros(1, np.float32))


def _windows(emb: np.ndarray) -> np.ndarray:
    """(..., n, EMBED) to (..., n - WIDTH + 1, WIDTH * EMBED)."""
    n = emb.shape[-2] - WIDTH + 1
    return np.concatenate([emb[..., k : k + n, :] for k in range(WIDTH)], axis=-1)


def logit(net: Network, b: bytes) -> float:
    x = np.frombuffer(b.ljust(WIDTH, b"\0"), np.uint8)
    total, n = 0.0, len(x) - WIDTH + 1
    block = CHUNK * 32
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        acts = _windows(net.embed[x[lo : hi + WIDTH - 1]]) @ net.conv
        starts = np.arange(0, hi - lo, CHUNK)
        pooled = np.maximum(np.maximum.reduceat(acts, starts, axis=0) + net.bias, 0)
        sizes = np.diff(np.append(starts, hi - lo))
        total += float((sizes * (pooled @ net.out + net.shift[0])).sum())
    return total / n


def probability(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _chunks(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The whole text as the chunks that :func:`logit` pools: bytes (n, CHUNK + WIDTH - 1), and the windows of each."""
    x = np.frombuffer(b.ljust(WIDTH, b"\0"), np.uint8)
    windows = len(x) - WIDTH + 1
    n = -(-windows // CHUNK)
    padded = np.pad(x, (0, n * CHUNK + WIDTH - 1 - len(x)))
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[::CHUNK], np.minimum(CHUNK, windows - CHUNK * np.arange(n))


def _pooled(net: Network, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks: the pooled activations, and which bytes won, with their embeddings."""
    win = _windows(net.embed[x])
    acts = win @ net.conv
    acts[np.arange(CHUNK) >= size[:, None]] = -np.inf
    best = acts.argmax(axis=1)  # (n, FILTERS)
    at = best[:, :, None] + np.arange(WIDTH)
    return np.take_along_axis(acts, best[:, None, :], 1)[:, 0] + net.bias, np.take_along_axis(x[:, None, :], at, 2), np.take_along_axis(win, best[:, :, None], 1)


def gradients(net: Network, texts: list[bytes], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Log loss of whole texts, pooled as :func:`logit` does, and its gradients. They reach the windows that won the pooling.

    Chunks pass in blocks of 64, so that a text of any length needs the memory of one block beside its winners.
    """
    parts = [_chunks(b) for b in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for _, s in parts])
    x, size = np.concatenate([c for c, _ in parts]), np.concatenate([s for _, s in parts])
    weight = (size / np.bincount(owner, size)[owner]).astype(np.float32)
    blocks = [_pooled(net, x[k : k + 64], size[k : k + 64]) for k in range(0, len(x), 64)]
    pooled, where, top = (np.concatenate(c) for c in zip(*blocks, strict=True))
    live = np.maximum(pooled, 0)
    z = np.clip(np.bincount(owner, weight * (live @ net.out + net.shift[0])), -40, 40)
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    err = (weight * ((1 / (1 + np.exp(-z)) - y) / len(texts))[owner]).astype(np.float32)
    d_pool = err[:, None] * net.out * (pooled > 0)
    d_top = (d_pool[:, :, None] * net.conv.T[None]).reshape(len(x), FILTERS, WIDTH, EMBED)
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, where.reshape(-1), d_top.reshape(-1, EMBED))
    return loss, [d_embed, np.einsum("nf,nfk->kf", d_pool, top), d_pool.sum(0), live.T @ err, err.sum(keepdims=True)]


def fit(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss of whole texts."""
    net, rng = new_network(seed), np.random.default_rng(seed)
    m = [np.zeros_like(p) for p in net.parts()]
    v = [np.zeros_like(p) for p in net.parts()]
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            _, grads = gradients(net, [texts[k] for k in at], y[at])
            step += 1
            for p, g, a, s in zip(net.parts(), grads, m, v, strict=True):
                a += 0.1 * (g - a)
                s += 0.001 * (g * g - s)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Network | None:
    """The network of the whole texts of at most ``rows`` labelled rows."""
    got = labelled_sample(docs, labels, label, rows).select("b", "y").toArrow()
    pairs = sorted(zip(got["b"].to_pylist(), got["y"].to_pylist(), strict=True))
    return fit([b for b, _ in pairs], np.array([y for _, y in pairs])) if pairs else None


def score(docs: DataFrame, net: Network | None, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row. The network (about 10 KB) travels with the task."""
    base = docs.select("doc_id", (fold_of() == 0).alias("held_out"), text_bytes().alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = [probability(logit(net, b.as_py())) if net else 0.5 for b in batch.column("b")]
            yield add_columns(batch, ["doc_id", "held_out"], {"score": pa.array(p, pa.float64())})

    scored = base.mapInArrow(run, f"{fields(base, 'doc_id', 'held_out')}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
