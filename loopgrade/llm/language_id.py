"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the bag of the byte n-grams (2 to 4) of its words, each word between spaces, hashed into ``BUCKETS``
rows of an embedding table. The mean row of the whole text passes a linear softmax. Both are trained on the driver
by stochastic gradient descent in numpy, on the whole texts of at most ``rows`` labelled documents (a documented
bound), cut into pieces of a few to some hundred words, so that short texts are learned, too.

Rejection is calibrated on a fifth of the sampled texts, which the descent doesn't see: a temperature makes the
scores probabilities, and the threshold is the lowest score from which on at least ``precision`` of the pieces are
right. ``accepted`` is false below it; the predicted language stands all the same.

Defined results: a null text and a text without a letter (Unicode category L) are ``und`` with score 0; rows
without a doc_id are held out; repeated rows score alike; an empty table gives an empty result; without a labelled
document every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopgrade.llm.common import add_columns, fields, fold_of, slices, term_bytes, text_bytes, text_key, text_sample

ROWS, EPOCHS = 2000, 3
BUCKETS, WIDTH, GRAMS = 1 << 14, 16, (2, 3, 4)
#: Words of the pieces that a text is cut into for training, in turn.
PIECES = (3, 8, 20, 50, 120)
#: Bytes of a text whose n-grams are counted at once.
BLOCK = 1 << 16
UNKNOWN = "und"
_TABLE = term_bytes()
_MULTIPLIER = np.uint32(2654435761)


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # (BUCKETS, WIDTH)
    out: np.ndarray  # (WIDTH, languages)
    bias: np.ndarray  # (languages,)
    temperature: float = 1.0
    threshold: float = 0.0


def subwords(words: list[bytes]) -> Iterator[np.ndarray]:
    """Buckets of the n-grams inside " word ", for all words, in blocks."""
    text = b" " + b" ".join(words) + b" "
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK + max(GRAMS) - 1]
        out = []
        for n in GRAMS:
            count = min(BLOCK, len(part) - n + 1)
            if count > 0:
                code, inner = np.full(count, n, np.uint32), np.ones(count, bool)
                for k in range(n):
                    c = part[k : k + count]
                    code = (code ^ c) * _MULTIPLIER
                    code ^= code >> np.uint32(15)
                    if 0 < k < n - 1:
                        inner &= c != 32
                out.append((code >> np.uint32(18))[inner])
        yield np.concatenate(out)


def bag(words: list[bytes]) -> np.ndarray:
    return sum((np.bincount(b, minlength=BUCKETS) for b in subwords(words)), np.zeros(BUCKETS, np.int64))


def logits(model: Model, b: bytes) -> np.ndarray:
    """Of a text with a letter."""
    n = bag(b.translate(_TABLE).split())
    mean = n.astype(np.float32) @ model.embed / max(1, n.sum())
    return (mean @ model.out + model.bias).astype(float)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def pieces(b: bytes) -> list[list[bytes]]:
    """The whole text, cut into runs of words of the lengths of ``PIECES`` in turn."""
    words, at, out = b.translate(_TABLE).split(), 0, []
    while at < len(words):
        n = PIECES[len(out) % len(PIECES)]
        out.append(words[at : at + n])
        at += n
    return out


def _matrix(bags: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(bags), BUCKETS), np.float32)
    for row, b in zip(x, bags, strict=True):
        np.add.at(row, b, np.float32(1 / max(1, len(b))))
    return x


def fit(texts: list[bytes], languages: list[str], epochs: int = EPOCHS, batch: int = 128, rate: float = 40.0, precision: float = 0.99, seed: int = 7) -> Model:
    """Descent with a falling rate over the pieces of four fifths of the texts; temperature and threshold from the rest."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    model = Model(names, rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    seen: tuple[list, list] = ([], [])
    kept: tuple[list, list] = ([], [])
    for k, (text, lang) in enumerate(zip(texts, languages, strict=True)):
        bags, labels = kept if k % 5 == 4 else seen
        for words in pieces(text):
            bags.append(np.concatenate(list(subwords(words))).astype(np.int32))
            labels.append(names.index(lang))
    bags, y = seen[0], np.array(seen[1], np.int64)
    steps, step = epochs * -(-len(bags) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            rows = order[at : at + batch]
            x, now = _matrix([bags[r] for r in rows]), rate * (1 - step / steps)
            h = x @ model.embed
            d = softmax(h @ model.out + model.bias)
            d[np.arange(len(rows)), y[rows]] -= 1
            d /= len(rows)
            g_embed, g_out, g_bias = x.T @ (d @ model.out.T), h.T @ d, d.sum(0)
            model.embed -= now * g_embed
            model.out -= 0.02 * now * g_out
            model.bias -= 0.02 * now * g_bias
            step += 1
    if kept[0]:
        z = np.concatenate([_matrix(kept[0][i : i + 256]) @ model.embed @ model.out + model.bias for i in range(0, len(kept[0]), 256)]).astype(float)
        calibrate(model, z, np.array(kept[1]), precision)
    return model


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, precision: float) -> None:
    """Sets the temperature of least log loss on a grid, and the lowest threshold that is precise enough (above 1: none is)."""
    at = np.arange(len(y))
    loss = [(-np.log(np.maximum(softmax(z / t)[at, y], 1e-12)).mean(), t) for t in np.geomspace(0.2, 5, 49)]
    model.temperature = float(min(loss)[1])
    p = softmax(z / model.temperature)
    score, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-score, kind="stable")
    last = np.append(np.diff(score[order]) != 0, True)  # equal scores pass together
    good = np.flatnonzero(last & (np.cumsum(right[order]) >= precision * (1 + at)))
    model.threshold = float(score[order][good[-1]]) if len(good) else 1.1


def train(docs: DataFrame, rows: int = ROWS) -> Model | None:
    """Learns from ``text`` and non-null ``lang`` of documents whose fold of three is not 1."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of(folds=3) != 1))
    got = text_sample(docs, known.select(text_key().alias("k"), F.col("lang").cast("string").alias("y")), rows).toArrow()
    pairs = sorted(zip(got["b"].to_pylist(), got["y"].to_pylist(), strict=True), key=lambda x: (hash_of(x[0]), x[1]))
    return fit([b for b, _ in pairs], [y for _, y in pairs]) if pairs else None


def hash_of(b: bytes) -> tuple[int, bytes]:
    """An order of texts that is independent of what they say at their start, for a fair fifth."""
    from zlib import crc32

    return crc32(b), b


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` per row. The model (1 MB and a row for each language) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    base = docs.select("doc_id", (F.col("doc_id").isNull() | (fold_of(folds=3) == 1)).alias("held_out"), letter.alias("letter"), text_bytes().alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches):
            names, scores = [], []
            for letter, b in zip(batch.column("letter").to_pylist(), batch.column("b"), strict=True):
                p = softmax(logits(m, b.as_py()) / m.temperature) if letter and m else None
                names.append(UNKNOWN if p is None else m.languages[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield add_columns(batch, ["doc_id", "held_out"], {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    scored = base.mapInArrow(run, f"{fields(base, 'doc_id', 'held_out')}, lang_pred string, score double")
    return scored.withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= (model.threshold if model else 1.0)))
