"""Chat formatting: roles of a transcript by a hidden Markov model, then canonical turns.

A record is a row ``(conv_id, turn, text)``. Its lines are read as segments: a line that begins with a
speaker marker ("User:", "### Assistant", "[system]") opens a segment, other lines continue it. States are
the roles; a segment emits its marker and the features of its lines; moves happen between records and at
marker lines. Viterbi gives the roles, and each segment becomes one canonical turn.

A conversation may hold any share of all rows. Records are therefore reduced to their max-plus transfer
matrix (role of the first segment by role of the last), sorted by range over (conv_id, turn, text), so a
long conversation spans many partitions, and solved in two passes: every partition multiplies the matrices
of its first and last run; the runs, two rows per partition at most, are chained on the driver; then every
partition decodes its runs with the ends fixed. No conversation is gathered in one task.

The model is fitted on at most ``rows`` records whose role is known, outside fold 0 of conv_id (a
documented bound). How often a role is marked is learned; that a marker names its role is given (OWN).

Defined results: a null or empty text is one empty segment; a null conv_id is a conversation of that row
alone; a null turn comes first; equal (conv_id, turn, text) rows are one record and all get its turns; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopgrade.functions.session import cut
from loopgrade.llm.common import fields, fold_of, slices, text_key

ROLES = ("system", "user", "assistant")
K = len(ROLES)
ROWS = 20_000
#: The names by which transcripts mark a speaker.
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "prompt", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "response", "a"),
}
_ROLE_OF = {n: r for r, (_, names) in enumerate(NAMES.items()) for n in names}
_MARKER = re.compile(rf"^[ \t]*(?:#+[ \t]*|[\[<|*]+)?({'|'.join(sorted(_ROLE_OF, key=len, reverse=True))})(?:[\]>|*]+[ \t]*:?|[ \t]*[:>])[ \t]*", re.I)
_HEADING = re.compile(rf"^[ \t]*#+[ \t]*({'|'.join(sorted(_ROLE_OF, key=len, reverse=True))})[ \t]*$", re.I)
_LIST = re.compile(r"^[ \t]*(?:[-*•]|\d+[.)]|```)")
#: Number of values of each feature: marker, words of the line, question mark, list or code, lines of the segment.
SIZES = (K + 1, 8, 2, 2, 8)
#: Chance that a marker names the role that speaks.
OWN = 0.998
TEMPLATE = "<|{role}|>\n{text}\n<|end|>"


def marker_of(line: str) -> tuple[int, str]:
    """Role index of the line's speaker marker (K: none) and the line without it."""
    m = _MARKER.match(line) or _HEADING.match(line)
    return (_ROLE_OF[m[1].lower()], line[m.end() :]) if m else (K, line)


def segments(text: str | None) -> list[tuple[list[list[int]], str]]:
    """Per segment: the features of its lines, and its text without the marker."""
    parts: list[tuple[list[tuple[int, str]], list[str]]] = [([], [])]
    for line in (text or "").split("\n"):
        role, rest = marker_of(line)
        if role < K and (parts[-1][0] or parts[-1][1]):
            parts.append(([], []))
        parts[-1][0].append((role, rest))
        parts[-1][1].append(rest)
    out = []
    for lines, content in parts:
        many = min(7, len(lines).bit_length())
        rows = [[role, min(7, len(x.split()).bit_length()), int(x.rstrip().endswith("?")), int(bool(_LIST.match(x))), many] for role, x in lines]
        out.append((rows, "\n".join(content).strip("\n")))
    return out


@dataclass
class Model:
    start: np.ndarray  # (K,) log
    move: np.ndarray  # (K, K) log, from row to column
    emit: list[np.ndarray]  # per feature (K, size) log

    def segment(self, rows: list[list[int]]) -> np.ndarray:
        """Log score of a segment for every role."""
        x = np.array(rows)
        e = self.emit[0][:, x[0, 0]] + self.emit[4][:, x[0, 4]]
        for k in (1, 2, 3):
            e = e + self.emit[k][:, x[:, k]].sum(axis=1)
        return e

    def record(self, parts: list[list[list[int]]]) -> np.ndarray:
        """Max-plus matrix (K, K): role of the first segment by role of the last."""
        m = np.full((K, K), -np.inf)
        np.fill_diagonal(m, self.segment(parts[0]))
        for p in parts[1:]:
            m = times(times(m, self.move), np.where(np.eye(K, dtype=bool), self.segment(p)[:, None], -np.inf))
        return m


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def tally(rows: list[list[int]]) -> list[int]:
    """What training needs of a segment, however many lines it has: marked or not, its length class, then how often its lines show each value of features 1 to 3."""
    x = np.array(rows)
    return [int(x[0, 0] < K), int(x[0, 4]), *np.concatenate([np.bincount(x[:, k], minlength=SIZES[k]) for k in (1, 2, 3)]).tolist()]


def train(rows: list[tuple[object, int, list[int]]]) -> Model:
    """Counts with add-one smoothing from ``(conv_id, role, tally of the record's first segment)`` in order."""
    start, move = np.ones(K), np.ones((K, K))
    emit = [np.ones((K, n)) for n in SIZES]
    marked = np.ones((K, 2))
    last, before = object(), 0
    for conv, role, (is_marked, many, *lines) in rows:
        if conv == last:
            move[before, role] += 1
        else:
            start[role] += 1
        last, before = conv, role
        marked[role, is_marked] += 1
        emit[4][role, many] += 1
        for k, n in zip((1, 2, 3), np.split(np.array(lines), np.cumsum(SIZES[1:3])), strict=True):
            emit[k][role] += n
    rate = marked / marked.sum(axis=1, keepdims=True)
    named = np.where(np.eye(K, dtype=bool), OWN, (1 - OWN) / (K - 1))
    emit[0] = np.hstack([rate[:, 1:] * named, rate[:, :1]])
    log = lambda a: np.log(a / a.sum(axis=-1, keepdims=True))
    return Model(log(start), log(move), [log(e) for e in emit])


def fit(convs: DataFrame, rows: int = ROWS) -> Model:
    """The driver gets 14 numbers a record, at most ``rows`` times."""
    known = convs.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & (fold_of("conv_id") != 0))
    lowest = known.select("conv_id", "turn", "role", "text").orderBy(F.xxhash64("conv_id"), "conv_id", "turn", text_key(), "role").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            first = [tally(segments(t)[0][0]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("role"), pa.array(first, pa.list_(pa.int32()))], names=["conv_id", "role", "lines"])

    got = lowest.mapInArrow(run, f"{fields(lowest, 'conv_id', 'role')}, lines array<int>").collect()
    return train([(r.conv_id, ROLES.index(r.role), r.lines) for r in got])


def viterbi(scores: list[np.ndarray], model: Model, first: bool, ends: tuple[int, int] | None) -> list[tuple[int, int]]:
    """Best (first, last) roles of every record of a run; ``first``: it begins its conversation; ``ends``: its outer roles, where fixed."""
    m = scores[0] + (model.start[:, None] if first else 0)
    if ends:
        m = np.where((np.arange(K) == ends[0])[:, None], m, -np.inf)
    entries, v = [m.argmax(axis=0)], m.max(axis=0)  # for every last role: the best first role of that record
    came = [np.zeros(K, int)]
    for s in scores[1:]:
        step = v[:, None] + model.move
        best, into = step.argmax(axis=0), step.max(axis=0)
        m = into[:, None] + s
        entry = m.argmax(axis=0)
        entries.append(entry)
        came.append(best[entry])
        v = m.max(axis=0)
    j = ends[1] if ends else int(v.argmax())
    out = []
    for entry, back in zip(entries[::-1], came[::-1], strict=True):
        out.append((int(entry[j]), j))
        j = int(back[j])
    return out[::-1]


def _runs(convs: list) -> list[tuple[int, int]]:
    """[start, end) of the runs of one conversation; a null conversation is a run of its own."""
    cuts = [i for i in range(1, len(convs)) if convs[i] is None or convs[i] != convs[i - 1]]
    return list(zip([0, *cuts], [*cuts, len(convs)], strict=True)) if convs else []


def _partition(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, list, np.ndarray, int]:
    got = list(batches)
    t = pa.Table.from_batches(got) if got else None
    if t is None or not t.num_rows:
        return None, [], np.zeros(0), 0
    scores = np.stack([t.column(f"m{k}").to_numpy() for k in range(K * K)], 1).reshape(-1, K, K)
    return t, t.column("conv").to_pylist(), scores, t.column("pid")[0].as_py()


def _chain(edges: list, model: Model) -> dict[tuple[int, bool], tuple[bool, int, int]]:
    """(pid, is the last run) -> (begins its conversation, first role, last role) for runs of conversations that span partitions."""
    edges = sorted(edges, key=lambda r: (r.pid, r.last))
    fixed: dict[tuple[int, bool], tuple[bool, int, int]] = {}
    i = 0
    while i < len(edges):
        j = i + 1
        while j < len(edges) and edges[i].conv is not None and edges[j].conv == edges[i].conv and edges[j].pid != edges[j - 1].pid:
            j += 1
        if j - i > 1:
            scores = [np.array(e.m).reshape(K, K) for e in edges[i:j]]
            for n, (e, ends) in enumerate(zip(edges[i:j], viterbi(scores, model, True, None), strict=True)):
                fixed[e.pid, e.last] = (n == 0, *ends)
                if e.only:
                    fixed[e.pid, not e.last] = fixed[e.pid, e.last]
        i = j
    return fixed


def states(convs: DataFrame, model: Model) -> DataFrame:
    """``key_1, key_2, first, last``: the roles of the first and last segment of every record."""
    key_1 = F.xxhash64(F.col("conv_id").isNull(), "conv_id", F.col("turn").isNull(), "turn")
    base = convs.select(F.col("conv_id").alias("conv"), "turn", key_1.alias("key_1"), text_key().alias("key_2"), F.col("text").cast("string").alias("text"))
    cells = [f"m{k}" for k in range(K * K)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = np.array([model.record([rows for rows, _ in segments(t)]).reshape(-1) for t in batch.column("text").to_pylist()]).reshape(-1, K * K)
            same = [batch.column(c) for c in ("conv", "turn", "key_1", "key_2")]
            yield pa.RecordBatch.from_arrays([*same, *[pa.array(m[:, k]) for k in range(K * K)]], names=["conv", "turn", "key_1", "key_2", *cells])

    scored = base.mapInArrow(score, f"{fields(base, 'conv', 'turn', 'key_1', 'key_2')}, {', '.join(f'{c} double' for c in cells)}")
    once = scored.groupBy("conv", "turn", "key_1", "key_2").agg(*[F.max(c).alias(c) for c in cells])
    order = [F.col("conv").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("key_2")]
    ranged = cut(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, conv, scores, pid = _partition(batches)
        if t is None:
            return
        runs, rows = _runs(conv), []
        for last, (a, b) in ((False, runs[0]), (True, runs[-1]))[: 1 if len(runs) == 1 else 2]:
            m = scores[a]
            for s in scores[a + 1 : b]:
                m = times(times(m, model.move), s)
            rows.append((pid, last, len(runs) == 1, t.column("conv")[a], m.reshape(-1).tolist()))
        own = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
        conv_of = pa.array([r[3].as_py() for r in rows], t.schema.field("conv").type)
        yield pa.RecordBatch.from_arrays([*own, conv_of, pa.array([r[4] for r in rows], pa.list_(pa.float64()))], names=["pid", "last", "only", "conv", "m"])

    edges = ranged.mapInArrow(outer, f"pid int, last boolean, only boolean, {fields(ranged, 'conv')}, m array<double>").collect()
    fixed = _chain(edges, model)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, conv, scores, pid = _partition(batches)
        if t is None:
            return
        runs, out = _runs(conv), []
        for n, (a, b) in enumerate(runs):
            edge = fixed.get((pid, n > 0)) if n in (0, len(runs) - 1) else None
            out += viterbi(list(scores[a:b]), model, edge[0] if edge else True, edge[1:] if edge else None)
        keys = [t.column(c).combine_chunks() for c in ("key_1", "key_2")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([x for x, _ in out], pa.int32()), pa.array([y for _, y in out], pa.int32())], names=["key_1", "key_2", "first", "last"])

    return ranged.mapInArrow(inner, "key_1 long, key_2 long, first int, last int")


def escape(text: str) -> str:
    """``<|`` inside a turn is written ``<\\|``, and ``<\\|`` as ``<\\\\|`` and so on, so that the tags of the template can be told from it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(convs: DataFrame, model: Model, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, turn, part, role, text, rendered``: the canonical turns of every record, ``part`` counting its segments. Tags inside a text are escaped."""
    key_1 = F.xxhash64(F.col("conv_id").isNull(), "conv_id", F.col("turn").isNull(), "turn")
    rows = convs.select("conv_id", "turn", F.col("text").cast("string").alias("text"), key_1.alias("key_1"), text_key().alias("key_2"))
    both = rows.join(states(convs, model), ["key_1", "key_2"]).drop("key_1", "key_2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple[int, int, str, str]] = []
            for k, (text, first, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "first", "last")), strict=True)):
                parts = segments(text)
                own = [np.where(np.eye(K, dtype=bool), model.segment(p)[:, None], -np.inf) for p, _ in parts]
                roles = [r for r, _ in viterbi(own, model, False, (first, last))]
                out += [(k, n, ROLES[r], content) for n, (r, (_, content)) in enumerate(zip(roles, parts, strict=True))]
            at = pa.array([o[0] for o in out], pa.int64())
            cols = [batch.column("conv_id").take(at), batch.column("turn").take(at), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())]
            texts = [pa.array([o[3] for o in out], pa.string()), pa.array([template.format(role=o[2], text=escape(o[3])) for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *texts], names=["conv_id", "turn", "part", "role", "text", "rendered"])

    return both.mapInArrow(run, f"{fields(rows, 'conv_id', 'turn')}, part int, role string, text string, rendered string")
