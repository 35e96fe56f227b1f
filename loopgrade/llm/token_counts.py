"""Token counts by a linear longest-match automaton.

A word is split greedily: the longest vocabulary piece that starts it, then the longest that starts the
rest, and so on; a word that can't be split whole counts as one unknown token. The automaton is the trie
of the pieces with a failure link for every node and the number of pieces that following the link pops,
computed once breadth-first. Counting walks a word once, adding popped counts, and builds no pieces.

Words begin with ``mark`` in the vocabulary (U+2581 in piece models), so a word is matched as mark + word.

Defined results: a null or empty text has no words and no tokens; repeated rows count alike; an empty
table gives an empty result; an empty vocabulary makes every word unknown.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame

from loopgrade.llm.common import add_columns, fields, slices, text_bytes

MARK = "▁"
#: Words whose count a worker remembers; when full, the memory starts anew.
REMEMBERED = 200_000


class Automaton:
    """Nodes are numbers, 0 the root. ``step[node << 21 | code point]`` is the trie; ``link`` -1 means no link."""

    def __init__(self, pieces: list[str]) -> None:
        self.step: dict[int, int] = {}
        below: list[list[tuple[int, int]]] = [[]]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in map(ord, piece):
                key = node << 21 | c
                if key not in self.step:
                    self.step[key] = len(below)
                    below[node].append((c, len(below)))
                    below.append([])
                    whole.append(False)
                node = self.step[key]
            whole[node] = node > 0
        self.link = [-1] * len(below)
        self.pops = [0] * len(below)
        queue = deque([0])
        while queue:
            up = queue.popleft()
            for c, node in below[up]:
                queue.append(node)
                if whole[node]:
                    self.link[node], self.pops[node] = 0, 1
                    continue
                at, popped = self.link[up], self.pops[up]
                while at >= 0 and (at << 21 | c) not in self.step:
                    popped += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.step[at << 21 | c], popped
        self.rest = [self._drain(node) for node in range(len(below))]

    def _drain(self, node: int) -> int:
        """Pieces left when the word ends at ``node``; -1 where it can't be split."""
        n = 0
        while node > 0:
            if self.link[node] < 0:
                return -1
            n += self.pops[node]
            node = self.link[node]
        return n

    def count(self, word: str) -> int:
        """Pieces of the greedy split, or -1 for an unknown word."""
        step, link, pops = self.step, self.link, self.pops
        node = n = 0
        for c in map(ord, word):
            to = step.get(node << 21 | c)
            while to is None:
                if link[node] < 0:
                    return -1
                n += pops[node]
                node = link[node]
                to = step.get(node << 21 | c)
            node = to
        left = self.rest[node]
        return -1 if left < 0 else n + left


def load_pieces(path: str) -> list[str]:
    """Text pieces of a sentencepiece model file: no control, unknown or byte pieces. Read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


#: The automaton of this worker process, by the name of the run that needs it.
_built: dict[str, Automaton] = {}


def count(docs: DataFrame, pieces: list[str], mark: str = MARK) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` per row; a map without a shuffle. The vocabulary, a file of fixed size, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    name = uuid4().hex
    base = docs.select("doc_id", text_bytes().alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Automaton(sent.value)
        auto, known = _built[name], {}
        for batch in slices(batches):
            out: list[tuple[int, int, int]] = []
            for b in batch.column("b"):
                words = b.as_py().split()
                total = unknown = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = known[w] = auto.count(mark + w.decode("utf-8", "surrogateescape"))
                    if n < 0:
                        unknown += 1
                    else:
                        total += n
                out.append((len(words), total + unknown, unknown))
            cols = zip(*out, strict=True) if out else ([], [], [])
            yield add_columns(batch, ["doc_id"], {k: pa.array(v, pa.int64()) for k, v in zip(("n_words", "n_tokens", "n_unknown"), cols, strict=True)})

    return base.mapInArrow(run, f"{fields(base, 'doc_id')}, n_words long, n_tokens long, n_unknown long")
