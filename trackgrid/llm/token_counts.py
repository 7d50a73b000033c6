"""Word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, sliced

_automata: dict = {}
#: Words that a task keeps counted; it starts afresh beyond that.
WORDS = 150_000


def vocabulary(path: str) -> set[bytes]:
    """The pieces of a byte-level vocabulary file as bytes; pieces that start words start with a space."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves there
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return {bytes(byte[c] for c in p) for p in pieces if all(c in byte for c in p)}


class Automaton:
    """Trie of a vocabulary with failure links and the number of pieces popped when one is followed.

    A word is written with a space before it. Its first piece is the longest one that starts with the
    space, each further piece the longest one without. A state without a failure link means that no
    pieces cover the word.
    """

    START, REST = 0, 1

    def __init__(self, pieces: set[bytes]):
        step: dict[int, int] = {}
        ends, children = {}, [[], []]
        for p in pieces:
            node = self.START if p[:1] == b" " else self.REST
            for b in p:
                to = step.get(node << 8 | b)
                if to is None:
                    to = step[node << 8 | b] = len(children)
                    children.append([])
                    children[node].append((b, to))
                node = to
            if p:
                ends[node] = True
        fail: list[int | None] = [None] * len(children)
        pops = [0] * len(children)
        level = [self.START, self.REST]
        while level:
            below = []
            for u in level:
                for b, v in children[u]:
                    below.append(v)
                    if v in ends:
                        fail[v], pops[v] = self.REST, 1
                        continue
                    z, popped = fail[u], pops[u]
                    while z is not None and z << 8 | b not in step:
                        popped += pops[z]
                        z = fail[z]
                    if z is not None:
                        fail[v], pops[v] = step[z << 8 | b], popped
            level = below
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; 1, one unknown piece, if they can't cover it."""
        step, fail, pops = self.step, self.fail, self.pops
        u, n = self.START, 0
        for b in b" " + word:
            while (to := step.get(u << 8 | b)) is None:
                n += pops[u]
                u = fail[u]
                if u is None:
                    return 1
            u = to
        while u != self.REST:
            n += pops[u]
            u = fail[u]
            if u is None:
                return 1
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_tokens: greedy longest-match pieces of each whole text.

    Words stand between ASCII white space. Null and empty texts have no words. Row-local: no shuffle;
    repeated rows stay; other columns are dropped. path: a byte-level vocabulary file, read by each
    worker once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _automata:
            _automata[path] = _Counts(Automaton(vocabulary(path)))
        counts = _automata[path].__getitem__
        for whole in batches:
            for batch in sliced(whole, "text"):
                words = [x.split() for x in as_bytes(batch, "text")]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"],
                    "n_words": pa.array([len(x) for x in words], pa.int64()),
                    "n_tokens": pa.array([sum(map(counts, x)) for x in words], pa.int64()),
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
