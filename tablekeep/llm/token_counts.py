"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces of a whitespace word, counted without
building the pieces (the idea of LinMaxMatch; Song et al. 2021): a trie of
the vocabulary, and for every trie node a failure link to the node of the
longest unmatched rest and the number of pieces popped on the way. A word is
read once, byte by byte; its count is the sum of the popped counts. Time is
linear in the word's length, however long it is.

The vocabulary is a byte-level one: pieces that begin with a blank start a
word, the others go on inside it. A word is matched as blank + its bytes, so
with all single bytes present every word has pieces.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_WORDS = 200_000  # words whose counts a task remembers; emptied when full
CACHE_BYTES = 64       # longer words are not remembered


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a rank file (base64 piece and rank a line)."""
    with open(os.path.realpath(path), "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links and popped-piece counts over byte strings."""

    def __init__(self, pieces: list[bytes]):
        pieces = {p for p in pieces if p} | {bytes([b]) for b in range(256)}
        step: dict[int, int] = {}
        ends = bytearray(1)
        children: list[list[tuple[int, int]]] = [[]]
        for piece in sorted(pieces):
            node = 0
            for b in piece:
                to = step.get(node << 8 | b)
                if to is None:
                    to = len(children)
                    step[node << 8 | b] = to
                    children[node].append((b, to))
                    children.append([])
                    ends.append(0)
                node = to
            ends[node] = 1
        # breadth first: a node that is a piece pops itself and fails to the
        # root; any other node fails to where its parent's rest goes on with
        # the byte, with the pieces popped on the way. As every byte is a
        # piece, each node but the root is left with at least one pop.
        fail, pops = array("l", [0]) * len(children), array("l", [0]) * len(children)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for b, to in children[node]:
                todo.append(to)
                if ends[to]:
                    fail[to], pops[to] = 0, 1
                    continue
                rest, n = fail[node], pops[node]
                while (rest << 8 | b) not in step:
                    n += pops[rest]
                    rest = fail[rest]
                fail[to], pops[to] = step[rest << 8 | b], n
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a byte string."""
        step, fail, pops = self.step, self.fail, self.pops
        node = total = 0
        for b in word:
            to = step.get(node << 8 | b)
            while to is None:
                total += pops[node]
                node = fail[node]
                to = step.get(node << 8 | b)
            node = to
        while node:
            total += pops[node]
            node = fail[node]
        return total


class _Counts(dict):
    """Pieces of a word, remembered up to a bound."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


_BUILT: dict[int, _Counts] = {}


def token_counts(docs: DataFrame, vocabulary: str | list[bytes] = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_bytes, n_tokens)``, one row per row of ``docs``.

    The driver reads the vocabulary file and broadcasts its pieces (a fixed
    table, below one megabyte); each Python worker builds the automaton once.
    A null or empty text has no tokens; null and repeated ids keep their rows;
    other columns are ignored, whatever their names.
    """
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else list(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hash(tuple(pieces))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = _BUILT.get(key)
        if counts is None:
            counts = _BUILT[key] = _Counts(Automaton(shared.value))
        words, size, tokens = [], [], []
        for text in batch.column(1).to_pylist():
            data = common.utf8(text)
            parts = data.split()
            words.append(len(parts))
            size.append(len(data))
            tokens.append(sum(map(counts.__getitem__, parts)))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.array(x, np.int64)) for x in (words, size, tokens)]],
                                          names=["doc_id", "n_words", "n_bytes", "n_tokens"])
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_arrow(narrow, run, "doc_id long, n_words long, n_bytes long, n_tokens long")
