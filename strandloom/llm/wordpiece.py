"""Token counts by a linear longest-match automaton.

A trie of the vocabulary has for each node a failure link, the node where matching goes on when no longer piece fits,
and the number of pieces that are popped on the way. Walking a word visits each byte once, whatever the pieces; pieces
themselves are not built. Words are runs of bytes other than ASCII white space; each is matched with ``prefix`` (the
vocabulary's mark of a word's beginning) in front. Vocabularies that mark the pieces inside a word instead (``rest``, as
"##") have a trie of their own for these, which matching goes on in after the first piece. A word that cannot be matched
counts as one unknown token.

A null or empty text has no words and no tokens; repeated rows and ties are counted each for itself; extra columns are
not read; an empty table gives an empty result. A table of bounded size holds counts of words seen before, which saves time and changes no result.
"""

from __future__ import annotations

import uuid
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import public, read_ranks
from .common import documents, held, tidy

CACHE, KEY_BYTES = 300_000, 64


class Automaton(dict):
    """As a dict, it has counts of words."""

    def __init__(self, pieces, prefix: bytes = b" ", rest: bytes = b""):
        super().__init__()
        self.prefix = prefix
        self.next: list[dict[int, int]] = [{}]
        #: Where matching goes on after a piece.
        self.top = 0
        if rest:
            self.top = 1
            self.next.append({})
        ends: set[int] = set()
        for piece in pieces:
            u = 0
            if rest and piece.startswith(rest):
                u, piece = self.top, piece[len(rest) :]
            for c in piece:
                v = self.next[u].get(c)
                if v is None:
                    v = self.next[u][c] = len(self.next)
                    self.next.append({})
                u = v
            if piece:
                ends.add(u)
        n = len(self.next)
        self.fail: list[int | None] = [None] * n
        self.pops = [0] * n
        queue = deque(dict.fromkeys([self.top, 0]))
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = self.top, 1
                    continue
                z, pops = self.fail[u], self.pops[u]
                while z is not None and c not in self.next[z]:
                    pops += self.pops[z]
                    z = self.fail[z]
                if z is not None:
                    self.fail[v], self.pops[v] = self.next[z][c], pops

    def count(self, word: bytes) -> int:
        """Pieces of the word by greedy longest match; 1 if it has none."""
        u, n, steps, fail, pops, top = 0, 0, self.next, self.fail, self.pops, self.top
        for c in self.prefix + word:
            while (v := steps[u].get(c)) is None:
                n += pops[u]
                if (u := fail[u]) is None:
                    return 1
            u = v
        while u and u != top:
            n += pops[u]
            if (u := fail[u]) is None:
                return 1
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= KEY_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary, prefix: bytes = b" ", rest: bytes = b"", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_tokens for a vocabulary: a file of ranked byte strings, or the pieces themselves."""
    pieces = sorted(read_ranks(vocabulary) if isinstance(vocabulary, str) else vocabulary)
    shared, key = docs.sparkSession.sparkContext.broadcast((pieces, prefix, rest)), uuid.uuid4().hex

    def run(batches):
        table = held("wordpiece")
        if key not in table:
            table.clear()
            table[key] = Automaton(*shared.value)
        count = table[key].__getitem__
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            n_words, n_tokens = [], []
            for lo in range(0, batch.num_rows, 256):
                for t in column.slice(lo, 256).to_pylist():
                    words = (t or b"").split()
                    n_words.append(len(words))
                    n_tokens.append(sum(map(count, words)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, n_words long, n_tokens long")


def op8(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public()[0])
