"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word, and pieces that go on. Each node
has a failure link and the number of pieces that are finished when it is followed, both
precomputed. Reading a word moves through the trie and adds these numbers up: each character is
read once, no piece is built, no prefix tried again. The count is that of greedy
longest-match-first pieces.

Words are what white space separates. A character that is no piece itself counts as its UTF-8
bytes (byte fallback) and splits the word; with every other character a piece, a match never
fails. If a vocabulary lacks a needed piece all the same, the word counts as one unknown token.

The automaton is broadcast: its size is the vocabulary's, of at most MAX_PIECES pieces. Rows are
independent and nothing is shuffled. Counts of words are remembered, up to MEMORY words of at most SHORT characters a task.

Defined results: null and empty texts have 0 words and 0 tokens. Texts and words of any length are read whole, a
word without unknown characters in one pass. Repeated rows get equal counts. Columns named n_words and
n_tokens must not be among those given. A vocabulary of more than MAX_PIECES pieces is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import widened

MARK = "▁"
MAX_PIECES = 1_000_000
MEMORY, SHORT = 200_000, 64
UNKNOWN = -1


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that go on) of a model file; control and byte pieces aside."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    begins, goes_on = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith(MARK) and MARK not in piece[1:]:
            begins.append(piece[1:])
        elif MARK not in piece:
            goes_on.append(piece)
    return begins, goes_on


class Automaton:
    """begins: pieces at a word's start, the empty one if a bare start is a piece; goes_on: the rest."""

    def __init__(self, begins: list[str], goes_on: list[str]):
        self.known = frozenset(p for p in goes_on if len(p) == 1)
        self.step: list[dict[str, int]] = [{}, {}]
        self.link: list[int] = [UNKNOWN, UNKNOWN]
        self.popped: list[int] = [0, 0]
        final = [False, False]
        for root, pieces in ((0, begins), (1, goes_on)):
            for piece in pieces:
                at = root
                for c in piece:
                    nxt = self.step[at].get(c)
                    if nxt is None:
                        nxt = self.step[at][c] = len(self.step)
                        self.step.append({})
                        self.link.append(UNKNOWN)
                        self.popped.append(0)
                        final.append(False)
                    at = nxt
                final[at] = piece != "" or root == 0
        if final[0]:  # the bare start of a word is a piece: from the root, one piece is finished
            self.link[0], self.popped[0] = 1, 1
        level = [(0, c, v) for c, v in self.step[0].items()] + [(1, c, v) for c, v in self.step[1].items()]
        while level:
            below = []
            for parent, c, v in level:
                if final[v]:
                    self.link[v], self.popped[v] = 1, 1
                else:
                    at, n = self.link[parent], self.popped[parent]
                    while at != UNKNOWN and c not in self.step[at]:
                        n += self.popped[at]
                        at = self.link[at]
                    if at != UNKNOWN:
                        self.link[v], self.popped[v] = self.step[at][c], n
                below += [(v, d, w) for d, w in self.step[v].items()]
            level = below

    def run(self, part: str, root: int) -> int:
        """Pieces of a part of a word without unknown characters, or UNKNOWN."""
        step, link, popped = self.step, self.link, self.popped
        at, n = root, 0
        for c in part:
            while (nxt := step[at].get(c)) is None:
                n += popped[at]
                at = link[at]
                if at == UNKNOWN:
                    return UNKNOWN
            at = nxt
        while at != 1:
            n += popped[at]
            at = link[at]
            if at == UNKNOWN:
                return UNKNOWN
        return n

    def count(self, word: str) -> int:
        """Tokens of a word."""
        total, start, root, known = 0, 0, 0, self.known
        for i, c in enumerate(word):
            if c not in known:
                if (n := self.run(word[start:i], root)) == UNKNOWN:
                    return 1
                total += n + len(c.encode("utf-8", "replace"))
                start, root = i + 1, 1
        n = self.run(word[start:], root)
        return 1 if n == UNKNOWN else total + n


def with_counts(docs: DataFrame, automaton: Automaton, text: str = "text") -> DataFrame:
    """docs without its text, with n_words and n_tokens."""
    spark: SparkSession = docs.sparkSession
    shipped = spark.sparkContext.broadcast(automaton)
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        known: dict[str, int] = {}
        for batch in batches:
            n_words, n_tokens = [], []
            for value in batch.column(len(names)).to_pylist():
                words = value.split() if value else []
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = own.count(w)
                        if len(w) <= SHORT:
                            if len(known) >= MEMORY:
                                known.clear()
                            known[w] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [*names, "n_words", "n_tokens"]
            )

    schema = widened(docs.select(*names).schema, ("n_words", T.LongType()), ("n_tokens", T.LongType()))
    return docs.select(*names, text).mapInArrow(run, schema)
