"""Greedy word-piece lengths by a linear automaton.

A trie over the vocabulary gets, for each state, a failure link and the number
of pieces popped on the way (the linear longest-match construction of Song et
al., "Fast WordPiece Tokenization", 2021).  One pass over a word then yields
how many pieces greedy longest match would cut it into; no piece is built.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CACHE_WORDS = 200_000


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself if printable, else 256, 257, ..."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PieceCounter:
    """Counts greedy pieces; a word that cannot be cut counts as one unknown piece."""

    def __init__(self, pieces: Iterable[str]):
        self.step: list[dict[str, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                node = self.step[node].setdefault(c, len(self.step))
                if node == len(self.step):
                    self.step.append({})
                    is_piece.append(False)
            if node:
                is_piece[node] = True
        # fail[v]: where matching goes on once v's text is cut; popped[v]: pieces cut on the way; -1: no way on.
        self.fail, self.popped = [-1] * len(self.step), [0] * len(self.step)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in self.step[node].items():
                queue.append(child)
                if is_piece[child]:
                    self.fail[child], self.popped[child] = 0, 1
                else:
                    at, n = self.fail[node], self.popped[node]
                    while at >= 0 and c not in self.step[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.step[at][c], n

    def count(self, word: str) -> int:
        """Pieces of one word, in time linear in its length."""
        step, fail, popped = self.step, self.fail, self.popped
        node = n = 0
        for c in word:
            while c not in step[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = step[node][c]
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n if node == 0 else 1


@lru_cache(maxsize=2)
def counter_of(path: str) -> PieceCounter:
    with open(path, encoding="utf-8") as f:
        return PieceCounter(json.load(f)["model"]["vocab"])


def count_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_words, n_tokens of every row.

    Words are runs without ASCII blanks; each is read as UTF-8 bytes behind a
    blank, in the vocabulary's byte symbols.  Null and empty texts count 0;
    repeated rows are counted one by one; ``vocabulary`` must lie on every
    executor.  The cache of word lengths is bounded and only saves time.  Very
    long texts are read whole; an empty table gives an empty result; further
    columns are left out.
    """

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, symbols, known = counter_of(vocabulary), byte_symbols(), {}
        to_symbols, blank = str.maketrans({chr(b): s for b, s in enumerate(symbols)}), symbols[32]
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("text"):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                total = 0
                for word, times in Counter(words).items():
                    n = known.get(word)
                    if n is None:
                        n = pieces.count(blank + word.decode("latin-1").translate(to_symbols))
                        if len(word) <= 64:
                            if len(known) >= cache_words:
                                known.clear()
                            known[word] = n
                    total += n * times
                n_words.append(len(words))
                n_tokens.append(total)
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(counts, "doc_id long, n_words long, n_tokens long")
