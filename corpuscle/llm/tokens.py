"""Token ids of texts (problem 8), by a pair occurrence index."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpuscle.llm.common import read

#: Folder of the public tokenizers' files; None for that of the installed package.
FOLDER: str | None = os.environ.get("CORPUSCLE_TOKENIZERS")
NAME = "byte_bpe_50k"
#: Distinct words whose ids a worker keeps. Beyond it the memory starts anew; no result depends on it.
KEPT = 400_000


def vocabulary_path(name: str, folder: str | None = None) -> str:
    folder = folder or FOLDER
    if folder:
        return os.path.join(folder, f"{name}.tiktoken")
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Byte-pair encoding of many words together.

    The symbols of all words lie in one list, words apart. An index maps each pair of neighbours that the vocabulary
    can join to all its positions. The pairs present are joined in ascending order of rank, each at all its
    positions at once, and only the lists of the pairs beside a join change. As a pair that holds a new symbol
    ranks after it, no rank comes up twice; the effort is n log n even for one word of any length.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _join(self, a: int, b: int) -> int:
        """Rank of the token that the symbols a and b make together, or -1."""
        got = self.joined.get((a, b))
        if got is None:
            got = self.joined[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return got

    def words(self, words: list[str]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...] | None] = []
        single, symbols, begins = self.single, [], []
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            begins.append(len(symbols))
            if whole is None:
                symbols.extend([single[b] for b in raw])
            else:
                symbols.append(whole)
            symbols.append(-1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at: dict[int, list[int]] = {}
        ranks: list[int] = []

        def note(a: int, b: int, i: int) -> None:
            rank = self._join(a, b)
            if rank >= 0:
                if (places := at.get(rank)) is None:
                    at[rank] = [i]
                    heappush(ranks, rank)
                else:
                    places.append(i)

        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0:
                note(a, b, i)
        while ranks:
            rank = heappop(ranks)
            places = at.pop(rank)
            places.sort()
            for i in places:
                a = symbols[i]
                if a < 0:
                    continue
                j = after[i]
                b = symbols[j]
                if b < 0 or self._join(a, b) != rank:
                    continue  # an earlier join took one of the two
                symbols[i], symbols[j] = rank, -2
                k = after[i] = after[j]
                before[k] = i
                if (c := symbols[k]) >= 0:
                    note(rank, c, i)
                h = before[i]
                if h >= 0 and (c := symbols[h]) >= 0:
                    note(c, rank, h)
        for i in begins:
            ids = []
            while symbols[i] != -1:
                ids.append(symbols[i])
                i = after[i]
            out.append(tuple(ids))
        return out

    def _learn(self, cut: list[list[str]]) -> dict[str, tuple[int, ...]]:
        """The ids of all words of ``cut``, each distinct one encoded once."""
        words = set(chain.from_iterable(cut))
        fresh = [w for w in words if w not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > KEPT:
                self.known.clear()
                fresh = list(words)
            order = fresh
            self.known.update(zip(order, self.words(order), strict=True))
        return self.known

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """The ids of all texts one after the other, and where each begins; none for a null or empty text."""
        cut = [self.split(t) if t else [] for t in texts]
        get = self._learn(cut).__getitem__
        ids: list[int] = []
        begins = [0]
        for ws in cut:
            ids.extend(chain.from_iterable(map(get, ws)))
            begins.append(len(ids))
        return ids, begins

    def lengths(self, texts: list[str | None]) -> list[int]:
        """How many ids each text has."""
        cut = [self.split(t) if t else [] for t in texts]
        get = self._learn(cut).__getitem__
        return [sum(map(len, map(get, ws))) for ws in cut]

    def word_lengths(self, text: str) -> tuple[list[str], list[int]]:
        """The words of a text and how many ids each has."""
        ws = self.split(text)
        get = self._learn([ws]).__getitem__
        return ws, [len(get(w)) for w in ws]


@cache
def encoder(name: str = NAME, folder: str | None = None) -> Encoder:
    import public_tokenizers

    return Encoder(vocabulary_path(name, folder), public_tokenizers.PATTERN)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            ids, begins = own.encode(part.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(np.array(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])


def p8_ids(spark, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the ids of each document by byte_bpe_50k; an empty list for a null or empty text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_ids, "doc_id bigint, ids array<int>")
