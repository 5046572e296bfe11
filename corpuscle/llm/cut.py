"""Splitting oversized texts at natural boundaries (problem 10), by recursive bisection."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import read
from corpuscle.llm.mix import source_key
from corpuscle.llm.tokens import encoder

#: A word of more tokens than this can be cut inside, where no word ends.
LONG_WORD = 16
#: A cut is sought as far from the middle as this share of what is cut.
REACH = 0.25
_SENTENCE_END = frozenset(".!?…。！？؟।")
_CLOSING = frozenset("\"'”’»)]")
_SPACES = regex.compile(r"\s+")


def _atoms(words: list[str], lengths: list[int]) -> tuple[list[int], list[int]]:
    """Where the smallest parts of a text that stay whole begin and end, and their running number of tokens: words,
    and of very long words single characters."""
    ends, tokens = [0], [0]
    for word, n in zip(words, lengths, strict=True):
        if n <= LONG_WORD:
            ends.append(ends[-1] + len(word))
            tokens.append(tokens[-1] + n)
        else:
            # as many tokens as a character's share, rounded up over the word, so that a part is never too long by much
            begin, base, m = ends[-1], tokens[-1], len(word)
            for k in range(1, m + 1):
                ends.append(begin + k)
                tokens.append(base + -(-n * k // m))
    return ends, tokens


def _strengths(text: str, ends: list[int], words: set[int]) -> np.ndarray:
    """How strong the boundary at each of ``ends`` is: 10 paragraph, 8 line, 6 sentence, 4 word, 2 between a word and a
    sign, 0 inside a word."""
    runs = {}
    for m in _SPACES.finditer(text):
        run = m.group().replace("\r\n", "\n").replace("\r", "\n")
        lines = run.count("\n") + run.count("\u2028") + 2 * run.count("\u2029")
        before = m.start() - 1
        while before > 0 and text[before] in _CLOSING:
            before -= 1
        strength = 5 if lines > 1 else 4 if lines else 3 if before >= 0 and text[before] in _SENTENCE_END else 2
        # a piece had better begin with a letter than with the end of a line
        runs[m.start()], runs[m.end()] = 2 * strength - (lines > 0), 2 * strength
    get = runs.get
    return np.array([get(p) or (2 if p in words else 0) for p in ends], np.int8)


def cut(text: str, limit: int, overlap: int, own=None) -> list[tuple[int, int, int, int]]:
    """(begin, own_begin, end, n_tokens) of each piece, in places of characters; what lies between begin and own_begin
    also ends the piece before. One piece if the text keeps the limit.

    A part of more tokens than the limit less the overlap is cut at the strongest boundary near its middle, of equal
    ones at the nearest, and so on with its parts. Then each piece but the first gets before it the words that end
    the piece before, as many as the overlap in tokens holds. Each piece is counted by itself; one that
    is over the limit then, as its words split in another way, is cut again. A limit below the tokens of one
    character leaves that character whole.
    """
    own = own or encoder()
    if limit < 1:
        raise ValueError("the limit must be at least one token")
    overlap = max(0, min(overlap, limit - 1))
    parted, lengths = own.word_lengths(text)
    whole = sum(lengths)
    if whole <= limit:
        return [(0, 0, len(text), whole)]
    ends, tokens = _atoms(parted, lengths)
    words, at = set(), 0
    for w in parted:
        words.add(at)
        at += len(w)
    strength = _strengths(text, ends, words)
    tok = np.array(tokens)
    room = limit - overlap

    def halved(i: int, j: int) -> int:
        """The boundary at which to cut the atoms i to j."""
        middle, reach = (tok[i] + tok[j]) / 2, (tok[j] - tok[i]) * REACH
        lo, hi = max(i + 1, bisect_left(tokens, middle - reach)), min(j - 1, bisect_right(tokens, middle + reach) - 1)
        if lo > hi:
            return min(max(bisect_left(tokens, middle), i + 1), j - 1)
        those = strength[lo : hi + 1]
        best = np.flatnonzero(those == those.max())
        return lo + int(best[np.abs(tok[lo + best] - middle).argmin()])

    def counted(i: int, j: int) -> tuple[int, int]:
        """First atom of the overlap before i, and the tokens of all up to j."""
        first = bisect_left(tokens, tokens[i] - overlap) if overlap else i
        return first, own.lengths([text[ends[first] : ends[j]]])[0]

    pieces = []
    parts = [(0, len(ends) - 1)]
    while parts:
        i, j = parts.pop()
        if j - i > 1 and tokens[j] - tokens[i] > room:
            k = halved(i, j)
            parts += [(k, j), (i, k)]
            continue
        first, n = counted(i, j)
        while n > limit and first < i:
            first += 1
            n = own.lengths([text[ends[first] : ends[j]]])[0]
            if i - first <= 1 and n > limit:
                break
        if n > limit and j - i > 1:
            k = halved(i, j)
            parts += [(k, j), (i, k)]
            continue
        if n > limit and first < i:
            first, n = i, own.lengths([text[ends[i] : ends[j]]])[0]
        pieces.append((ends[first], ends[i], ends[j], n))
    return pieces


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder()
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            rows = [[] for _ in range(7)]
            part = batch.slice(lo, 200)
            lengths = own.lengths(part.column("text").to_pylist())
            for doc, text, limit, overlap, n in zip(*(part.column(k).to_pylist() for k in ("doc_id", "text", "max_tokens", "overlap_tokens")), lengths, strict=True):
                if text is None or limit is None or n <= limit:
                    continue
                for no, (begin, own_begin, end, m) in enumerate(cut(text, limit, overlap or 0, own)):
                    for column, value in zip(rows, (doc, no, begin, own_begin, end, m, text[begin:end]), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], ["doc_id", "piece", "begin", "own_begin", "end", "n_tokens", "text"])


def p10_pieces(spark, sf_dir: str) -> DataFrame:
    """(doc_id, piece, begin, own_begin, end, n_tokens, text): the pieces of every document above the token limit of
    its source; those within it, and null texts, have none. A null source, or one without a row of its own, takes
    the row ``default``; without that row its documents have no limit. A null overlap is none."""
    limits = read(spark, sf_dir, "cut_limits").groupBy(source_key("source").alias("source")).agg(F.min("max_tokens").alias("max_tokens"), F.min("overlap_tokens").alias("overlap_tokens"))
    default = lambda c: F.max(F.when(F.col("source") == "default", F.col(c)))
    usual = limits.agg(default("max_tokens").alias("m"), default("overlap_tokens").alias("o"))  # always one row
    docs = read(spark, sf_dir, "documents").select("doc_id", source_key("source").alias("source"), "text")
    with_limit = docs.join(F.broadcast(limits), "source", "left").crossJoin(F.broadcast(usual))
    rows = with_limit.select("doc_id", "text", F.coalesce("max_tokens", "m").alias("max_tokens"), F.coalesce("overlap_tokens", "o").alias("overlap_tokens"))
    return rows.mapInArrow(_pieces, "doc_id bigint, piece int, begin bigint, own_begin bigint, end bigint, n_tokens bigint, text string")
