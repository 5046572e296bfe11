"""Texts read in a wrong character encoding (problem 4): generated garbled sequences, one automaton, spans replaced."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpuscle.llm.common import messages

#: Encodings in which UTF-8 may have been read.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "iso8859-2", "iso8859-15", "mac_roman", "cp437", "cp850", "cp866", "koi8-r")
#: One-byte encodings of other alphabets, and those of Latin letters in which they may have been read.
WRITTEN_AS = ("cp1251", "koi8-r", "iso8859-5", "cp1253", "cp1255")
READ_AS_LATIN = ("cp1252", "latin-1", "mac_roman")
#: What may have been written: the alphabets, signs and symbols of these ranges of code points.
WRITTEN = ((0x80, 0x180), (0x192, 0x193), (0x1A0, 0x1B1), (0x1CD, 0x220), (0x2C6, 0x2DE), (0x370, 0x530), (0x5D0, 0x5EB), (0x600, 0x660), (0x900, 0x980), (0xE00, 0xE60), (0x1E00, 0x1F00), (0x2000, 0x2C00), (0x3000, 0x3100), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xFB00, 0xFB07), (0xFE00, 0xFE10), (0xFF00, 0xFFF0), (0x1F000, 0x1FB00))
#: Texts garbled several times over are mended as often, at most.
ROUNDS = 4
LOST = "�"
_CYRILLIC = regex.compile(r"\p{Cyrillic}")
_MARKS = frozenset("»”“’‘…–—›")
#: How often, in per mille, the letters stand in running text of the alphabet: those above 40.
COMMON = {"cyrillic": frozenset("оеаинтсрвл"), "greek": frozenset("αοιετσνηυρ"), "hebrew": frozenset("יוהלאמרתבש")}


def table(encoding: str) -> list[str]:
    """The character of each byte; a byte without one is read as the control character of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@cache
def automaton() -> ahocorasick.Automaton:
    """All garbled sequences of UTF-8 with what they were, by the encoding they were read in."""
    means: dict[str, dict[str, str]] = {}
    tables = [(e, table(e)) for e in READ_AS]
    for lo, hi in WRITTEN:
        for code in range(lo, hi):
            char = chr(code)
            if unicodedata.category(char) == "Cn":
                continue
            raw = char.encode()
            for name, of in tables:
                means.setdefault("".join([of[b] for b in raw]), {})[name] = char
    made = ahocorasick.Automaton()
    for sequence, by in means.items():
        made.add_word(sequence, (len(sequence), by))
    made.make_automaton()
    return made


def _sure(text: str, start: int, end: int, by: dict[str, str], spans: set[int]) -> bool:
    """Whether a sequence that stands alone can't be correct text: Cyrillic letters beside it that belong to no
    sequence, or the end of a word in capitals with a closing sign, speak for correct text."""
    before, after = text[start - 1 : start], text[end : end + 1]
    if _CYRILLIC.match(text[start]):
        if (before and start - 1 not in spans and _CYRILLIC.match(before)) or (after and end not in spans and _CYRILLIC.match(after)):
            return False
        return True
    return not (text[end - 1] in _MARKS and text[start].isupper() and before.isupper() and not after.isalpha())


def _mended_sequences(text: str) -> str:
    found = [(end - n + 1, end + 1, by) for end, (n, by) in automaton().iter_long(text)]
    if not found:
        return text
    covered = {k for start, end, _ in found for k in range(start, end)}
    found = [f for f in found if _sure(text, *f, covered)]
    covered = {k for start, end, _ in found for k in range(start, end)}
    # sequences of Cyrillic letters prove something only next to each other: a text must have such a run
    cyrillic = [f for f in found if _CYRILLIC.match(text[f[0]])]
    if cyrillic and not any(f[1] in covered or f[0] - 1 in covered or not text[f[1] - 1].isalpha() and text[f[0] - 1 : f[0]].isalpha() for f in cyrillic):
        found = [f for f in found if not _CYRILLIC.match(text[f[0]])]
    votes = Counter(name for _, _, by in found for name in by)
    out, at = [], 0
    for start, end, by in found:
        out += [text[at:start], by[max(by, key=lambda name: (votes[name], -READ_AS.index(name)))]]
        at = end
    return "".join([*out, text[at:]])


@cache
def _letters() -> list[tuple[int, str, dict[str, str], regex.Pattern, regex.Pattern]]:
    """Of each pair of one-byte encodings: how many words prove it, the alphabet, what each garbled letter was, and patterns of a word made of
    such letters only and of one that is long enough to prove something."""
    out = []
    for written in WRITTEN_AS:
        alphabet = {"cp1253": "greek", "cp1255": "hebrew"}.get(written, "cyrillic")
        of = table(written)
        for read in READ_AS_LATIN:
            seen = table(read)
            was = {seen[b]: of[b] for b in range(128, 256) if of[b] != seen[b]}
            letters = "".join(c for c, t in was.items() if t.isalpha())
            word = rf"(?<![\p{{L}}\p{{N}}])[{regex.escape(letters)}]+(?![\p{{L}}\p{{N}}])"
            # where bytes were read as signs more than as letters, as many words again must prove it
            out.append((2 if read != "mac_roman" else 6, alphabet, was, regex.compile(word), regex.compile(word.replace("]+", "]{3,}"))))
    return out


def _mended_letters(text: str) -> str:
    """Words of another alphabet whose bytes were read as Latin letters. Two words of at least three letters, all
    of them outside ASCII, must be there; no language writes such words in a row."""
    best = None
    for least, alphabet, was, word, proof in _letters():
        proofs = proof.findall(text)
        if len(proofs) < least:
            continue
        made = ["".join(was.get(c, c) for c in w) for w in proofs]
        letters = [c for w in made for c in w]
        # capitals only at the beginning or throughout, as written text has them
        cased = sum(w[1:].islower() or w.isupper() for w in made) / len(made)
        good = sum(c.lower() in COMMON[alphabet] for c in letters) / len(letters)
        if cased >= 0.8 and good >= 0.5 and (best is None or good * cased > best[0]):
            best = (good * cased, was, word, proof)
    if best is None:
        return text
    _, was, word, proof = best
    places = [m.span() for m in proof.finditer(text)]
    first, last = places[0][0], places[-1][1]
    # short words count where nothing but signs and blanks parts them from a proven one
    spans, grown = set(places), True
    short = [m.span() for m in word.finditer(text) if m.span() not in spans]
    while grown:
        ends, starts = {e for _, e in spans}, {s for s, _ in spans}
        near = [s for s in short if s not in spans and (any(e <= s[0] and not regex.search(r"[\p{L}\p{N}]", text[e : s[0]]) for e in ends) or any(s[1] <= b and not regex.search(r"[\p{L}\p{N}]", text[s[1] : b]) for b in starts))]
        spans.update(near)
        grown = bool(near)
    inside = set()
    for a, b in spans:
        inside.update(range(a, b))
    # signs between them, as a number sign, were read in the same way
    return "".join(was.get(c, c) if k in inside or first <= k < last and not c.isalpha() else c for k, c in enumerate(text))


def restored(text: str) -> str | None:
    """The original of a garbled text, an empty string if some of its characters are lost for good, and None if it
    isn't garbled. Null-free input of any length; only the spans of garbled sequences change."""
    if text.isascii():
        return None
    if LOST in text:
        return ""
    now = _mended_letters(text)
    for _ in range(ROUNDS):
        mended = _mended_sequences(now)
        if mended == now:
            break
        now = mended
    return None if now == text else "" if LOST in now else now


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if t and (r := restored(t)) is not None:
                ids.append(i)
                texts.append(r)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "restored"])


def p4_restored(spark, sf_dir: str) -> DataFrame:
    """(id, restored): every garbled message once, with its original text, empty where that is lost."""
    return messages(spark, sf_dir).mapInArrow(_restore, "id string, restored string").distinct()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _restore(batches):
        sums = [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() if t else "" for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], ["id", "restored_md5"])


def p4_found(spark, sf_dir: str) -> DataFrame:
    """(id, restored_md5): every garbled message once. Null and empty texts are no cases."""
    return messages(spark, sf_dir).mapInArrow(_digested, "id string, restored_md5 string").distinct()
