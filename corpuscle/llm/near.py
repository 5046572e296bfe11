"""Messages that are small reworkings of one another (problem 1): blocks by rare words, bit-sliced comparison
inside them, exact similarity of what is left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.bitslice import WIDTH, close_pairs
from corpuscle.llm.common import NO_WORD, drop_shuffles, messages, staged
from corpuscle.llm.copies import canonical_values, keyed
from corpuscle.llm.groups import components

#: Every text stands in the blocks of so many of its words, the rarest that are not in it alone.
KEYS = 8
#: Counters for how many texts hold a word, by hash; fixed, so that the table sent to the workers is 4 MB always.
COUNTERS = 1 << 20
#: Blocks with more rows than this are split, and their parts compared pair by pair in tasks of their own.
PART = 4096
#: Rows of blocks that are shuffled at once, for each text and at least; more are compared in several turns, so that disk stays in proportion.
HELD, HELD_LEAST = 5, 1 << 20
_BUFFER = 1 << 16
#: Words of 64 bits of a second, longer sketch, which stays out of the blocks and judges what they let through.
LONGER = 8


def pieces(words) -> set[str]:
    """All three-character pieces of ``words``, each between two blanks."""
    out: set[str] = set()
    for word in words:
        out |= _pieces_of(word)
    return out


_known: dict[str, frozenset] = {}


def _pieces_of(word: str) -> frozenset:
    got = _known.get(word)
    if got is None:
        w = f" {word} "
        got = frozenset(w[i : i + 3] for i in range(len(w) - 2))
        if len(_known) > 200_000:
            _known.clear()
        if len(word) <= 64:
            _known[word] = got
    return got


#: Lower case of ASCII letters and digits; 0 for what no word holds. Other bytes are looked at after that.
_LETTERS = np.array([ord(chr(c).lower()) if c >= 128 or chr(c).isalnum() else 0 for c in range(128)] + [*range(128, 256)], np.uint8)
#: Texts of these characters alone are cut into words over batches: ASCII, letters and signs of Latin 1, punctuation, currencies, pictures.
KNOWN = r"^[\x00-\x7f\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xde\xe0-\xfe\x{2000}-\x{206f}\x{20a0}-\x{20bf}\x{1f300}-\x{1f63f}]*$"
#: Letters and digits of Latin 1 that begin with the byte c2, by their second byte.
_OF_C2 = np.isin(np.arange(256), [0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE])


def _beyond_ascii(low: np.ndarray) -> None:
    """Lower case of the letters and 0 for the signs of KNOWN. Texts with other characters come in lower case and without
    anything but words, and are left as they are."""
    at = np.flatnonzero(low >= 0xC2)
    if not len(at):
        return
    lead, (second, third) = low[at], (np.append(low, [0, 0])[at + k] for k in (1, 2))
    cross = (second == 0x97) | (second == 0xB7)
    low[at[(lead == 0xC3) & (second <= 0x9E) & ~cross] + 1] += 0x20
    two = ((lead == 0xC3) & cross) | ((lead == 0xC2) & (second >= 0x80) & ~_OF_C2[second])
    three = (lead == 0xE2) & ((second == 0x80) | ((second == 0x81) & (third < 0xB0)) | ((second == 0x82) & (third >= 0xA0)))
    four = (lead == 0xF0) & (second == 0x9F) & (third >= 0x8C) & (third <= 0x98)
    for signs, length in ((two, 2), (three, 3), (four, 4)):
        for k in range(length):
            low[at[signs] + k] = 0


def _letters(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, low, inside): where each of ``texts`` begins and the last one ends, their bytes as words hold them, and whether they do."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low = _LETTERS[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if offsets[0] < offsets[-1] else np.zeros(0, np.uint8)
    _beyond_ascii(low)
    return offsets - offsets[0], low, low != 0


def _words(offsets: np.ndarray, low: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """(row, vocabulary, code): for each word of the texts, in order, its row and its number in the vocabulary."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    held = low[inside]
    bounds = np.append(np.cumsum(inside)[starts] - 1, len(held)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(held)).dictionary_encode()
    return np.searchsorted(offsets, starts, "right") - 1, coded.dictionary, coded.indices.to_numpy()


def _whole(whole: pa.BinaryArray, offsets: np.ndarray, low: np.ndarray, inside: np.ndarray) -> pa.BinaryArray:
    """``whole`` with the digests of what words hold of the texts where it is null."""
    missing = np.flatnonzero(whole.is_null().to_numpy(zero_copy_only=False))
    held, ends = memoryview(low[inside]), np.append(0, np.cumsum(inside))[offsets]
    made = [hashlib.md5(held[i:j], usedforsecurity=False).digest() for i, j in zip(ends[missing].tolist(), ends[missing + 1].tolist(), strict=True)]
    return pc.replace_with_mask(whole, whole.is_null(), pa.array(made, pa.binary()))


def _once(numbers: np.ndarray) -> np.ndarray:
    """The sorted numbers without repeats; np.unique goes through a hash table, which is slower here."""
    numbers.sort()
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def _formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts' words, each once, and the sum of their 128-bit hashes, which stands for the set; texts without a
    word are left out. Whole values that the JVM left out are made."""
    for batch in batches:
        letters = _letters(batch.column("text"))
        row, vocabulary, code = _words(*letters)
        if not len(row):
            continue
        row, code = np.divmod(_once(row * len(vocabulary) + code), len(vocabulary))
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, vocabulary.to_pylist())), np.int64).reshape(-1, 2)[code]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), vocabulary.take(pa.array(code)))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(hashes, first)
        kept = batch.set_column(batch.schema.get_field_index("whole"), "whole", _whole(batch.column("whole"), *letters)).take(pa.array(row[first]))
        yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in _OWN), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pc.binary_join(lists, " ")], [*_OWN, "x", "y", "form"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by form and id: each form's number, at its first row its words, at others whether the order of
    the words may be another; rows that repeat the one before are left out."""
    f, last, head = TaskContext.get().partitionId() << 33, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        here = pa.concat_batches([batch.slice(0, 1) if last is None else last, batch])

        def same(c: str, rows=here) -> np.ndarray:
            column = pc.fill_null(rows.column(c), b"") if c == "fields" else rows.column(c)
            return pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)

        old = same("x") & same("y")
        if last is None:
            old[0], head = False, batch.slice(0, 1).column("whole")
        again = old & reduce(np.logical_and, map(same, _OWN)) if last is not None else np.append(False, (old & reduce(np.logical_and, map(same, _OWN)))[1:])
        numbers = f + np.cumsum(~old)
        # the whole value of each form's first row
        heads = pa.concat_arrays([head, batch.column("whole")]).take(pa.array(np.maximum.accumulate(np.where(old, 0, np.arange(1, len(old) + 1)))))
        other = pc.not_equal(heads, batch.column("whole"))
        f, last, head = int(numbers[-1]), batch.slice(len(batch) - 1), heads.slice(len(heads) - 1)
        form = pc.if_else(pa.array(~old), batch.column("form"), pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _OWN), pa.array(numbers), form, other], [*_OWN, "f", "form", "other"]).filter(pa.array(~again))


#: What a message keeps beside its form.
_OWN = ("id", "side", "whole", "fields")
_OWN_TYPES = "id string, side tinyint, whole binary, fields binary"


def forms(texts: DataFrame) -> DataFrame:
    """(id, side, whole, fields, f, form, other) of ``texts`` (id, text, side): those with the same set of lower-cased
    words have the same form f. Of the rows of a form one has ``form``, its words between blanks, and the others
    whether their canonical whole value is another (other). Texts without a letter or digit are no rows."""
    # the JVM knows all letters; what has KNOWN ones only is cut into words, and its whole value made, with the rest, over batches
    plain = F.expr("octet_length(text) = char_length(text) and is_valid_utf8(text)") | F.col("text").rlike(KNOWN)
    cut = F.when(plain, F.col("text")).otherwise(F.regexp_replace(F.lower("text"), NO_WORD, " "))
    known = canonical_values(texts.where("id is not null"), but=plain).select("id", F.col("side").cast("tinyint").alias("side"), "whole", "fields", cut.alias("text"))
    formed = known.mapInArrow(_formed, f"{_OWN_TYPES}, x bigint, y bigint, form string")
    rows = staged(formed.repartition("x").sortWithinPartitions("x", "y", *_OWN).mapInArrow(_numbered, f"{_OWN_TYPES}, f bigint, form string, other boolean"))
    drop_shuffles(rows.sparkSession)
    return rows


def distinct_forms(rows: DataFrame) -> DataFrame:
    """(f, form) of the rows of ``forms``."""
    return rows.where("form is not null").select("f", "form")


def _slot(word: str) -> int:
    """The hash that Spark's xxhash64 gives."""
    return xxhash.xxh64_intdigest(word, 42)


def _slots(vocabulary: pa.StringArray) -> np.ndarray:
    return np.array([_slot(w) for w in vocabulary.to_pylist()], np.uint64).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        _, vocabulary, code = _words(*_letters(batch.column("form")))
        np.add.at(counts, _slots(vocabulary) % COUNTERS, np.bincount(code, minlength=len(vocabulary)))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["s", "n"])


def word_counts(distinct: DataFrame) -> np.ndarray:
    """How many forms hold a word with this hash; a table of fixed size over all forms."""
    rows = distinct.select("form").mapInArrow(_counted, "s int, n bigint").groupBy("s").agg(F.sum("n").cast("int").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.uint32)
    counts[rows["s"].to_numpy()] = rows["n"].to_numpy()
    return counts


_LONGER = [f"s{k}" for k in range(LONGER)]


def _ranked(rows: int, row: np.ndarray, code: np.ndarray, h: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Of each row's words, numbered by ``code`` and with hashes ``h``, those of the KEYS rarest that some other text holds too."""
    c = counts[h % COUNTERS]
    order = np.lexsort((h, c))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    shared = c[code] > 1
    row, rank = np.divmod(np.sort(row[shared] * len(h) + rank[code[shared]]), max(len(h), 1))
    kept = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row] < KEYS
    bounds = np.searchsorted(row[kept], np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h[order[rank[kept]]]))


class _Pieces:
    """Numbers of the pieces met so far, and the bits that they set in the two sketches."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.of_word: dict[str, tuple[int, list[int]]] = {}
        self.short, self.long = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _new(self, piece: str) -> int:
        k = self.number[piece] = len(self.number)
        if k == len(self.short):
            self.short, self.long = (np.concatenate([x, np.zeros_like(x)]) for x in (self.short, self.long))
        h = xxhash.xxh3_64_intdigest(piece)
        self.short[k], self.long[k] = h % WIDTH, (h >> 20) % (64 * LONGER)
        return k

    def of(self, words: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """The hashes of the words and the numbers of their pieces."""
        found = list(map(self.of_word.get, words))
        for at, got in enumerate(found):
            if got is None:
                word = words[at]
                found[at] = got = _slot(word), [k if (k := self.number.get(p)) is not None else self._new(p) for p in _pieces_of(word)]
                if len(word) <= 64:
                    self.of_word[word] = got
        slots, held = zip(*found, strict=True) if found else ((), ())
        return np.array(slots, np.uint64).view(np.int64), held

    def bounded(self) -> None:
        if len(self.number) > 1_000_000 or len(self.of_word) > 200_000:
            self.__init__()


def _set_bits(rows: int, row: np.ndarray, bit: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(rows * width, np.uint8)
    bits[row * width + bit] = 1
    return np.packbits(bits.reshape(rows, width), axis=1, bitorder="little")


def _posted(table):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Pieces()
        for batch in batches:
            known.bounded()
            rows = batch.num_rows
            row, vocabulary, code = _words(*_letters(batch.column("form")))
            slots, held = known.of(vocabulary.to_pylist())
            keys = _ranked(rows, row, code, slots, table.value)
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            flat, begins = np.fromiter(chain.from_iterable(held), np.int64, lengths.sum()), np.cumsum(lengths) - lengths
            n = lengths[code]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begins[code], n)
            pair = _once(np.repeat(row, n) << 32 | flat[at])
            r, k = pair >> 32, pair & 0xFFFFFFFF
            sketch = _set_bits(rows, r, known.short[k], WIDTH)
            longer = _set_bits(rows, r, known.long[k], 64 * LONGER).view(np.int64)
            sketches = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * (WIDTH // 8)), pa.py_buffer(sketch)])
            yield pa.RecordBatch.from_arrays([batch.column("f"), pa.array(np.bincount(r, minlength=rows), pa.int32()), batch.column("side"), sketches, keys, *(pa.array(longer[:, k].copy()) for k in range(LONGER))], ["f", "n", "side", "sketch", "keys", *_LONGER])

    return post


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates from rows sorted by block. A block in parts holds only pairs across its two parts; the
    parts' own pairs have a block of their own."""
    rest: pa.RecordBatch | None = None

    def compared(rows: pa.RecordBatch):
        block, part, f, n, side = (rows.column(k).to_numpy() for k in ("block", "part", "f", "n", "side"))
        sketch = np.frombuffer(rows.column("sketch").buffers()[2], np.uint8, len(f) * (WIDTH // 8), rows.column("sketch").offset * (WIDTH // 8)).reshape(-1, WIDTH // 8) if len(f) else np.zeros((0, WIDTH // 8), np.uint8)
        group = np.cumsum(np.concatenate([[False], block[1:] != block[:-1]]), dtype=np.int64)
        for a, b in close_pairs(group, n.astype(np.int64), side.astype(np.uint8), sketch, part):
            keep = f[a] != f[b]
            keep &= 4 * np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) <= n[a].astype(np.int64) + n[b]
            a, b = a[keep], b[keep]
            if len(a):
                pairs = np.unique(np.stack([np.minimum(f[a], f[b]), np.maximum(f[a], f[b])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        if rest.num_rows >= _BUFFER:
            key = rest.column("block").to_numpy()
            ends = np.flatnonzero(key[1:] != key[:-1])
            if len(ends):
                cut = int(ends[-1]) + 1
                yield from compared(pa.concat_batches([rest.slice(0, cut)]))
                rest = pa.concat_batches([rest.slice(cut)])
    if rest is not None and rest.num_rows:
        yield from compared(rest)


def _turns(texts: int, blocks: int, more: int) -> int:
    """In how many turns the blocks are compared, if a text stands in so many of them and ``more`` rows come from parts."""
    return max(1, -(-(texts * blocks + more) // max(HELD * texts, HELD_LEAST)))


def candidates(distinct: DataFrame, sides: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(a, b), a < b: forms in one block whose sketches, short and long, are near enough. ``sides`` (f, side) restricts to pairs of
    which one has bit 1 and the other bit 2; without it any two forms are a pair.

    Blocks lose a pair that has none of its KEYS rarest words in common. With ``every`` all forms are one block, in
    parts: sizes and sketches only drop pairs that cannot be similar, so nothing is lost, at quadratic cost."""
    table = distinct.sparkSession.sparkContext.broadcast(word_counts(distinct))
    sided = distinct.withColumn("side", F.lit(3).cast("tinyint")) if sides is None else distinct.join(sides, "f")
    posted = staged(sided.mapInArrow(_posted(table), "f bigint, n int, side tinyint, sketch binary, keys array<bigint>, " + ", ".join(f"{s} bigint" for s in _LONGER)))
    blocks = F.lit(0).cast("bigint") if every else F.explode("keys")
    rows = posted.select(blocks.alias("h"), "f", "n", "side", "sketch")
    # of the blocks only those too large for a task are listed; they are few, as each holds more than PART rows
    large = staged(rows.groupBy("h").agg(F.count("*").alias("rows")).where(F.col("rows") > PART).withColumn("g", F.ceil(F.col("rows") / PART).cast("int")))
    parted = rows.join(large.select("h", "g"), "h", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("f"), "g").cast("int"))
    turns = _turns(posted.count(), 1 if every else KEYS, large.agg(F.sum(F.col("rows") * (F.col("g") - 1))).first()[0] or 0)
    found = []
    for turn in range(turns):
        drop_shuffles(distinct.sparkSession)
        # whole blocks, or of those in parts whole pairs of parts
        now = lambda *c, turn=turn: F.pmod(F.xxhash64(*c), F.lit(turns)) == turn
        spread = parted.where((F.col("g") > 1) | now("h")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        met = spread.withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o")}).where((F.col("g") == 1) | now("h", "i", "j"))
        # one number stands for block and parts, as Spark sorts by one fastest; where two fall together, more pairs are compared
        block = F.when(F.col("g") == 1, F.col("h")).otherwise(F.xxhash64("h", "i", "j")).alias("block")
        part = F.when(F.col("i") == F.col("j"), 0).when(F.col("c") == F.col("i"), 1).otherwise(2).cast("tinyint").alias("part")
        tasks = met.select(block, part, "f", "n", "side", "sketch").repartition("block").sortWithinPartitions("block")
        found.append(staged(tasks.mapInArrow(_blocks, "a bigint, b bigint")))
    drop_shuffles(distinct.sparkSession)
    pairs = reduce(DataFrame.union, found).distinct()
    end = lambda e: posted.select(F.col("f").alias(e), F.col("n").alias(f"n{e}"), *(F.col(s).alias(f"{e}{s}") for s in _LONGER))
    apart = reduce(lambda d, s: d + F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))), _LONGER, F.lit(0))
    return staged(pairs.join(end("a"), "a").join(end("b"), "b").where(4 * apart <= F.col("na") + F.col("nb")).select("a", "b"), *found, posted, large)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_c, keep = [], []
        for x, y in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True):
            p, q = pieces(x.split(" ")), pieces(y.split(" "))
            common = len(p & q)
            keep.append(8 * common >= 3 * (len(p) + len(q)))
            out_c.append(common / (len(p) + len(q) - common))
        kept = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out_c, pa.float64())], ["a", "b", "similarity"])
        yield kept.filter(pa.array(keep, pa.bool_()))


def similar_forms(distinct: DataFrame, sides: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(a, b, similarity), a < b: the forms with similarity at least 0.6, each pair compared on its whole sets."""
    found = candidates(distinct, sides, every)
    drop_shuffles(distinct.sparkSession)
    x, y = distinct.select(F.col("f").alias("a"), F.col("form").alias("xs")), distinct.select(F.col("f").alias("b"), F.col("form").alias("ys"))
    return staged(found.join(x, "a").join(y, "b").select("a", "b", "xs", "ys").mapInArrow(_verified, "a bigint, b bigint, similarity double"), found)


def _compared(spark, sf_dir: str, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, f, key), (f), (a, b, similarity)) of the messages; of (f) the texts may have their words in different orders."""
    rows = forms(messages(spark, sf_dir).withColumn("side", F.lit(3)))
    orders = rows.where("other").select("f").distinct()
    similar = similar_forms(distinct_forms(rows), every=every)
    return staged(keyed(rows.select("id", "f", "whole", "fields"))), orders, similar


def p1_found(spark, sf_dir: str, every: bool = False) -> DataFrame:
    """(id_a, id_b): every pair of messages with similarity at least 0.6 that are no copies. Null, empty and
    letterless texts pair with nothing; a re-delivered id counts once. Without ``every`` pairs that have none of
    their rarest words in common are wanting."""
    ids, orders, similar = _compared(spark, sf_dir, every)
    ways = similar.select("a", "b").union(orders.select(F.col("f").alias("a"), F.col("f").alias("b")))
    x, y = ids.select("id", "f", "key").toDF("i", "a", "k"), ids.select("id", "f", "key").toDF("j", "b", "l")
    pairs = ways.join(x, "a").join(y, "b").where("k != l and (a != b or i < j)")
    return pairs.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def p1_groups(spark, sf_dir: str, every: bool = False) -> DataFrame:
    """(id, class_id, n_links): every message with a letter or digit, the smallest id of the class it belongs to by
    copies and similar messages, and with how many other texts it is linked directly."""
    ids, _, similar = _compared(spark, sf_dir, every)
    both = similar.select("a", "b").union(similar.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n_links = both.groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "f")
    # every form is linked with the smallest one of each class of copies that it has a text of
    least = ids.groupBy("key").agg(F.min("f").alias("w"))
    edges = ids.join(least, "key").select(F.col("f").alias("v"), "w").union(similar.select("a", "b")).distinct()
    roots = components(edges).toDF("f", "root")
    rows = staged(ids.select("id", "f", "key").distinct().join(n_links, "f", "left").join(roots, "f").select("id", "root", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    names = rows.groupBy("root").agg(F.min("id").alias("class_id"))
    return rows.join(names, "root").select("id", "class_id", "n_links")
