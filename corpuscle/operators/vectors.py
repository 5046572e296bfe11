"""TF-IDF vectors and the pairs of texts whose cosine reaches a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators.tables import messages, staged

LEAST_DF, MOST_SHARE, FLOOR = 2, 0.995, 0.88
#: Texts, and terms with their repeats, after which a chunk is full.
CHUNK, CHUNK_TERMS = 1 << 13, 1 << 21
#: A row is the number of its chunk and, in so many bits, its place there.
_PLACE = 24
#: Bytes of a vector's sketch: the lengths of its parts by hash of the term, in 255ths, rounded up.
_PARTS = 32


def word_grams(text: str) -> Column:
    """Words of at least two characters, and pairs of neighbouring ones."""
    words = F.filter(X.tokens(F.replace(F.lower(X.given(text)), F.lit("ς"), F.lit("σ"))), lambda w: F.length(w) >= 2)
    twos = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, twos)


def char_grams(text: str, shortest: int = 3, longest: int = 5) -> Column:
    """Runs of three to five characters inside the words between blanks, each word between two blanks; a word shorter
    than a run stands for itself once."""
    words = F.filter(F.split(F.lower(X.collapsed(text)), " "), lambda w: w != "")

    def cut(word):
        w = F.concat(F.lit(" "), word, F.lit(" "))
        run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))
        runs = [run(n) for n in range(shortest, longest + 1)]
        # a whole word comes once, with the first run that holds it
        fits = [runs[0]] + [F.when(F.length(w) >= n, r).otherwise(F.array().cast("array<string>")) for n, r in zip(range(shortest + 1, longest + 1), runs[1:], strict=True)]
        return F.concat(*fits)

    return F.flatten(F.transform(words, cut))


def tfidf(rows: DataFrame, grams: Column, key: str = "id", most_terms: int | None = None, most_share: float = 1.0) -> DataFrame:
    """(key, term, df, weight): (1 + ln tf) times the smoothed idf, each text's vector of length one. Terms of fewer
    than two texts are left out, those of more than ``most_share`` of them, and beyond the ``most_terms`` most
    frequent, of equal counts the later. A text without a term has no row."""
    counts = rows.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    counts = staged(counts)
    total = staged(rows.agg(F.count("*").alias("n")))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).crossJoin(F.broadcast(total)).where((F.col("df") >= LEAST_DF) & (F.col("df") <= F.lit(most_share) * F.col("n")))
    if most_terms is not None:
        terms = terms.orderBy(F.desc("all"), "term").limit(most_terms)
    raw = counts.join(terms, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", "df", (F.col("w") / F.col("norm")).alias("weight"))


def _representatives(spark, sf_dir: str) -> DataFrame:
    """(id, text) of the smallest id of each normalized text: exact copies are one."""
    rows = messages(spark, sf_dir).where("text is not null")
    return rows.groupBy(X.normalized("text").alias("norm")).agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text")).drop("norm")


def word_weights(spark, sf_dir: str) -> DataFrame:
    return tfidf(messages(spark, sf_dir).where("text is not null"), word_grams("text"), most_share=MOST_SHARE)


def word_tfidf_weights(spark, sf_dir: str) -> DataFrame:
    return word_weights(spark, sf_dir).select("id", "term", F.round("weight", 6).alias("weight"))


def cosine_pairs(vectors: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: all pairs of unit vectors (id, term, df, weight) whose cosine is at least
    ``floor``.

    Terms of a vector stand from rare to frequent. What follows a place where the rest of the vector is shorter than
    the floor cannot reach it alone, so two such vectors share a term before it, in both: only those terms, few
    and rare, meet in the join. Each candidate is then scored on its whole vectors; nothing is left out.
    """
    order = Window.partitionBy("id").orderBy("df", "term")
    rest = 1 - F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = staged(vectors.withColumn("rest", rest))
    first = rows.where(F.col("rest") >= floor * floor - 1e-9).select("id", "term")
    x, y = first.select(F.col("id").alias("id_a"), "term"), first.select(F.col("id").alias("id_b"), "term")
    candidates = staged(x.join(y, "term").where("id_a < id_b").select("id_a", "id_b").distinct())
    whole = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v"))  # a text bounds its vector
    whole = staged(whole)
    both = candidates.join(whole.select(F.col("id").alias("id_a"), F.col("v").alias("va")), "id_a").join(whole.select(F.col("id").alias("id_b"), F.col("v").alias("vb")), "id_b")
    shared = F.array_intersect(F.map_keys("va"), F.map_keys("vb"))
    dot = F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.element_at("va", t) * F.element_at("vb", t))
    return both.select("id_a", "id_b", dot.alias("cosine")).where(F.col("cosine") >= floor)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, terms) one row a chunk: its ids, how many terms each has, the terms as places in the chunk's own
    dictionary, their repeats, the dictionary and how many texts hold each of its terms."""
    names = ["c", "ids", "sizes", "codes", "tf", "terms", "n"]
    first, chunks = TaskContext.get().partitionId() << 19, 0
    held: list[pa.RecordBatch] = []

    def made() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = pa.concat_arrays(rows.column("terms").chunks)
        terms = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        own, code = np.unique(terms, return_inverse=True)
        key, tf = np.unique(row * max(len(own), 1) + code, return_counts=True)
        row, code = key // max(len(own), 1), key % max(len(own), 1)
        listed = lambda x, t: pa.array([x], pa.list_(t))
        columns = [pa.array([first + chunks]), pa.array([rows.column("id").to_pylist()], pa.list_(pa.string())), listed(np.bincount(row, minlength=len(lists)), pa.int32()), listed(code, pa.int32()), listed(tf, pa.int32()), listed(own, pa.int64()), listed(np.bincount(code, minlength=len(own)), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK or sum(len(b.column("terms").flatten()) for b in held) >= CHUNK_TERMS:
            yield made()
            held.clear()
            chunks += 1
    if held:
        yield made()


def _weighted(batch: pa.RecordBatch, k: int, total: int):
    """Of the chunk in row k all (row, term, df, weight) with the terms of a row from rare to frequent."""
    column = lambda name: batch.column(name)[k].values.to_numpy()
    terms, code, tf = column("terms"), column("codes"), column("tf")
    row = np.repeat(np.arange(len(batch.column("sizes")[k])), column("sizes"))
    df = np.zeros(len(terms), np.int64)
    df[column("places")] = column("df")
    kept = df[code] > 0
    row, code, tf = row[kept], code[kept], tf[kept]
    order = np.lexsort((terms[code], df[code], row))
    row, code, tf = row[order], code[order], tf[order]
    w = (1 + np.log(tf)) * (np.log((1 + total) / (1 + df[code])) + 1)
    w /= np.sqrt(np.bincount(row, w * w, len(batch.column("sizes")[k])))[row]
    return row, terms[code], df[code], w


def _first_terms(total: int, floor: float):
    """(term, r, weight, after, parts) of the terms before the place where the rest of a vector is shorter than the
    floor; after is the length of what follows a term, parts the sketch."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, term, _, w = _weighted(batch, k, total)
                sums = np.cumsum(w * w)
                begin = np.searchsorted(row, row)
                before = np.where(begin > 0, sums[begin - 1], 0.0)
                left = 1 - (sums - before)
                kept = left + w * w >= floor * floor - 1e-9
                after = np.sqrt(np.maximum(left, 0) + 1e-9)
                r = (batch.column("c")[k].as_py() << _PLACE) + row
                n = len(batch.column("sizes")[k])
                lengths = np.sqrt(np.bincount(row * _PARTS + term % _PARTS, w * w, n * _PARTS)).reshape(n, _PARTS)
                parts = np.minimum(np.ceil(255 * lengths + 1e-6), 255).astype(np.uint8)[row[kept]]
                sketches = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(np.arange(len(parts) + 1, dtype=np.int32) * _PARTS), pa.py_buffer(parts)])
                yield pa.RecordBatch.from_arrays([pa.array(term[kept]), pa.array(r[kept]), pa.array(w[kept].astype(np.float32)), pa.array(after[kept].astype(np.float32)), sketches], ["term", "r", "w", "after", "parts"])

    return first


def _near_sketches(floor: float):
    """The pairs whose sketches do not keep them below the floor: part by part, no product of two vectors exceeds that
    of their lengths."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _PARTS).astype(np.int64) for c in ("pa", "pb"))
            yield batch.select(["a", "b"]).filter(pa.array((x * y).sum(1) >= (floor - 1e-6) * 255**2))

    return near


def _vectors_of(total: int):
    """(r, id, terms, weights) of the rows of a chunk that ``wanted`` lists, terms ascending."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, term, _, w = _weighted(batch, k, total)
                order = np.lexsort((term, row))
                term, w = term[order], w[order]
                wanted = np.sort(batch.column("wanted")[k].values.to_numpy() & ((1 << _PLACE) - 1))
                lo, hi = np.searchsorted(row, wanted), np.searchsorted(row, wanted, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
                offsets = pa.array(np.concatenate([[0], np.cumsum(hi - lo)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[at])) for x in (term, w)]
                ids = batch.column("ids")[k].values.take(pa.array(wanted))
                yield pa.RecordBatch.from_arrays([pa.array((batch.column("c")[k].as_py() << _PLACE) + wanted), ids, *lists], ["r", "id", "terms", "weights"])

    return of


def _scored(floor: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            columns = (batch.column(c) for c in ("ta", "wa", "tb", "wb"))
            for ta, wa, tb, wb in zip(*columns, strict=True):
                _, i, j = np.intersect1d(ta.values.to_numpy(), tb.values.to_numpy(), assume_unique=True, return_indices=True)
                sums.append(float(wa.values.to_numpy()[i] @ wb.values.to_numpy()[j]))
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sums, pa.float64())], ["a", "b", "cosine"])
            yield rows.filter(pa.array([s >= floor for s in sums], pa.bool_()))

    return score


def near_pairs(texts: DataFrame, grams: Column, floor: float = FLOOR, most_share: float = MOST_SHARE) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: what ``cosine_pairs`` finds in the ``tfidf`` of ``texts`` (id, text), for tables
    whose terms are too many to be shuffled one by one.

    Texts stand in chunks, their terms as places in a dictionary of the chunk, and only dictionaries meet to count
    texts over the table. Terms go by 64-bit hash. Two vectors that reach the floor have a first common term among
    the first of both; with nothing in common before it, its product and the lengths of what follows bound the
    cosine, so pairs that the bound keeps below the floor at a term are dropped there; a bound by sketches follows.
    Each other pair is scored on its whole vectors."""
    hashes = F.transform(grams, lambda t: F.xxhash64(t)).alias("terms")
    chunks = staged(texts.select("id", hashes).mapInArrow(_chunked, "c bigint, ids array<string>, sizes array<int>, codes array<int>, tf array<int>, terms array<bigint>, n array<int>"))
    total = chunks.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    entries = chunks.select("c", F.posexplode(F.arrays_zip("terms", "n")).alias("place", "e")).select("c", "place", "e.terms", "e.n")
    counted = entries.withColumn("df", F.sum("n").over(Window.partitionBy("terms"))).where((F.col("df") >= LEAST_DF) & (F.col("df") <= F.lit(most_share) * total))
    back = counted.groupBy("c").agg(F.collect_list("place").alias("places"), F.collect_list("df").alias("df"))  # no longer than a chunk's dictionary
    known = staged(chunks.drop("n").join(back, "c"), chunks)
    first = staged(known.drop("ids").mapInArrow(_first_terms(total, floor), "term bigint, r bigint, w float, after float, parts binary"))
    x, y = first.toDF("term", "a", "wa", "ra", "pa"), first.toDF("term", "b", "wb", "rb", "pb")
    reach = F.col("wa").cast("double") * F.col("wb") + F.col("ra").cast("double") * F.col("rb")
    met = x.join(y, "term").where((F.col("a") < F.col("b")) & (reach >= floor - 1e-5)).select("a", "b", "pa", "pb")
    found = staged(met.mapInArrow(_near_sketches(floor), "a bigint, b bigint").distinct(), first)
    wanted = found.select(F.explode(F.array("a", "b")).alias("r")).distinct().groupBy(F.shiftright("r", _PLACE).alias("c")).agg(F.collect_list("r").alias("wanted"))
    vectors = staged(known.join(wanted, "c").mapInArrow(_vectors_of(total), "r bigint, id string, terms array<bigint>, weights array<double>"), known)
    both = found.join(vectors.select(F.col("r").alias("a"), F.col("terms").alias("ta"), F.col("weights").alias("wa")), "a").join(vectors.select(F.col("r").alias("b"), F.col("terms").alias("tb"), F.col("weights").alias("wb")), "b")
    scored = both.mapInArrow(_scored(floor), "a bigint, b bigint, cosine double")
    ids = vectors.select("r", "id")
    named = scored.join(ids.toDF("a", "i"), "a").join(ids.toDF("b", "j"), "b")
    return named.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"), "cosine")


def near_pairs_word(spark, sf_dir: str, floor: float = FLOOR) -> DataFrame:
    """(id_a, id_b, cosine): pairs of texts, exact copies by their smallest id, alike in words."""
    return near_pairs(_representatives(spark, sf_dir), word_grams("text"), floor).withColumn("cosine", F.round("cosine", 4))


def near_pairs_char(spark, sf_dir: str, floor: float = FLOOR) -> DataFrame:
    """(id_a, id_b, cosine): pairs of texts, exact copies by their smallest id, alike in runs of characters.

    No query calls it: the 50,000 most frequent runs are each in so many texts that the candidates of 60,000 messages
    outgrew 40 GB of disk. For small tables."""
    return cosine_pairs(tfidf(_representatives(spark, sf_dir), char_grams("text"), most_terms=50_000), floor).withColumn("cosine", F.round("cosine", 4))
