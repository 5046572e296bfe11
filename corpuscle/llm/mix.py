"""Mixing sources to target weights (problem 9), by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import BLANK, read, staged
from corpuscle.llm.tokens import encoder

#: Newton's steps end when every source is this near to its tokens, as a share of them.
CLOSE = 1e-6
STEPS = 50
#: Documents of a source are numbered through in blocks by size and hash, so many of each size.
BLOCKS = 64


def source_key(column: str) -> Column:
    """One spelling for a source, whatever its case, blanks, hyphens and underscores."""
    return F.lower(F.regexp_replace(F.regexp_replace(column, f"^{BLANK}+|{BLANK}+$", ""), f"(?:{BLANK}|[-_])+", "_"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = encoder()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            n = own.lengths(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])


def token_counts(spark, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; a null or empty text has no tokens."""
    docs = read(spark, sf_dir, "documents").select("doc_id", source_key("source").alias("source"), "text")
    return docs.mapInArrow(_counted, "doc_id bigint, source string, n_tokens bigint")


def targets(spark, sf_dir: str) -> list[tuple[str, float, int]]:
    """(source, share, repeats) of each source asked for: a fixed table of a few rows."""
    rows = read(spark, sf_dir, "mix_targets").groupBy(source_key("source").alias("s")).agg(F.sum("target_share"), F.min("max_repeats")).where("s is not null").collect()
    return sorted((r[0], float(r[1]), int(r[2])) for r in rows)


def _by_source(values: dict, default=None) -> Column:
    """The value of each source, as an expression over the column ``source``."""
    out = F.lit(default).cast("double")
    for source, value in values.items():
        out = F.when(F.col("source") == source, F.lit(float(value))).otherwise(out)
    return out


def _rate(tilt: dict, repeats: dict) -> Column:
    """Rate of a document: the exponential of its source's tilt times its size, at most the repeats allowed."""
    return F.exp(F.least(_by_source(tilt, 0.0) * F.col("size"), F.log(_by_source(repeats, 1.0))))


def balanced(docs: DataFrame, goals: list[tuple[str, float, int]], total: float | None = None) -> tuple[DataFrame, dict, float]:
    """(docs with ``rate``, the tokens wanted of each source, total): rates that give each source its share.

    Entropy balancing: of all rates that meet the token constraints, those of the least relative entropy to one of
    each document. They are exp(tilt * size), the tilt being the dual variable of the source and size the tokens of
    the document over the mean, cut off at the repeats allowed. The dual is convex; each of Newton's steps takes its
    gradient and curvature as sums over all documents, one distributed aggregate for all sources, and is kept
    inside the bracket found so far.

    ``total`` is the size of the mix in tokens; None takes the largest at which no source that has documents needs
    more than its repeats. A source that cannot hold its share of a given total is taken as often as allowed, and
    one without documents stays empty.
    """
    repeats = {s: r for s, _, r in goals}
    sums = {r["source"]: (float(r["t"]), float(r["m"])) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.avg("n_tokens").alias("m")).collect()}
    there = {s: share for s, share, r in goals if s in sums and share > 0 and r > 0}
    docs = docs.where(F.col("source").isin(list(there))) if there else docs.where("false")
    if not there:
        return docs.withColumn("rate", F.lit(0.0)), {}, 0.0
    whole = sum(there.values())
    feasible = min(repeats[s] * sums[s][0] * whole / share for s, share in there.items())
    total = feasible if total is None else float(total)
    wanted = {s: share / whole * total for s, share in there.items()}
    sized = docs.withColumn("size", F.col("n_tokens") / _by_source({s: sums[s][1] for s in there}, 1.0))
    full = {s for s in there if wanted[s] >= repeats[s] * sums[s][0] * (1 - CLOSE)}
    low, high, tilt = dict.fromkeys(there, -60.0), dict.fromkeys(there, 60.0), {s: 60.0 if s in full else 0.0 for s in there}
    open_ = set(there) - full
    for _ in range(STEPS):
        if not open_:
            break
        rate = _rate(tilt, repeats)
        free = F.when(_by_source(tilt, 0.0) * F.col("size") < F.log(_by_source(repeats, 1.0)), rate * F.col("n_tokens") * F.col("size")).otherwise(0.0)
        now = {r["source"]: (r["g"], r["h"]) for r in sized.where(F.col("source").isin(list(open_))).groupBy("source").agg(F.sum(rate * F.col("n_tokens")).alias("g"), F.sum(free).alias("h")).collect()}
        for s in list(open_):
            g, h = now[s]
            if abs(g - wanted[s]) <= CLOSE * wanted[s]:
                open_.discard(s)
                continue
            low[s], high[s] = (tilt[s], high[s]) if g < wanted[s] else (low[s], tilt[s])
            # Newton's step on the logarithm of the tokens, which is nearly linear in the tilt
            step = tilt[s] + math.log(wanted[s] / g) * g / h if h > 0 else math.inf
            tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    rate = F.when(F.col("source").isin(list(full)), _by_source(repeats, 1.0)).otherwise(_rate(tilt, repeats)) if full else _rate(tilt, repeats)
    return sized.withColumn("rate", rate), wanted, total


def rounded(docs: DataFrame, repeats: dict) -> DataFrame:
    """``docs`` with ``copies``: the rates made whole so that the copies of a source differ from the sum of its rates
    by less than one, sizes mixed evenly. Documents stand in blocks by size and hash; the running sum of rates goes
    over the blocks, a small table, and then inside each."""
    placed = docs.withColumn("block", (F.floor(F.log2(F.col("n_tokens") + 1) * 2) * BLOCKS + F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS))).cast("int"))
    sums = placed.groupBy("source", "block").agg(F.sum("rate").alias("w"))
    before = sums.withColumn("before", F.sum("w").over(Window.partitionBy("source").orderBy("block")) - F.col("w")).drop("w")
    inside = Window.partitionBy("source", "block").orderBy("n_tokens", "doc_id")
    upto = F.col("before") + F.sum("rate").over(inside)
    copies = F.least(F.floor(upto + 0.5) - F.floor(upto - F.col("rate") + 0.5), _by_source(repeats, 0.0)).cast("bigint")
    return placed.join(before, ["source", "block"]).withColumn("copies", copies).drop("block")


def mixed(spark, sf_dir: str, total: float | None = None) -> tuple[DataFrame, list, dict]:
    goals = targets(spark, sf_dir)
    docs = staged(token_counts(spark, sf_dir).where("n_tokens > 0 and source is not null"))
    with_rate, wanted, _ = balanced(docs, goals, total)
    return staged(rounded(with_rate, {s: r for s, _, r in goals})), goals, wanted


def p9_mix(spark, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix and how often each is used. Texts without a
    token, and sources that are null or not asked for, are not in it."""
    return mixed(spark, sf_dir)[0].where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def p9_shares(spark, sf_dir: str) -> DataFrame:
    """(source, target_share, reached_share, wanted_tokens, n_tokens, n_documents, most_copies): what the mix holds of
    each source asked for, also of those without documents."""
    rows, goals, wanted = mixed(spark, sf_dir)
    asked = spark.createDataFrame([(s, share, float(wanted.get(s, 0.0))) for s, share, _ in goals], "source string, target_share double, wanted_tokens double")
    held = rows.where("copies > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"))
    out = asked.join(F.broadcast(held), "source", "left").na.fill(0, ["n_tokens", "n_documents", "most_copies"])
    return out.withColumn("reached_share", F.coalesce(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy())), F.lit(0.0)))
