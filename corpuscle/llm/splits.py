"""Splits that keep related messages together (problem 2), by frontier breadth-first components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpuscle.llm.common import messages, staged
from corpuscle.llm.groups import components

#: Two letters, five digits and one more, with or without one blank, hyphen or slash between them.
REFERENCE = r"(?<![\p{L}\p{N}])\p{L}{2}[\p{Z}\x{9}-\x{d}/‐‑-]?\p{Nd}{5}[\p{Z}\x{9}-\x{d}/‐‑-]?\p{Nd}(?![\p{L}\p{N}])"
BETWEEN = r"[\p{Z}\x{9}-\x{d}/‐‑-]"
#: Hashes are cut into so many ranges, whose sizes are summed before the ranges themselves are numbered through.
RANGES = 4096
SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def keys_of(spark, sf_dir: str) -> DataFrame:
    """(id, key): the author and the account references of each message. A re-delivery may spell the sender in
    another way or name another: all count. Null, empty and placeholder senders are no authors."""
    author = F.upper(F.regexp_replace("sender_id", r"[\p{Z}\x{9}-\x{d}‐‑-]+", ""))
    authors = F.when(author.rlike("^S[0-9]{9}$"), F.array(F.concat(F.lit("A"), author))).otherwise(F.array().cast("array<string>"))
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(REFERENCE), F.lit(0)), lambda x: F.concat(F.lit("R"), F.upper(F.regexp_replace(x, BETWEEN, ""))))
    return messages(spark, sf_dir, "sender_id").select("id", F.explode(F.concat(authors, found)).alias("key")).distinct()


def frontier_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of the links (a, b): component is an integer, equal within what is linked.

    Seeds are the nodes whose hash is the least among their neighbours'. All expand at once: each round the nodes
    labelled last send their label to their neighbours. A node without a label takes the least it gets; labels
    that meet at a node form a small graph, whose components, by hash-to-min, merge the seeds. No link, no row.
    """
    way = lambda x, y: edges.select(F.col(x).alias("a"), F.col(y).alias("b"))
    adjacent = staged(way("a", "b").union(way("b", "a")).where("a != b").distinct().repartition("a"))
    order = lambda c: F.struct(F.xxhash64(c), F.col(c))
    around = adjacent.groupBy("a").agg(F.min(order("b")).alias("least"))
    frontier = staged(around.where(order("a") < F.col("least")).select(F.col("a").alias("node"), F.monotonically_increasing_id().alias("label")))
    labelled, rounds = frontier, []
    while True:
        sent = frontier.join(adjacent, frontier["node"] == adjacent["a"]).select(F.col("b").alias("node"), "label").distinct()
        got = staged(sent.join(labelled.withColumnRenamed("label", "own"), "node", "left"))
        fresh = staged(got.where("own is null").groupBy("node").agg(F.min("label").alias("label")))
        rounds.append(got)
        if fresh.isEmpty():
            break
        labelled, frontier = labelled.union(fresh), fresh
    every = rounds[0]
    for got in rounds[1:]:
        every = every.union(got)
    met = every.drop("own").join(labelled.withColumnRenamed("label", "own"), "node").where("own != label").select("own", "label").distinct()
    merged = components(met).toDF("label", "root")
    return staged(labelled.join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("component")))


def related(spark, sf_dir: str) -> DataFrame:
    """(id, component) of every message with an author or reference; those related share their component."""
    rows = staged(keys_of(spark, sf_dir))
    several = rows.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a != z").select("id", "a")
    edges = rows.join(several, "id").where("a != key").select("a", F.col("key").alias("b")).distinct()
    found = frontier_components(edges).withColumnRenamed("node", "key")
    # a key that stands alone is a component of its own: negative, so that it meets no other
    alone = rows.select("key").distinct().join(found, "key", "left_anti").select("key", (-1 - F.monotonically_increasing_id()).alias("component"))
    return staged(rows.join(staged(found.union(alone)), "key").select("id", "component").distinct())


def _split_bits(spark, sf_dir: str) -> DataFrame:
    bit = F.when(F.col("split") == "train", 1).when(F.col("split") == "heldout", 2)
    return messages(spark, sf_dir, "split").select("id", bit.alias("bit")).where("bit is not null").distinct()


def p2_found(spark, sf_dir: str) -> DataFrame:
    """(id): every message with a split that is related to one of the other split."""
    rows = related(spark, sf_dir).join(_split_bits(spark, sf_dir), "id")
    both = rows.groupBy("component").agg(F.bit_or("bit").alias("bits")).where("bits = 3").select("component")
    return rows.join(both, "component").select("id").distinct()


def p2_assigned(spark, sf_dir: str) -> DataFrame:
    """(id, new_split): train, validation and test by 80, 10 and 10 percent, no component in two of them.

    Components stand in order of their hash and each goes where the middle of its messages falls; those with more
    than a fiftieth of all messages stand first, so that a giant one lands in train. A message without author and
    reference is a component of its own. Every id comes once.
    """
    everyone = messages(spark, sf_dir).select("id").distinct()
    mine = related(spark, sf_dir).groupBy("id").agg(F.min("component").alias("component"))
    name = F.coalesce(F.concat(F.lit("c"), F.col("component").cast("string")), F.col("id"))
    rows = staged(everyone.join(mine, "id", "left").select("id", name.alias("component")))
    sizes = staged(rows.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    total = sizes.agg(F.sum("n").alias("total"))
    hashed = sizes.crossJoin(F.broadcast(total)).withColumn("h", F.xxhash64("first"))
    ranged = staged(hashed.withColumn("r", F.when(F.col("n") * 50 > F.col("total"), -1).otherwise(F.pmod(F.shiftrightunsigned("h", 20), F.lit(RANGES))).cast("int")))
    before = ranged.groupBy("r").agg(F.sum("n").alias("m"))  # at most RANGES + 1 rows
    before = before.withColumn("before", F.sum("m").over(W.orderBy("r")) - F.col("m")).drop("m")
    inside = W.partitionBy("r").orderBy("h", "first")
    middle = (F.col("before") + F.sum("n").over(inside) - F.col("n") / 2) / F.col("total")
    placed = ranged.join(F.broadcast(before), "r").withColumn("middle", middle)
    split = F.when(F.col("middle") < SHARES[0][1], SHARES[0][0]).when(F.col("middle") < SHARES[0][1] + SHARES[1][1], SHARES[1][0]).otherwise(SHARES[2][0])
    return rows.join(placed.select("component", split.alias("new_split")), "component").select("id", "new_split")


def p2_shares(spark, sf_dir: str) -> DataFrame:
    """(new_split, n_messages, share): what the assignment reaches."""
    counts = p2_assigned(spark, sf_dir).groupBy("new_split").agg(F.count("*").alias("n_messages"))
    return counts.withColumn("share", F.round(F.col("n_messages") / F.sum("n_messages").over(W.partitionBy()), 6))
