"""Pairwise matches consolidated into groups by hash-to-min (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import BLANK, read, staged


def _mark(df: DataFrame) -> tuple:
    """Number of rows and a sum over them that changes with them."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of the links of ``edges`` (two columns): root is the smallest node linked with
    it, itself included.

    Hash-to-min: each node sends the members it knows to the smallest of them, and that smallest to each of them,
    until nothing changes. Members stay rows (v, u), so no group, however large, is gathered in one task; the
    number of rounds grows with the logarithm of the longest chain. Null ends link nothing; loops make a group
    of one; repeated links count once; no link gives no row.
    """
    a, b = (F.col(c) for c in edges.columns)
    row = lambda v, u: F.struct(v.alias("v"), u.alias("u"))
    linked = edges.where(a.isNotNull() & b.isNotNull())
    known = staged(linked.select(F.explode(F.array(row(a, b), row(b, a), row(a, a), row(b, b))).alias("e")).select("e.*").distinct())
    before = _mark(known)
    while before[0]:
        least = known.groupBy("v").agg(F.min("u").alias("m"))
        m, u = F.col("m"), F.col("u")
        sent = known.join(least, "v").select(F.explode(F.array(row(m, u), row(u, m))).alias("e")).select("e.*")
        known = staged(sent.distinct(), known)
        if (now := _mark(known)) == before:
            break
        before = now
    return known.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))


def tidy(column: str):
    """An id whatever its case and the blanks around it."""
    return F.upper(F.regexp_replace(column, f"^{BLANK}+|{BLANK}+$", ""))


def listed(column: str):
    """The ids of an untidily written list: any run of letters and digits is one."""
    return F.explode(F.array_distinct(F.filter(F.split(F.upper(F.col(column)), r"[^\p{L}\p{N}]+"), lambda x: x != "")))


def links(spark, sf_dir: str) -> DataFrame:
    """The links (a, b) that the rows of the audit hold: heldout_id with each train partner, and the two ends of
    each pair that some row names. Null and empty lists and unknown pair ids link nothing."""
    rows = read(spark, sf_dir, "leakage_heldout_rows")
    partners = rows.select(tidy("heldout_id").alias("a"), listed("train_partner_ids").alias("b"))
    named = rows.select(listed("near_pair_ids").alias("pair_id")).distinct()
    pairs = read(spark, sf_dir, "near_pairs").select(tidy("pair_id").alias("pair_id"), tidy("id_a").alias("a"), tidy("id_b").alias("b"))
    every = partners.unionByName(pairs.join(named, "pair_id", "left_semi").select("a", "b"))
    return every.where((F.col("a") != "") & (F.col("b") != "")).distinct()


def p7_found(spark, sf_dir: str) -> DataFrame:
    return components(links(spark, sf_dir)).select(F.col("node").alias("id"), F.col("root").alias("group_id"))


def p7_group_sizes(spark, sf_dir: str) -> DataFrame:
    """(members, n_groups): how many groups there are of each size."""
    sizes = components(links(spark, sf_dir)).groupBy("root").agg(F.count("*").alias("members"))
    return sizes.groupBy("members").agg(F.count("*").alias("n_groups"))
