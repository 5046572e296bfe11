"""Exact duplicates, and the table of near pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators.tables import messages, pairs, split_messages


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where("text is not null").withColumn("key", F.unhex(F.sha2(X.normalized("text"), 256)))


def _flag(condition) -> F.Column:
    return F.max(F.when(condition, 1).otherwise(0))


def exact_duplicate_clusters(spark, sf_dir: str) -> DataFrame:
    """(representative_id, cluster_size, train_count, heldout_count, cross_split, label_conflict): the clusters of at
    least two messages with the same normalized text, by their smallest id. Null texts are in none; null labels
    conflict with nothing."""
    count = lambda split: F.sum(F.when(F.col("split") == split, 1).otherwise(0)).cast("bigint")
    clusters = _keyed(messages(spark, sf_dir)).groupBy("key").agg(
        F.min("id").alias("representative_id"),
        F.count("*").alias("cluster_size"),
        count("train").alias("train_count"),
        count("heldout").alias("heldout_count"),
        (_flag(F.col("split") == "train") + _flag(F.col("split") == "heldout") == 2).alias("cross_split"),
        F.coalesce(F.min("label") != F.max("label"), F.lit(False)).alias("label_conflict"),
    )
    return clusters.where("cluster_size > 1").drop("key")


def _members(rows: DataFrame) -> DataFrame:
    """(key, representative_id, id, split, label, ...) of what is in a cluster: the clusters are joined back, so that
    no cluster is gathered in a task."""
    keyed = _keyed(rows)
    clusters = keyed.groupBy("key").agg(F.min("id").alias("representative_id"), F.count("*").alias("cluster_size")).where("cluster_size > 1")
    return keyed.join(clusters, "key")


def exact_duplicate_members(spark, sf_dir: str) -> DataFrame:
    """(representative_id, id, split, label): every message of a cluster."""
    return _members(messages(spark, sf_dir)).select("representative_id", "id", "split", "label")


def cluster_size_counts(spark, sf_dir: str) -> DataFrame:
    """(cluster_size, n_clusters)."""
    return exact_duplicate_clusters(spark, sf_dir).groupBy("cluster_size").agg(F.count("*").alias("n_clusters"))


def exact_leakage_cases(spark, sf_dir: str) -> DataFrame:
    """(heldout_id, representative_id, n_train_partners, first_train_id): every held-out message with a copy in train,
    its class and its number of links; the pairs themselves are the class's members."""
    members = _members(split_messages(spark, sf_dir))
    train = members.where("split = 'train'").groupBy("key").agg(F.count("*").alias("n_train_partners"), F.min("id").alias("first_train_id"))
    held = members.where("split = 'heldout'").select("key", F.col("id").alias("heldout_id"), "representative_id")
    return held.join(train, "key").drop("key")


def duplicate_overview(spark, sf_dir: str) -> DataFrame:
    """(metric, value): eight counts over all messages; a message without text is one of its own."""
    rows = messages(spark, sf_dir).agg(F.count("*").alias("total"), F.sum(F.when(F.col("text").isNull(), 1).otherwise(0)).alias("empty"))
    c = exact_duplicate_clusters(spark, sf_dir).agg(
        F.count("*").alias("exact_duplicate_clusters"),
        F.coalesce(F.sum("cluster_size"), F.lit(0)).alias("rows_in_exact_duplicate_clusters"),
        F.coalesce(F.sum(F.col("cross_split").cast("bigint")), F.lit(0)).alias("cross_split_exact_clusters"),
        F.coalesce(F.sum(F.col("label_conflict").cast("bigint")), F.lit(0)).alias("label_conflict_exact_clusters"),
        F.coalesce(F.max("cluster_size"), F.lit(0)).alias("largest_exact_cluster_size"),
    )
    one = rows.crossJoin(c)  # one row each
    repeats = F.col("rows_in_exact_duplicate_clusters") - F.col("exact_duplicate_clusters")
    metrics = {"total_rows": F.col("total"), "normalized_unique_texts": F.col("total") - F.coalesce("empty", F.lit(0)) - repeats, "repeated_rows_beyond_first": repeats}
    metrics |= {m: F.col(m) for m in c.columns}
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("bigint").alias("value")) for m, v in metrics.items()))).alias("e")).select("e.*")


def near_pair_reason_codes(spark, sf_dir: str) -> DataFrame:
    """(pair_id, key, overlap, reason): the stable key of each pair, the share of words in common and the reason."""
    rows = pairs(spark, sf_dir)
    overlap = X.jaccard(X.blank_words("text_a"), X.blank_words("text_b"))
    return rows.select("pair_id", X.pair_key("id_a", "id_b").alias("key"), F.round(overlap, 6).alias("overlap"), X.reason_code(F.col("word_cosine"), F.col("char_cosine")).alias("reason"))


def heldout_ends(rows: DataFrame, *more: str) -> DataFrame:
    """The held-out ends of pairs, one row an end."""
    end = lambda s: F.when(F.col(f"split_{s}") == "heldout", F.col(f"id_{s}"))
    return rows.select(*more, F.explode(F.array_compact(F.array(end("a"), end("b")))).alias("heldout_id"))


THRESHOLDS = (0.88, 0.90, 0.92, 0.94, 0.96)


def near_pairs_sensitivity(spark, sf_dir: str) -> DataFrame:
    """(threshold, candidate_pairs, cross_split_pairs, label_conflict_pairs, unique_heldout_ids, retention) at five
    thresholds. Pairs without a similarity are none; a pair under two ids counts for each."""
    rows = pairs(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS)))).where("max_cosine >= threshold")
    sums = rows.groupBy("threshold").agg(F.count("*").alias("candidate_pairs"), F.sum(F.col("cross_split").cast("bigint")).alias("cross_split_pairs"), F.sum(F.col("label_conflict").cast("bigint")).alias("label_conflict_pairs"))
    ids = heldout_ends(rows.where("cross_split"), "threshold").distinct().groupBy("threshold").agg(F.count("*").alias("unique_heldout_ids"))
    first = F.max("candidate_pairs").over(Window.partitionBy())  # five rows
    out = sums.join(ids, "threshold", "left").withColumn("retention", F.round(F.col("candidate_pairs") / first, 6))
    return out.na.fill(0, ["unique_heldout_ids", "cross_split_pairs", "label_conflict_pairs"])
