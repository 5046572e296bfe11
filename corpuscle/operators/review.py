"""Reviewed near pairs: queue, decisions and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators.duplicates import _members, heldout_ends
from corpuscle.operators.tables import messages, pairs, predictions, table

THRESHOLD = 0.92


def _oriented(column: str):
    """The stable key of a pair, whatever order its ends are written in."""
    parts = F.split(F.upper(F.trim(column)), r"\|")
    return F.array_join(F.array_sort(F.transform(parts, lambda x: F.trim(x))), "|")


def review_queue(spark, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """(pair_id, key, max_cosine, cross_split): pairs to review: above the threshold and not both held out."""
    both = F.coalesce((F.col("split_a") == "heldout") & (F.col("split_b") == "heldout"), F.lit(False))
    rows = pairs(spark, sf_dir).where((F.col("max_cosine") >= threshold) & ~both)
    return rows.select("pair_id", X.pair_key("id_a", "id_b").alias("key"), F.round("max_cosine", 6).alias("max_cosine"), "cross_split")


def decisions(spark, sf_dir: str) -> DataFrame:
    """near_decisions by the stable key; of several rows of a key the smallest decision counts."""
    rows = table(spark, sf_dir, "near_decisions").where("pair_key is not null").withColumn("key", _oriented("pair_key"))
    return rows.groupBy("key").agg(F.min_by(F.struct("review_decision", "review_category", "confidence"), F.struct("review_decision", "review_category", "confidence")).alias("d")).select("key", "d.*")


def adjudicated(spark, sf_dir: str) -> DataFrame:
    """near_pairs with their decisions; a pair without one needs review."""
    rows = pairs(spark, sf_dir).withColumn("key", X.pair_key("id_a", "id_b"))
    return rows.join(decisions(spark, sf_dir), "key", "left").withColumn("review_decision", F.coalesce("review_decision", F.lit("needs_review")))


def adjudicated_queue(spark, sf_dir: str) -> DataFrame:
    return adjudicated(spark, sf_dir).select("pair_id", "key", "review_decision", "review_category", "confidence")


def review_summary(spark, sf_dir: str) -> DataFrame:
    """(review_decision, pairs, cross_split_pairs, train_train_pairs, unique_heldout_ids, spam_pairs, ham_pairs)."""
    rows = adjudicated(spark, sf_dir)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    both = lambda column, value: (F.col(f"{column}_a") == value) & (F.col(f"{column}_b") == value)
    sums = rows.groupBy("review_decision").agg(F.count("*").alias("pairs"), n(F.col("cross_split")).alias("cross_split_pairs"), n(both("split", "train")).alias("train_train_pairs"), n(both("label", "spam")).alias("spam_pairs"), n(both("label", "ham")).alias("ham_pairs"))
    ids = heldout_ends(rows, "review_decision").distinct().groupBy("review_decision").agg(F.count("*").alias("unique_heldout_ids"))
    return sums.join(ids, "review_decision", "left").na.fill(0, ["unique_heldout_ids"])


def review_counters(spark, sf_dir: str) -> DataFrame:
    """(counter, value, n): pairs by decision, by category and by the two splits."""
    split = F.concat_ws("-", F.coalesce("split_a", F.lit("none")), F.coalesce("split_b", F.lit("none")))
    kinds = F.create_map(F.lit("decision"), F.col("review_decision"), F.lit("category"), F.coalesce("review_category", F.lit("")), F.lit("splits"), split)
    return adjudicated(spark, sf_dir).select(F.explode(kinds).alias("counter", "value")).groupBy("counter", "value").agg(F.count("*").alias("n"))


def _both_ways(rows: DataFrame) -> DataFrame:
    way = lambda a, b: F.struct(F.col(f"id_{a}").alias("id"), F.col(f"id_{b}").alias("partner"))
    return rows.withColumn("way", F.explode(F.array(way("a", "b"), way("b", "a")))).select("*", "way.*").drop("way")


def sample_duplicate_rollup(spark, sf_dir: str) -> DataFrame:
    """(id, split, label, duplicate_type, exact_class, class_members, n_near_pairs, n_near_partners, n_cross_near_pairs,
    max_near_similarity): every message in an exact cluster or an accepted near pair, with counts of its links; the
    exact partners are the members of its class."""
    every = messages(spark, sf_dir)
    exact = _members(every).select("id", F.col("representative_id").alias("exact_class"), F.col("cluster_size").alias("class_members"))
    near = _both_ways(adjudicated(spark, sf_dir).where("review_decision = 'accepted'")).groupBy("id").agg(
        F.countDistinct("pair_id").alias("n_near_pairs"),
        F.countDistinct("partner").alias("n_near_partners"),
        F.countDistinct(F.when(F.col("cross_split"), F.col("pair_id"))).alias("n_cross_near_pairs"),
        F.round(F.max("max_cosine"), 6).alias("max_near_similarity"),
    )
    kind = F.when(F.col("exact_class").isNotNull() & F.col("n_near_pairs").isNotNull(), "exact_and_near_reviewed_accepted").when(F.col("exact_class").isNotNull(), "exact").otherwise("near_reviewed_accepted")
    rows = exact.join(near, "id", "full").join(every.select("id", "split", "label"), "id", "left").withColumn("duplicate_type", kind)
    counts = ["class_members", "n_near_pairs", "n_near_partners", "n_cross_near_pairs"]
    return rows.select("id", "split", "label", "duplicate_type", "exact_class", *counts, "max_near_similarity").na.fill(0, counts)


def near_leakage_cases(spark, sf_dir: str) -> DataFrame:
    """(case_id, heldout_id, train_id, heldout_label, train_label, label_conflict, max_cosine, review_category,
    confidence): accepted pairs across the splits, the held-out end first."""
    rows = adjudicated(spark, sf_dir).where("review_decision = 'accepted'")
    turned = F.when((F.col("split_a") == "heldout") & (F.col("split_b") == "train"), False).when((F.col("split_a") == "train") & (F.col("split_b") == "heldout"), True)
    pick = lambda c, end: F.when(F.col("turned") == (end == "train"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    return rows.withColumn("turned", turned).where("turned is not null").select(
        F.concat(F.lit("L_NEAR_"), "pair_id").alias("case_id"),
        pick("id", "heldout").alias("heldout_id"),
        pick("id", "train").alias("train_id"),
        pick("label", "heldout").alias("heldout_label"),
        pick("label", "train").alias("train_label"),
        F.coalesce(F.col("label_a") != F.col("label_b"), F.lit(False)).alias("label_conflict"),
        F.round("max_cosine", 6).alias("max_cosine"),
        "review_category",
        "confidence",
    )


def heldout_leakage_rollup(spark, sf_dir: str) -> DataFrame:
    """(heldout_id, leakage_type, severity, n_exact_train_partners, n_near_train_partners, near_pair_ids,
    review_categories, max_similarity, word_pred, char_pred): every held-out message with an exact or accepted
    near partner in train. A message without prediction keeps null in its place."""
    from corpuscle.operators.duplicates import exact_leakage_cases

    exact = exact_leakage_cases(spark, sf_dir).select("heldout_id", F.col("n_train_partners").alias("n_exact_train_partners"))
    # a message has as many accepted pairs as reviewers read
    near = near_leakage_cases(spark, sf_dir).groupBy("heldout_id").agg(
        F.countDistinct("train_id").alias("n_near_train_partners"),
        F.array_join(F.array_sort(F.collect_set(F.substring("case_id", 8, 100))), "|").alias("near_pair_ids"),
        F.array_join(F.array_sort(F.collect_set("review_category")), "|").alias("review_categories"),
        F.max(F.when(F.lower("confidence") == "high", 1).otherwise(0)).alias("sure"),
        F.max("max_cosine").alias("max_near"),
    )
    rows = exact.join(near, "heldout_id", "full")
    is_exact, is_near = F.col("n_exact_train_partners").isNotNull(), F.col("n_near_train_partners").isNotNull()
    kind = F.when(is_exact & is_near, "exact_and_near_reviewed_accepted").when(is_exact, "exact").otherwise("near_reviewed_accepted")
    severity = F.when(is_exact, "high").when(F.col("sure") == 1, "medium_high").otherwise("medium")
    preds = predictions(spark, sf_dir).select(F.col("id").alias("heldout_id"), "word_pred", "char_pred")
    out = rows.join(preds, "heldout_id", "left").withColumn("leakage_type", kind).withColumn("severity", severity).withColumn("max_similarity", F.when(is_exact, F.lit(1.0)).otherwise(F.col("max_near")))
    counts, lists = ["n_exact_train_partners", "n_near_train_partners"], ["near_pair_ids", "review_categories"]
    return out.na.fill(0, counts).na.fill("", lists).select("heldout_id", "leakage_type", "severity", *counts, *lists, "max_similarity", "word_pred", "char_pred")


def leakage_top_examples(spark, sf_dir: str) -> DataFrame:
    """(review_category, case_id, heldout_id, train_id, max_cosine): the most alike case of each category."""
    best = F.min_by(F.struct("case_id", "heldout_id", "train_id", "max_cosine"), F.struct(-F.col("max_cosine"), "heldout_id", "train_id", "case_id"))
    return near_leakage_cases(spark, sf_dir).where("review_category is not null and max_cosine is not null").groupBy("review_category").agg(best.alias("b")).select("review_category", "b.*")
