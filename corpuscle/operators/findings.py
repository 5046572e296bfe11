"""Findings of all kinds in one schema, the best of each, their memo and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.duplicates import exact_duplicate_clusters
from corpuscle.operators.evidence import ambiguity_candidates, label_error_candidates, shortcut_review_queue
from corpuscle.operators.leakage import leakage_rows
from corpuscle.operators.review import sample_duplicate_rollup
from corpuscle.operators.tables import messages

SCHEMA = ("id", "issue_type", "confidence", "evidence", "recommended_action")
#: Findings of each kind that are submitted.
PER_TYPE = 6
# The order of severities and the decision on each kind.
SEVERITY = {"high": 0, "medium_high": 1, "medium": 2, "low": 3}
DECISIONS = {"exact_duplicate": "duplicate_confirmed", "near_duplicate": "near_duplicate_accepted", "leakage": "leakage_confirmed", "label_error": "likely_label_error", "shortcut": "shortcut_stress_case", "ambiguous": "ambiguous_policy_case"}
MOST_HIGH = 0.75


def _chosen(values: dict, column: str, default) -> F.Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _number(c) -> F.Column:
    return F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit("0"))


def all_findings(spark, sf_dir: str) -> DataFrame:
    """(issue_type, id, o1, o2, o3, confidence, evidence, recommended_action): every finding; o1 to o3 order those of
    a kind, ascending. An id has one finding of a kind, the first."""
    leak = leakage_rows(spark, sf_dir).where("heldout_id is not null").select(F.lit("leakage").alias("issue_type"), F.col("heldout_id").alias("id"), _chosen(SEVERITY, "severity", 9).cast("double").alias("o1"), (-F.coalesce("n_total_train_partners", F.lit(0))).cast("double").alias("o2"), F.round(-F.coalesce("max_similarity", F.lit(0.0)), 6).alias("o3"), F.when(F.col("leakage_type").contains("exact"), "high").otherwise("medium").alias("confidence"), F.concat(_number("n_total_train_partners"), F.lit(" training partners")).alias("evidence"), F.lit("should_fix").alias("recommended_action"))
    exact = exact_duplicate_clusters(spark, sf_dir).select(F.lit("exact_duplicate"), F.col("representative_id"), F.when(F.col("cross_split"), 0.0).otherwise(1.0), (-F.col("cluster_size")).cast("double"), F.lit(0.0), F.lit("high"), F.concat(F.lit("cluster of "), _number("cluster_size")), F.when(F.col("cross_split"), "rebuild_split_by_cluster").otherwise("dedupe_by_cluster"))
    crossed = F.col("n_cross_near_pairs") > 0
    near = sample_duplicate_rollup(spark, sf_dir).where("n_near_pairs > 0").select(F.lit("near_duplicate"), F.col("id"), F.when(crossed, 0.0).otherwise(1.0), (-F.col("n_near_pairs")).cast("double"), -F.coalesce("max_near_similarity", F.lit(0.0)), F.when(F.col("max_near_similarity") >= 0.98, "medium").otherwise("low"), F.concat(_number("n_near_pairs"), F.lit(" accepted pairs")), F.when(crossed & (F.col("split") == "heldout"), "should_fix").otherwise("keep_but_flag"))
    error = label_error_candidates(spark, sf_dir).select(F.lit("label_error"), F.col("id"), -F.col("candidate_score"), F.lit(0.0), F.lit(0.0), F.when(F.col("signal_count") >= 3, "high").otherwise("medium"), F.concat(_number("signal_count"), F.lit(" opposing signals")), F.lit("flag_only_no_relabel"))
    vague = ambiguity_candidates(spark, sf_dir).select(F.lit("ambiguous"), F.col("id"), -F.col("score"), F.lit(0.0), F.lit(0.0), F.lit("low"), F.when(F.col("disagreement"), "models disagree").otherwise("near the boundary"), F.lit("clarify_annotation_policy"))
    short = shortcut_review_queue(spark, sf_dir).select(F.lit("shortcut"), F.col("id"), F.col("place").cast("double"), F.lit(0.0), F.lit(0.0), F.lit("medium"), F.col("reason"), F.lit("keep_but_flag"))
    rows = leak
    for more in (exact, near, error, vague, short):
        rows = rows.union(more)
    names = rows.columns
    first = F.min(F.struct("o1", "o2", "o3", "confidence", "evidence", "recommended_action")).alias("f")
    return rows.groupBy("issue_type", "id").agg(first).select("issue_type", "id", "f.*").select(names)


def finding_counts(spark, sf_dir: str) -> DataFrame:
    """(issue_type, confidence, n): the mix of confidences."""
    return all_findings(spark, sf_dir).groupBy("issue_type", "confidence").agg(F.count("*").alias("n"))


def top_n_per_issue(spark, sf_dir: str) -> DataFrame:
    """(issue_type, place, id, confidence): the six first findings of each kind; of equal ones the smaller id."""
    place = F.row_number().over(Window.partitionBy("issue_type").orderBy("o1", "o2", "o3", "id"))
    return all_findings(spark, sf_dir).withColumn("place", place.cast("bigint")).where(F.col("place") <= PER_TYPE).select("issue_type", "place", "id", "confidence", "evidence", "recommended_action")


def final_findings(spark, sf_dir: str) -> DataFrame:
    """(rank, ...): those findings, ranked through: at most 36 rows."""
    rank = F.row_number().over(Window.orderBy("issue_type", "place")).cast("bigint")
    return top_n_per_issue(spark, sf_dir).withColumn("rank", rank).select("rank", *SCHEMA)


def adjudication_memo(spark, sf_dir: str) -> DataFrame:
    """(claim_id, id, issue_type, public_label, final_decision, final_confidence): a claim for each final finding."""
    labels = messages(spark, sf_dir).select("id", F.col("label").alias("public_label"))
    rows = labels.join(F.broadcast(final_findings(spark, sf_dir)), "id", "right")
    return rows.select(F.concat(F.lit("C"), F.lpad(F.col("rank").cast("string"), 3, "0")).alias("claim_id"), "id", "issue_type", F.coalesce("public_label", F.lit("")).alias("public_label"), _chosen(DECISIONS, "issue_type", "").alias("final_decision"), F.col("confidence").alias("final_confidence"))


def submission_validation(spark, sf_dir: str) -> DataFrame:
    """One row: how many findings and kinds there are, whether each field is filled and few enough are high."""
    rows = final_findings(spark, sf_dir)
    filled = F.lit(True)
    for c in SCHEMA:
        filled = filled & F.coalesce(F.col(c) != "", F.lit(False))
    high = F.avg(F.when(F.col("confidence") == "high", 1.0).otherwise(0.0))
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("issue_type").alias("n_types"), F.round(high, 6).alias("high_fraction"), F.coalesce(F.min(filled), F.lit(True)).alias("all_filled"), (F.coalesce(high, F.lit(0.0)) <= MOST_HIGH).alias("few_enough_high"))
