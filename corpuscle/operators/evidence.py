"""Signals against labels: models, neighbours, and what they single out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators.review import _both_ways
from corpuscle.operators.tables import pairs, predictions

# Neighbours looked at, and when they oppose a label.
NEIGHBOURS, OPPOSE_FRACTION, OPPOSE_SIMILARITY = 5, 0.60, 0.30
# Candidates, watch list, ambiguity.
SIGNALS, WATCH_STRENGTH, BOUNDARY, MIXED = 2, 0.60, 0.18, 0.70


def neighbour_evidence(links: DataFrame, known: DataFrame) -> DataFrame:
    """(id, neighbour_count, opposite_fraction, closest_similarity): of the links (id, partner, partner_label,
    similarity), the five nearest of each id that ``known`` (id, label) holds. Partners of the same text must be left
    out before. Of partners alike the smaller id counts; each counts once. Window ranks stop at five inside each
    task, so an id with very many links is no burden."""
    once = links.groupBy("id", "partner").agg(F.max("similarity").alias("similarity"), F.min("partner_label").alias("partner_label"))
    near = once.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "partner"))).where(F.col("at") <= NEIGHBOURS)
    rows = near.join(known.select("id", "label"), "id")
    mass, opposes = F.greatest("similarity", F.lit(0.0)), F.col("partner_label") != F.col("label")
    return rows.groupBy("id").agg(
        F.count("*").alias("neighbour_count"),
        F.coalesce(F.try_divide(F.sum(F.when(opposes, mass).otherwise(0.0)), F.sum(mass)), F.lit(0.0)).alias("opposite_fraction"),
        F.coalesce(F.max(F.when(opposes, F.col("similarity"))), F.lit(0.0)).alias("closest_similarity"),
    )


def _links(spark, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).where(X.normalized("text_a") != X.normalized("text_b"))
    both = _both_ways(rows)
    other = F.when(F.col("id") == F.col("id_a"), F.col("label_b")).otherwise(F.col("label_a"))
    return both.select("id", "partner", other.alias("partner_label"), F.col("max_cosine").alias("similarity")).where("similarity is not null and id != partner")


def evidence(spark, sf_dir: str) -> DataFrame:
    """The held-out predictions with the signals against their labels. A message without neighbours has no opposing
    ones; one without label or both probabilities gives no evidence."""
    preds = predictions(spark, sf_dir).where("label in ('ham', 'spam') and word_p_spam is not null and char_p_spam is not null")
    rows = preds.join(neighbour_evidence(_links(spark, sf_dir), preds), "id", "left").na.fill(0, ["neighbour_count", "opposite_fraction", "closest_similarity"])
    mean = (F.col("word_p_spam") + F.col("char_p_spam")) / 2
    rows = rows.withColumns(
        {
            "word_opposes": F.coalesce(F.col("word_pred") != F.col("label"), F.lit(False)),
            "char_opposes": F.coalesce(F.col("char_pred") != F.col("label"), F.lit(False)),
            "neighbour_opposes": (F.col("opposite_fraction") >= OPPOSE_FRACTION) & (F.col("closest_similarity") >= OPPOSE_SIMILARITY),
            "mean_p_spam": mean,
            "strength": F.when(F.col("label") == "ham", mean).otherwise(1 - mean),
            "proposed_label": F.when(F.col("label") == "ham", "spam").otherwise("ham"),
        }
    )
    return rows.withColumn("signal_count", F.col("word_opposes").cast("bigint") + F.col("char_opposes").cast("bigint") + F.col("neighbour_opposes").cast("bigint"))


_R = lambda c, name: F.round(c, 6).alias(name)


def knn_label_evidence(spark, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("id", "label", "neighbour_count", _R("opposite_fraction", "opposite_fraction"), _R("closest_similarity", "closest_similarity"), "signal_count", _R("strength", "strength"))


def label_error_candidates(spark, sf_dir: str) -> DataFrame:
    score = F.col("strength") + 0.2 * F.col("signal_count") + 0.2 * F.col("opposite_fraction")
    return evidence(spark, sf_dir).where(F.col("signal_count") >= SIGNALS).select("id", "label", "proposed_label", "signal_count", _R(score, "candidate_score"))


def label_error_watchlist(spark, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).where((F.col("signal_count") == 1) & (F.col("strength") >= WATCH_STRENGTH)).select("id", "label", _R("strength", "strength"))


def ambiguity_candidates(spark, sf_dir: str) -> DataFrame:
    """(id, label, disagreement, boundary_distance, mixedness, score): models disagree, a probability near a half, or
    neighbours of both labels."""
    rows = evidence(spark, sf_dir).withColumns(
        {
            "disagreement": F.coalesce(F.col("word_pred") != F.col("char_pred"), F.lit(False)),
            "boundary_distance": F.abs(F.col("mean_p_spam") - 0.5),
            "mixedness": 1 - F.least(F.abs(F.col("opposite_fraction") - 0.5) * 2, F.lit(1.0)),
        }
    )
    hit = F.col("disagreement") | (F.col("boundary_distance") <= BOUNDARY) | (F.col("mixedness") >= MIXED)
    score = F.greatest(1 - 2 * F.col("boundary_distance"), F.lit(0.0)) + 0.4 * F.col("disagreement").cast("double") + 0.4 * F.col("mixedness")
    return rows.where(hit).select("id", "label", "disagreement", _R("boundary_distance", "boundary_distance"), _R("mixedness", "mixedness"), _R(score, "score"))


#: Rows of the review queue for each reason.
TOP = 15


def shortcut_review_queue(spark, sf_dir: str, shallow: str = "char", full: str = "word") -> DataFrame:
    """(reason, place, id, priority): where a shallow and a full model part, the 15 most telling rows of each of four
    reasons; of equal ones the smaller id first. The shallow model stands in the columns of ``shallow``."""
    s, f, gap = F.col(f"{shallow}_pred"), F.col(f"{full}_pred"), F.col(f"{shallow}_p_spam") - F.col(f"{full}_p_spam")
    ham, spam = F.col("label") == "ham", F.col("label") == "spam"
    rules = (
        ("shallow_false_positive", ham & (s == "spam") & (f == "ham"), gap),
        ("shallow_false_negative", spam & (s == "ham") & (f == "spam"), -gap),
        ("shallow_rescues_full_text_miss", spam & (s == "spam") & (f == "ham"), gap),
        ("both_models_miss_spam", spam & (s == "ham") & (f == "ham"), 1 - F.greatest(f"{shallow}_p_spam", f"{full}_p_spam")),
    )
    reason, priority = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, rule, score in rules:
        reason, priority = F.when(rule, name).otherwise(reason), F.when(rule, score).otherwise(priority)
    rows = predictions(spark, sf_dir).where("word_p_spam is not null and char_p_spam is not null").select("id", reason.alias("reason"), F.round(priority, 6).alias("priority")).where("reason is not null")
    place = F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("priority"), "id"))
    return rows.withColumn("place", place.cast("bigint")).where(F.col("place") <= TOP)
