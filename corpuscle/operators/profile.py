"""Profiles of the message table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators.tables import messages, split_messages, table

LABELS = ("ham", "spam")
_FLAGS = {"has_currency": "currency_count > 0", "has_promo": "promo_token_count > 0", "over_160_chars": "char_count > 160"}


def featured(rows: DataFrame) -> DataFrame:
    """``rows`` with the shallow features and the three flags. The largest row number is one number of the whole
    table, joined as a table of one row."""
    last = rows.agg(F.coalesce(F.max("uci_row_number"), F.lit(1)).alias("last_row"))
    wide = rows.crossJoin(F.broadcast(last)).withColumns(X.shallow())
    return wide.withColumns({k: F.expr(v).cast("bigint") for k, v in _FLAGS.items()}).drop("last_row")


def _everything(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row also under the value all of each of ``columns``."""
    for c in columns:
        rows = rows.withColumn(c, F.explode(F.array(F.lit("all"), F.col(c))))
    return rows


def shallow_features(spark, sf_dir: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("avg_token_length", "digit_ratio", "uppercase_ratio", "row_position")}
    return featured(messages(spark, sf_dir)).withColumns(rounded).select("id", *X.FEATURES, *_FLAGS)


def normalize_text(spark, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", X.normalized("text").alias("normalized_text"))


def text_sha256(spark, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", F.sha2(X.given("text"), 256).alias("sha256"))


def mask_promo(spark, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", X.mask_promo("text").alias("masked"))


def mask_cues(spark, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("id", X.mask_cues("text").alias("masked"))


def dataset_validation(spark, sf_dir: str) -> DataFrame:
    """One row: how many rows, ids, splits, row numbers, labels and texts there are, and how many are wanting."""
    rows = table(spark, sf_dir, "canonical_sms")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("id").alias("n_ids"),
        n(F.col("split") == "train").alias("train_rows"),
        n(F.col("split") == "heldout").alias("heldout_rows"),
        n(F.col("split").isNull()).alias("null_splits"),
        n(F.col("uci_row_number").isNull()).alias("null_row_numbers"),
        F.countDistinct("uci_row_number").alias("n_row_numbers"),
        n(F.lower(F.trim("label")).isin(*LABELS)).alias("known_labels"),
        n(F.col("label").isNull()).alias("null_labels"),
        n(F.col("text").isNull()).alias("null_texts"),
        n(F.trim("text") == "").alias("empty_texts"),
        n(~F.coalesce(F.col("id").rlike("^[THU][0-9]+$"), F.lit(False))).alias("odd_ids"),
    )


def artifact_summary(spark, sf_dir: str) -> DataFrame:
    """(artifact_type, n, rate, example_ids): how many messages hold each artifact, with its five first ids."""
    rows = messages(spark, sf_dir)
    total = rows.agg(F.count("*").alias("total"))
    kinds = F.array(*(F.struct(F.lit(k).alias("artifact_type"), X.given("text").rlike(p).alias("hit")) for k, p in X.ARTIFACTS.items()))
    hits = rows.select("id", F.explode(kinds).alias("k")).select("id", "k.*")
    counts = hits.groupBy("artifact_type").agg(F.sum(F.col("hit").cast("bigint")).alias("n"))
    # the first five of each kind are kept in each task before anything is shuffled
    first = hits.where("hit").withColumn("at", F.row_number().over(Window.partitionBy("artifact_type").orderBy("id"))).where("at <= 5")
    ids = first.groupBy("artifact_type").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("example_ids"))
    out = counts.join(ids, "artifact_type", "left").crossJoin(F.broadcast(total))
    return out.select("artifact_type", "n", F.round(F.try_divide("n", "total"), 6).alias("rate"), F.coalesce("example_ids", F.lit("")).alias("example_ids"))


def _rate(c: str):
    return F.round(F.avg(c), 6)


def profile_summary(spark, sf_dir: str) -> DataFrame:
    """Of all, train and held-out and of all, ham and spam: how many, their share of the split, medians and rates."""
    rows = _everything(featured(split_messages(spark, sf_dir).where(F.col("label").isin(*LABELS))), "split", "label")
    q = lambda c, p: F.percentile(c, F.lit(p))
    out = rows.groupBy("split", "label").agg(
        F.count("*").alias("n"),
        q("char_count", 0.5).alias("char_median"),
        q("char_count", 0.25).alias("char_q1"),
        q("char_count", 0.75).alias("char_q3"),
        q("token_count", 0.5).alias("token_median"),
        q("digit_count", 0.5).alias("digit_median"),
        *(_rate(c).alias(f"{c}_rate") for c in ("has_url", "has_phone", "has_currency", "has_promo", "over_160_chars")),
        _rate("promo_token_count").alias("promo_token_mean"),
    )
    share = F.col("n") / F.max("n").over(Window.partitionBy("split"))  # at most nine rows
    return out.withColumn("class_fraction", F.round(share, 6))


def split_comparison(spark, sf_dir: str) -> DataFrame:
    """(label, metric, train, heldout, difference) of eight metrics."""
    rows = featured(split_messages(spark, sf_dir).where(F.col("label").isin(*LABELS))).withColumn("spam", (F.col("label") == "spam").cast("bigint"))
    metrics = {"spam_share": F.avg("spam"), "char_median": F.percentile("char_count", F.lit(0.5)), "token_median": F.percentile("token_count", F.lit(0.5))}
    metrics |= {f"{c}_rate": F.avg(c) for c in ("has_url", "has_phone", "has_currency", "has_promo", "over_160_chars")}
    wide = _everything(rows, "label").groupBy("label", "split").agg(*(v.alias(k) for k, v in metrics.items()))
    long = wide.unpivot(["label", "split"], list(metrics), "metric", "value")
    sides = long.groupBy("label", "metric").pivot("split", ["train", "heldout"]).agg(F.first("value"))
    return sides.select("label", "metric", F.round("train", 6).alias("train"), F.round("heldout", 6).alias("heldout"), F.round(F.col("heldout") - F.col("train"), 6).alias("difference"))


def row_position_bins(spark, sf_dir: str, bins: int = 10) -> DataFrame:
    """(bin, n, spam_rate) of ten bins of equal width over the row numbers; a bound belongs to the lower bin."""
    rows = split_messages(spark, sf_dir).where("uci_row_number is not null")
    ends = rows.agg(F.min("uci_row_number").alias("lo"), F.max("uci_row_number").alias("hi"))
    at = F.ceil((F.col("uci_row_number") - F.col("lo")) * F.lit(bins) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.greatest(F.least(at, F.lit(bins)), F.lit(1)).cast("bigint"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("label") == "spam", 1.0).otherwise(0.0)), 6).alias("spam_rate"))


def length_histogram(spark, sf_dir: str) -> DataFrame:
    """(label, bin, n): lengths in steps of 10, all from 250 on together. A null label is one of its own."""
    rows = split_messages(spark, sf_dir).withColumn("bin", (F.floor(F.least(F.length(X.given("text")), F.lit(250)) / 10) * 10).cast("bigint"))
    return rows.groupBy("label", "bin").agg(F.count("*").alias("n"))


def label_crosstab(spark, sf_dir: str) -> DataFrame:
    """(split, ham, spam, other)."""
    kind = F.when(F.col("label").isin(*LABELS), F.col("label")).otherwise("other")
    return split_messages(spark, sf_dir).withColumn("kind", kind).groupBy("split").pivot("kind", [*LABELS, "other"]).count().na.fill(0)


def feature_prevalence(spark, sf_dir: str) -> DataFrame:
    """(split, label, feature, n, mean, median, q75, nonzero_rate) of the twelve features."""
    rows = featured(split_messages(spark, sf_dir).where(F.col("label").isin(*LABELS)))
    long = rows.select("split", "label", *(F.col(c).cast("double").alias(c) for c in X.FEATURES)).unpivot(["split", "label"], list(X.FEATURES), "feature", "value")
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return long.groupBy("split", "label", "feature").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), q(0.5).alias("median"), q(0.75).alias("q75"), F.round(F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)), 6).alias("nonzero_rate"))


def feature_prevalence_pivot(spark, sf_dir: str) -> DataFrame:
    """(feature, ham, spam): the nonzero rates of the held-out messages."""
    rows = feature_prevalence(spark, sf_dir).where("split = 'heldout'")
    return rows.groupBy("feature").pivot("label", list(LABELS)).agg(F.first("nonzero_rate"))


def mean_features(spark, sf_dir: str) -> DataFrame:
    """(label, four mean rates): means by label."""
    rows = featured(split_messages(spark, sf_dir).where(F.col("label").isin(*LABELS)))
    return rows.groupBy("label").agg(*(_rate(c).alias(c) for c in ("has_url", "has_phone", "has_currency", "has_promo")))


