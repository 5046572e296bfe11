"""The audit's leakage rows, and scores of frozen predictions with and without leaked messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators.tables import label, predictions, split_messages, table

EXCLUDED = {"original_heldout": "false", "exclude_exact_leakage": "exact", "exclude_exact_and_reviewed_near_leakage": "exact or near"}


def leakage_rows(spark, sf_dir: str) -> DataFrame:
    """leakage_heldout_rows with ids and labels in one spelling; several rows of an id stay several."""
    rows = table(spark, sf_dir, "leakage_heldout_rows")
    return rows.withColumn("heldout_id", F.upper(F.trim("heldout_id"))).withColumn("label", label())


def leakage_summary(spark, sf_dir: str) -> DataFrame:
    """(by, value, n_ids): distinct leaked messages by type, severity and label."""
    kinds = F.create_map(F.lit("leakage_type"), F.col("leakage_type"), F.lit("severity"), F.col("severity"), F.lit("label"), F.col("label"))
    rows = leakage_rows(spark, sf_dir).select("heldout_id", F.explode(kinds).alias("by", "value"))
    return rows.groupBy("by", "value").agg(F.countDistinct("heldout_id").alias("n_ids"))


def leakage_partner_counts(spark, sf_dir: str) -> DataFrame:
    """(heldout_id, n_listed_partners, n_listed_pairs, n_stated, agrees): what the lists of all rows of an id hold, each
    id once, against the largest number stated."""
    rows = leakage_rows(spark, sf_dir)
    both = rows.select("heldout_id", "n_total_train_partners", F.explode_outer(F.concat(F.transform(X.ids_of("train_partner_ids"), lambda x: F.struct(F.lit("t").alias("kind"), x.alias("id"))), F.transform(X.ids_of("near_pair_ids"), lambda x: F.struct(F.lit("p").alias("kind"), x.alias("id"))))).alias("x"))
    count = lambda kind: F.countDistinct(F.when(F.col("x.kind") == kind, F.col("x.id")))
    out = both.groupBy("heldout_id").agg(count("t").alias("n_listed_partners"), count("p").alias("n_listed_pairs"), F.max("n_total_train_partners").alias("n_stated"))
    return out.withColumn("agrees", F.coalesce(F.col("n_listed_partners") == F.col("n_stated"), F.lit(False)))


def leaked(spark, sf_dir: str) -> DataFrame:
    """(id, exact, near): the leaked messages and how."""
    has = lambda word: F.max(F.coalesce(F.col("leakage_type").contains(word), F.lit(False)))
    return leakage_rows(spark, sf_dir).where("heldout_id is not null").groupBy(F.col("heldout_id").alias("id")).agg(has("exact").alias("exact"), has("near").alias("near"))


def scores(rows: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys``: n, accuracy, precision, recall and F1 of spam, macro F1 and the four counts of (label, pred).
    One hash aggregate of four sums; a rate over nothing is 0. Rows without label or prediction count in nothing."""
    known = rows.where("label in ('ham', 'spam') and pred in ('ham', 'spam')")
    n = lambda a, b: F.sum(F.when((F.col("label") == a) & (F.col("pred") == b), 1).otherwise(0)).cast("bigint")
    sums = known.groupBy(*keys).agg(n("spam", "spam").alias("tp"), n("ham", "spam").alias("fp"), n("spam", "ham").alias("fn"), n("ham", "ham").alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total, f1, f0 = tp + fp + fn + tn, X.over(2 * tp, 2 * tp + fp + fn), X.over(2 * tn, 2 * tn + fp + fn)
    return sums.select(*keys, total.alias("n"), F.round(X.over(tp + tn, total), 6).alias("accuracy"), F.round(X.over(tp, tp + fp), 6).alias("spam_precision"), F.round(X.over(tp, tp + fn), 6).alias("spam_recall"), F.round(f1, 6).alias("spam_f1"), F.round((f1 + f0) / 2, 6).alias("macro_f1"), "tp", "fp", "fn", "tn")


def _by_model(rows: DataFrame) -> DataFrame:
    """Each row once for each model, with its prediction as ``pred`` and probability as ``p``."""
    model = lambda m: F.struct(F.lit(m).alias("model"), F.lower(F.trim(f"{m}_pred")).alias("pred"), F.col(f"{m}_p_spam").alias("p"))
    return rows.withColumn("m", F.explode(F.array(model("word"), model("char")))).select("*", "m.*").drop("m")


def classification_metrics(spark, sf_dir: str) -> DataFrame:
    return scores(_by_model(predictions(spark, sf_dir)), "model")


def threshold_agreement(spark, sf_dir: str) -> DataFrame:
    """(model, n, n_agree): how many predictions are spam just where the probability is at least a half."""
    rows = _by_model(predictions(spark, sf_dir)).where("p is not null and pred is not null")
    agrees = (F.col("p") >= 0.5) == (F.col("pred") == "spam")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.sum(agrees.cast("bigint")).alias("n_agree"))


def leakage_metric_sensitivity(spark, sf_dir: str) -> DataFrame:
    """The scores of both models on all held-out messages, without the exactly leaked, and without all leaked."""
    rows = predictions(spark, sf_dir).join(leaked(spark, sf_dir), "id", "left").na.fill(False, ["exact", "near"])
    kept = F.array_compact(F.array(*(F.when(~F.expr(c), F.lit(k)) for k, c in EXCLUDED.items())))
    return scores(_by_model(rows.withColumn("condition", F.explode(kept))), "condition", "model")


def leakage_aware_eval(spark, sf_dir: str) -> DataFrame:
    """(model, side, n, n_correct, accuracy): leaked messages against the others; right answers on leaked ones may be
    remembered."""
    rows = predictions(spark, sf_dir).join(leaked(spark, sf_dir).select("id", F.lit("leaked").alias("side")), "id", "left").na.fill("clean", ["side"])
    rows = _by_model(rows).where("label is not null and pred is not null").withColumn("right", (F.col("label") == F.col("pred")).cast("bigint"))
    return rows.groupBy("model", "side").agg(F.count("*").alias("n"), F.sum("right").alias("n_correct"), F.round(F.avg("right"), 6).alias("accuracy"))


def majority_baseline(spark, sf_dir: str) -> DataFrame:
    """The scores of always giving the label most frequent in train; of equal ones the smaller."""
    rows = split_messages(spark, sf_dir).where("label in ('ham', 'spam')")
    counts = rows.where("split = 'train'").groupBy("label").agg(F.count("*").alias("n"))
    mode = counts.agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("pred"))
    return scores(rows.where("split = 'heldout'").crossJoin(F.broadcast(mode)), "pred")


def prediction_integrity(spark, sf_dir: str) -> DataFrame:
    """One row: predictions that have their message, and those whose text, split or label is the same there."""
    both = predictions(spark, sf_dir).alias("p").join(split_messages(spark, sf_dir).alias("m"), "id", "left")
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    same = lambda c: count(F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}"))).alias(f"same_{c}")
    return both.agg(F.count("*").alias("n"), count(F.col("m.split").isNotNull()).alias("matched"), same("text"), same("split"), same("label"))
