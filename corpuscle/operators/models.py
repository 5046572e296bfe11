"""Logistic models over word grams and shallow features: out-of-fold scores, probes, and what they weigh."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators.leakage import scores
from corpuscle.operators.profile import featured
from corpuscle.operators.tables import split_messages, staged
from corpuscle.operators.vectors import word_grams

SHAPE = ("char_count", "token_count", "avg_token_length", "uppercase_ratio", "exclamation_count")
CONTACT = ("digit_count", "digit_ratio", "currency_count", "has_url", "has_phone", "promo_token_count")
FEATURE_SETS = {"shape_only": SHAPE, "contact_promo_only": CONTACT, "all_shallow": SHAPE + CONTACT, "row_position_only": ("row_position",), "all_shallow_plus_position": (*SHAPE, *CONTACT, "row_position")}
FOLDS, WIDTH, PENALTY = 5, 1 << 16, 4.0


def labelled(spark, sf_dir: str) -> DataFrame:
    return split_messages(spark, sf_dir).where("label in ('ham', 'spam')").withColumn("y", (F.col("label") == "spam").cast("double"))


def _fit(rows: DataFrame):
    """L2 logistic regression of strength 1 / (C n), so that it falls with more rows as in a sum over rows."""
    n = rows.count()
    return LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / (PENALTY * max(n, 1)), standardization=False, maxIter=100).fit(rows) if n else None


def _judged(model, rows: DataFrame, *keep: str) -> DataFrame:
    out = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    return out.withColumn("pred", F.when(F.col("p") >= 0.5, "spam").otherwise("ham")).select(*keep, "label", "p", "pred")


def gram_vectors(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with TF-IDF vectors of the word grams of ``text``, hashed to a fixed width."""
    hashed = HashingTF(inputCol="grams", outputCol="tf", numFeatures=WIDTH).transform(rows.withColumn("grams", word_grams(text)))
    hashed = staged(hashed.select("id", "split", "label", "y", "tf"))
    return IDF(inputCol="tf", outputCol="x", minDocFreq=2).fit(hashed.where("split = 'train'")).transform(hashed).drop("tf")


def word_lr_oof(spark, sf_dir: str) -> DataFrame:
    """The scores of a word model on train, each message judged by a model that has not seen its fold; folds by hash
    of the id."""
    rows = staged(gram_vectors(labelled(spark, sf_dir), "text").where("split = 'train'").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS))))
    parts = None
    for k in range(FOLDS):
        model = _fit(rows.where(F.col("fold") != k))
        if model is not None:
            part = _judged(model, rows.where(F.col("fold") == k), "fold")
            parts = part if parts is None else parts.union(part)
    return scores(parts if parts is not None else rows.withColumn("pred", F.lit("")), "fold")


def _held(rows: DataFrame, condition: str) -> DataFrame:
    model = _fit(rows.where("split = 'train'"))
    return scores(_judged(model, rows.where("split = 'heldout'")).withColumn("condition", F.lit(condition)), "condition")


def shallow_lr_probe(spark, sf_dir: str) -> DataFrame:
    """(condition, scores, warning): models that see only shallow features, on the held-out messages; a warning where
    their accuracy is 0.70 or more."""
    wide = staged(featured(labelled(spark, sf_dir)).na.fill(0.0, ["row_position"]).select("id", "split", "label", "y", *X.FEATURES))
    out = None
    for name, columns in FEATURE_SETS.items():
        raw = VectorAssembler(inputCols=list(columns), outputCol="raw").transform(wide)
        rows = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(raw.where("split = 'train'")).transform(raw)
        part = _held(rows, name)
        out = part if out is None else out.union(part)
    return out.withColumn("warning", F.col("accuracy") >= 0.70)


def masked_lr(spark, sf_dir: str) -> DataFrame:
    """(condition, scores): a word model on whole texts, without promotional words, and with all cues masked."""
    rows = labelled(spark, sf_dir)
    out = None
    for name, text in (("full_text", X.given("text")), ("masked_promo", X.mask_promo("text")), ("masked_cues", X.mask_cues("text"))):
        part = _held(gram_vectors(rows.withColumn("seen", text), "seen"), name)
        out = part if out is None else out.union(part)
    return out


def intervention_metrics(spark, sf_dir: str) -> DataFrame:
    """(condition, scores): a word model on the held-out messages after each change of the training data."""
    from corpuscle.operators.interventions import dedup_components, training_partner_removal, training_partners

    rows = staged(gram_vectors(labelled(spark, sf_dir), "text"))
    gone = {"baseline": None, "remove_leakage_train_partners": training_partner_removal(spark, sf_dir).select("id"), "remove_all_leakage_train_partners": training_partners(spark, sf_dir).select("id"), "duplicate_deduplication": dedup_components(spark, sf_dir).select("id")}
    out = None
    for name, ids in gone.items():
        part = _held(rows if ids is None else staged(rows.join(ids, "id", "left_anti")), name)
        out = part if out is None else out.union(part)
    return out
