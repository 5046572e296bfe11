"""What changes of the training data take away or alter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators.duplicates import _members
from corpuscle.operators.evidence import label_error_candidates
from corpuscle.operators.graph import connected
from corpuscle.operators.leakage import leaked, leakage_rows
from corpuscle.operators.review import adjudicated
from corpuscle.operators.tables import split_messages

#: Most rows an intervention may change, the earliest by row number; None for no limit.
LIMIT: int | None = 30


def earliest(rows: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """The ``limit`` first of ``rows`` (id, uci_row_number) by row number and id; those without a number last. A top-k
    of each task is merged, nothing is sorted in one place."""
    return rows if limit is None else rows.orderBy(F.col("uci_row_number").asc_nulls_last(), "id").limit(limit)


def train(spark, sf_dir: str) -> DataFrame:
    return split_messages(spark, sf_dir).where("split = 'train'")


def training_partners(spark, sf_dir: str) -> DataFrame:
    """(id, uci_row_number): training messages that some leakage row names as a partner."""
    named = leakage_rows(spark, sf_dir).select(F.explode(X.ids_of("train_partner_ids")).alias("id")).where("id like 'T%'").distinct()
    return train(spark, sf_dir).select("id", "uci_row_number").join(named, "id", "left_semi")


def training_partner_removal(spark, sf_dir: str) -> DataFrame:
    """(id, uci_row_number): the earliest of them, which the intervention removes."""
    return earliest(training_partners(spark, sf_dir))


def exclude_leaked_heldout(spark, sf_dir: str) -> DataFrame:
    """(label, n, n_kept): held-out messages by label, and those that are not leaked."""
    rows = split_messages(spark, sf_dir).where("split = 'heldout'").join(leaked(spark, sf_dir).select("id", F.lit(1).alias("hit")), "id", "left")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).cast("bigint").alias("n_kept"))


def dedup_components(spark, sf_dir: str) -> DataFrame:
    """(id, keep_id): the training messages that de-duplication removes, and the one kept of their component: the
    earliest by row number and id. Components are of exact copies and accepted pairs within train."""
    rows = train(spark, sf_dir)
    stars = _members(rows).where("id != representative_id").select(F.col("representative_id").alias("a"), F.col("id").alias("b"))
    accepted = adjudicated(spark, sf_dir).where("review_decision = 'accepted'").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    inside = accepted.join(rows.select(F.col("id").alias("a")), "a", "left_semi").join(rows.select(F.col("id").alias("b")), "b", "left_semi")
    nodes = connected(stars.union(inside.select("a", "b"))).withColumnRenamed("node", "id").join(rows.select("id", "uci_row_number"), "id")
    order = F.struct(F.coalesce("uci_row_number", F.lit(2**62)), F.col("id"))
    kept = nodes.groupBy("root").agg(F.min_by("id", order).alias("keep_id"))
    return nodes.join(kept, "root").where("id != keep_id").select("id", "keep_id")


def dedup_keep_first(spark, sf_dir: str) -> DataFrame:
    """(id, keep_id): training messages whose normalized text an earlier one has."""
    rows = _members(train(spark, sf_dir))
    order = F.struct(F.coalesce("uci_row_number", F.lit(2**62)), F.col("id"))
    kept = rows.groupBy("key").agg(F.min_by("id", order).alias("keep_id"))
    return rows.join(kept, "key").where("id != keep_id").select("id", "keep_id")


def label_overlay(rows: DataFrame, overlay: DataFrame) -> DataFrame:
    """``rows`` with the labels of ``overlay`` (id, overlay_label) where it has one; each id of it once."""
    once = overlay.groupBy("id").agg(F.min("overlay_label").alias("overlay_label"))
    return rows.join(once, "id", "left").withColumn("label", F.coalesce("overlay_label", "label")).drop("overlay_label")


def overlay_effect(spark, sf_dir: str) -> DataFrame:
    """(label, new_label, n): held-out labels before and after the proposals of the label-error candidates."""
    rows = split_messages(spark, sf_dir).where("split = 'heldout'").withColumn("old", F.col("label"))
    proposals = label_error_candidates(spark, sf_dir).select("id", F.col("proposed_label").alias("overlay_label"))
    return label_overlay(rows, proposals).groupBy(F.col("old").alias("label"), F.col("label").alias("new_label")).agg(F.count("*").alias("n"))


def cue_masking(spark, sf_dir: str) -> DataFrame:
    """(id, masked): the earliest training messages that masking changes."""
    rows = train(spark, sf_dir).withColumn("masked", X.mask_cues("text")).where(F.col("masked") != X.given("text"))
    return earliest(rows).select("id", "masked")


def intervention_row_counts(spark, sf_dir: str) -> DataFrame:
    """(intervention, n_rows): training messages that each intervention could change, without its limit, and all that
    some removal takes."""
    sets = {"leakage_partners": training_partners(spark, sf_dir).select("id"), "dedup_components": dedup_components(spark, sf_dir).select("id"), "dedup_keep_first": dedup_keep_first(spark, sf_dir).select("id")}
    named = None
    for name, ids in sets.items():
        part = ids.distinct().withColumn("intervention", F.lit(name))
        named = part if named is None else named.union(part)
    each = named.groupBy("intervention").agg(F.count("*").alias("n_rows"))
    return each.union(named.where("intervention != 'dedup_keep_first'").select("id").distinct().agg(F.lit("combined_removal").alias("intervention"), F.count("*").alias("n_rows")))


def combined_view(spark, sf_dir: str) -> DataFrame:
    """(label, n): the training messages by label that are left when leakage partners and later copies go."""
    gone = training_partners(spark, sf_dir).select("id").union(dedup_components(spark, sf_dir).select("id"))
    return train(spark, sf_dir).join(gone, "id", "left_anti").groupBy("label").agg(F.count("*").alias("n"))


def row_number_of(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank``, 1 to n over all of them without a gap: each task numbers its range of the order, and
    the ranges' sizes, one number a task, tell where it begins."""
    parts = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(before), "part").withColumn("rank", (F.col("before") + inside).cast("bigint")).drop("part", "before")
