"""The input tables, each id or key once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label(column: str = "label"):
    return F.lower(F.trim(column))


def messages(spark, sf_dir: str) -> DataFrame:
    """(id, split, text, label, uci_row_number): each id once, labels in one spelling. Of what re-deliveries write
    in different ways the smallest counts. A null id is no message."""
    rows = table(spark, sf_dir, "canonical_sms").where("id is not null")
    return rows.groupBy("id").agg(F.min("split").alias("split"), F.min("text").alias("text"), F.min(label()).alias("label"), F.min("uci_row_number").alias("uci_row_number"))


def split_messages(spark, sf_dir: str) -> DataFrame:
    """The messages of the two splits."""
    return messages(spark, sf_dir).where("split in ('train', 'heldout')")


def pairs(spark, sf_dir: str) -> DataFrame:
    """near_pairs with labels in one spelling."""
    return table(spark, sf_dir, "near_pairs").withColumn("label_a", label("label_a")).withColumn("label_b", label("label_b"))


def predictions(spark, sf_dir: str) -> DataFrame:
    """heldout_predictions, each id once; of repeated rows the smallest values count."""
    rows = table(spark, sf_dir, "heldout_predictions").where("id is not null").withColumn("label", label())
    return rows.groupBy("id").agg(*(F.min(c).alias(c) for c in ("split", "uci_row_number", "label", "text", "word_p_spam", "word_pred", "char_p_spam", "char_pred")))


def staged(df: DataFrame, *replaced: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder that all executors share. A local folder serves where none is
    set, but for a local master only. The stages ``replaced`` are deleted afterwards; nothing may read them any more."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
        context.setCheckpointDir(folder)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in replaced:
        gone = context._jvm.org.apache.hadoop.fs.Path(old._stage)
        gone.getFileSystem(context._jsc.hadoopConfiguration()).delete(gone, True)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stage = path
    return made
