"""What the operators of this subpackage share: reading, staging, words and canonical forms."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A character that no word holds; words are maximal runs of letters and digits.
NO_WORD = r"[^\p{L}\p{N}]+"
#: Blanks of any kind, for patterns of the JVM.
BLANK = r"[\p{Z}\x{9}-\x{d}\x{1c}-\x{1f}\x{85}]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share. Where none is set a local one is made,
    but only for a local master: executors on other machines could not read it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
        context.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, *replaced: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage, and a lost executor loses nothing. The
    stages ``replaced`` are deleted afterwards; nothing may read them any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for old in replaced:
        drop_stage(old)
    made = spark.read.schema(df.schema).parquet(path)
    made._stage = path
    return made


def drop_stage(stage: DataFrame) -> None:
    jvm = stage.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage._stage)
    path.getFileSystem(stage.sparkSession._jsc.hadoopConfiguration() if hasattr(stage.sparkSession, "_jsc") else stage.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files that nothing reads any more go when the driver collects its garbage; this has it do so now, once
    the listeners are through. Each of them holds the plan that ran last, so a plan without shuffles runs before."""
    context = spark.sparkContext
    spark.range(0).toArrow()
    try:
        context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Py4JJavaError:
        pass  # they are busy, so the files stay a while longer
    context._jvm.System.gc()


def messages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The rows of ``canonical_sms``, re-deliveries included: queries take an id once where they group by it, so
    that texts need not be shuffled for it."""
    return read(spark, sf_dir, "canonical_sms").select("id", "text", *more)


def fold_case(text: Column) -> Column:
    """Lower case; a sigma is one letter wherever in a word it stands."""
    return F.replace(F.lower(F.upper(text)), F.lit("ς"), F.lit("σ"))


def canonical(text: Column) -> Column:
    """What is left of ``text`` when case and everything but letters and digits is ignored."""
    return F.regexp_replace(fold_case(text), NO_WORD, "")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "utf-8")))
