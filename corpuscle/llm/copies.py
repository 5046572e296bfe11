"""Messages that differ in formatting only (problem 3), by dictionary-encoded tuples."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import BLANK, canonical, digest, messages, staged
from corpuscle.llm.groups import components

#: What parts fields, and how a field begins: a name of letters and blanks, then a colon or equals sign.
FIELD_END = r"[;|\r\n]+"
FIELD = rf"^{BLANK}*\p{{L}}(?:\p{{L}}|{BLANK})*[:=]"


def canonical_values(texts: DataFrame, but: Column | None = None) -> DataFrame:
    """The rows of ``texts`` with a letter or digit and, as 128-bit digests, their canonical whole value (whole) and
    the sorted tuple of the canonical values of their fields (fields), null unless they consist of at least three.
    The whole values of texts with ``but`` are left to be made elsewhere, and null here."""
    parts = F.filter(F.split("text", FIELD_END), lambda x: x.rlike(f"[^{BLANK[1:-1]}]"))
    has = lambda marks: reduce(or_, (F.col("text").contains(m) for m in marks))
    # most texts lack a mark that fields need, and are not split
    split = texts.where(F.col("text").rlike(r"[\p{L}\p{N}]")).withColumn("parts", F.when(has(":=") & has(";|\r\n"), parts))
    made = (F.size("parts") >= 3) & F.forall("parts", lambda x: x.rlike(FIELD))
    values = F.array_sort(F.transform("parts", lambda x: F.md5(F.encode(canonical(x), "utf-8"))))
    whole = digest(canonical(F.col("text")))
    return split.withColumn("whole", whole if but is None else F.when(~but, whole)).withColumn("fields", F.when(made, digest(F.array_join(values, "")))).drop("parts")


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (whole, fields and others) with ``key`` instead of these two; copies share it."""
    same = rows.where("fields is not null").select("fields", "whole").distinct()
    least = same.groupBy("fields").agg(F.min("whole").alias("least"))
    edges = same.join(least, "fields").where("whole != least").select("whole", "least").distinct()
    roots = components(edges).toDF("whole", "root")
    return rows.drop("fields").join(roots, "whole", "left").withColumn("key", F.coalesce("root", "whole")).drop("whole", "root")


def classes(texts: DataFrame) -> DataFrame:
    """(id, key) of every text (id, text) with a letter or digit, once; copies share ``key``.

    Two texts are copies if their whole canonical values are equal, or their tuples of fields, or both are copies
    of a third. Null, empty and letterless texts are no rows. Values are compared by 128-bit digests, so that texts
    are not shuffled.
    """
    records = staged(canonical_values(texts.select("id", "text")).select("id", "whole", "fields").distinct())
    return staged(keyed(records).distinct(), records)


def p3_found(spark, sf_dir: str) -> DataFrame:
    rows = classes(messages(spark, sf_dir))
    kept = rows.groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(kept, "key").where("id != keep_id").select("keep_id", "id")


def p3_collapsed(spark, sf_dir: str) -> DataFrame:
    """(keep_id, n_copies): one row for each group of copies, with how many there were, itself included."""
    return classes(messages(spark, sf_dir)).groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies")).drop("key")
