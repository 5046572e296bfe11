"""Every query that has SQL, held against it on the smallest of the driver's tables and on a table of awkward rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from corpuscle.plans.queries import QUERIES
from corpuscle.plans.sql import SQL

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


def ours(spark, name, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def theirs(name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    r = con.sql(SQL[name])
    columns = sorted(r.columns)
    at = [r.columns.index(c) for c in columns]
    return columns, sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, name):
    assert ours(spark, name, SMALL) == theirs(name, SMALL)


SMS = "id string, split string, uci_row_number bigint, text string, label string, sender_id string, source string, sent_at timestamp, loaded_at timestamp, key string, term string"
AWKWARD = [
    ("T1", "train", 1, "FREE prize!! Call 07700 900123 or www.a.com £5", " Spam", None, None, None, None, "k", "t"),
    ("T1", "train", 1, "FREE prize!! Call 07700 900123 or www.a.com £5", "spam", None, None, None, None, "k", "t"),
    ("T2", "train", None, "free  prize!! call 07700 900123 or www.a.com £5", None, None, None, None, None, None, None),
    ("H3", "heldout", 3, "\tFREE prize!! Call 07700 900123 or www.a.com £5 ", "ham", None, None, None, None, None, None),
    ("H4", "heldout", 4, "", "ham", None, None, None, None, None, None),
    ("T5", "train", 5, None, "ham", None, None, None, None, None, None),
    ("U6", None, 6, "ΟΔΟΣ ²³ ٣ 你好 café NA null", "HAM", None, None, None, None, None, None),
    ("T7", "train", 7, "οδος ²³ ٣ 你好 CAFÉ na NULL", "ham", None, None, None, None, None, None),
    ("T8", "train", 8, "word " * 20_000, "ham", None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(AWKWARD, SMS).write.parquet(f"{folder}/canonical_sms.parquet")
    for name in ("near_pairs", "near_decisions", "heldout_predictions", "leakage_heldout_rows"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(SQL))
def test_awkward_rows_as_sql(spark, awkward, name):
    assert ours(spark, name, awkward) == theirs(name, awkward)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"word_lr_oof", "shallow_lr_probe", "masked_lr", "intervention_metrics"}))
def test_awkward_rows_without_sql(spark, awkward, name):
    columns, rows = ours(spark, name, awkward)
    assert columns and len(rows) == len(set(rows))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
