"""Every query on empty tables, and on null, empty, repeated and very long values beside columns of clashing names."""

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.queries() if n[0] == "p" and n[1].isdigit())
TABLES = ("canonical_sms", "leakage_heldout_rows", "near_pairs", "near_decisions", "documents", "name_lexicon", "mix_targets", "cut_limits")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls in all columns, empty and long texts, a text a third of all rows hold, and columns that the operators
    use as names of their own."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    extra = ["x AS key", "x AS f", "x AS a", "x AS b", "x AS v", "x AS h", "x AS n", "x AS rate", "x AS words", "x AS component", "x AS n_tokens"]
    rows = spark.createDataFrame([("T1", "train", "same text for many of us here"), ("H1", "heldout", "same text for many of us here!"), ("H2", "heldout", ""), ("T2", "train", None), ("T3", "train", "..."), ("T4", "train", "long " * 30_000), ("H4", "heldout", "z" * 60_000), ("U1", None, "A: 1; B: 2; C: 3"), ("U2", None, "C=3|A=1|B=2"), *((f"T{k}", "train", "same text for many of us here") for k in range(100, 140))], "id string, split string, text string")
    wide = rows.selectExpr("*", "CAST(NULL AS string) AS sender_id", "CAST(NULL AS string) AS source", "CAST(NULL AS string) AS label", "CAST(NULL AS bigint) AS uci_row_number", "1 AS x").selectExpr("*", *extra)
    wide.union(wide).write.parquet(f"{folder}/canonical_sms.parquet")
    docs = rows.selectExpr("CAST(crc32(id) AS bigint) AS doc_id", "text", "CASE WHEN id > 'T11' THEN 'raw dump' END AS source", "1 AS x").selectExpr("*", *extra)
    docs.write.parquet(f"{folder}/documents.parquet")
    nulls = {"leakage_heldout_rows": "heldout_id", "near_pairs": "pair_id"}
    for t in TABLES:
        if t not in ("canonical_sms", "documents"):
            table = spark.read.parquet(f"{SMALL}/{t}.parquet")
            blank = table.limit(1).selectExpr(*(f"CAST(NULL AS {k}) AS {c}" for c, k in table.dtypes)) if t in nulls else table.limit(0)
            table.union(blank).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert __spark_entry__.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, awkward, name):
    rows = __spark_entry__.queries()[name](spark, awkward).collect()
    assert len({repr(r) for r in rows}) == len(rows)
    if name == "p3_found":
        assert len(rows) == 42  # 40 copies of T1 besides, H1, and the fields in another order
    if name == "p6_found":
        assert {r["train_id"] for r in rows if r["heldout_id"] == "H1"} == {"T1", *(f"T{k}" for k in range(100, 140))}
    if name == "p8_ids":
        assert len(rows) == 49
    if name == "p1_groups":
        assert len(rows) == 46
