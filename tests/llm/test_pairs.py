import re

import __spark_entry__
from corpuscle.llm import near, overlap
from corpuscle.llm.near import pieces


def found(spark, name, folder):
    return sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect())


def test_p2_through_authors_and_references(spark, put):
    rows = [
        ("H1", "heldout", "S000000001", "hello"),
        ("H1", "heldout", "s-000000001", "hello"),
        ("U1", None, "S 000000001", "account AB 12345 6."),
        ("T1", "train", "anon", "see ab12345/6"),
        ("T2", "train", "S000000002", "xAB123456"),
        ("T3", "train", "S000000003", "CD-55555-5 and ef 77777 7"),
        ("T4", "train", None, "EF777777"),
        ("H2", "heldout", "unknown", "GH1111111"),
    ]
    folder = put("canonical_sms", rows, "id string, split string, sender_id string, text string")
    assert found(spark, "p2_found", folder) == [("H1",), ("T1",)]


def test_p3_copies(spark, put):
    rows = [("3", "Hello, World!"), ("1", "hello world"), ("1", "hello world"), ("2", "a: 1; b: 2; c: 3"), ("4", "C=3|A=1|B=2"), ("5", "..."), ("6", "!"), ("7", None), ("8", "x")]
    folder = put("canonical_sms", rows, "id string, text string")
    assert found(spark, "p3_found", folder) == [("1", "3"), ("2", "4")]


def test_p7_groups(spark, put):
    put("leakage_heldout_rows", [(" h1", "T2| t3", "n1; N9"), ("H4", None, ""), ("H5", "T6", None)], "heldout_id string, train_partner_ids string, near_pair_ids string")
    folder = put("near_pairs", [("N1", "T3", "A8"), ("N2", "H4", "T9"), ("n1 ", "T6", "T7")], "pair_id string, id_a string, id_b string")
    groups = {"A8": "A8", "H1": "A8", "T2": "A8", "T3": "A8", "H5": "H5", "T6": "H5", "T7": "H5"}
    assert found(spark, "p7_found", folder) == sorted(groups.items())


TEXTS = [
    ("H1", "heldout", "meet me at the crooked cinema in Cattgarth on Friday"),
    ("T1", "train", "meet me at the crooked cinema in Cattgarth on Monday"),
    ("T1", "train", "meet me at the crooked cinema in Cattgarth on Monday"),
    ("T2", "train", "MEET me at the crooked cinema in Cattgarth, on Friday!"),
    ("T3", "train", "nothing of the kind was ever said about the purple tyre"),
    ("U1", None, "meet me at a crooked cinema in Cattgarth on Sunday"),
    ("H2", "heldout", "..."),
    ("T4", "train", "!"),
]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def expected_pairs():
    rows = sorted({(i, t) for i, _, t in TEXTS if words(t)})
    alike = lambda t, u: len(pieces(words(t)) & pieces(words(u))) >= 0.6 * len(pieces(words(t)) | pieces(words(u)))
    return [(i, j) for i, t in rows for j, u in rows if i < j and "".join(words(t)) != "".join(words(u)) and alike(t, u)]


def test_p1_every_similar_pair(spark, put):
    folder = put("canonical_sms", TEXTS, "id string, split string, text string")
    assert ("H1", "T1") in expected_pairs() and ("H1", "T2") not in expected_pairs()
    assert found(spark, "p1_found", folder) == expected_pairs()


def test_p6_heldout_against_train(spark, put):
    folder = put("canonical_sms", TEXTS, "id string, split string, text string")
    assert found(spark, "p6_found", folder) == [("H1", "T1"), ("H1", "T2")]


def test_p3_both_keys_and_sigma(spark, put):
    rows = [("1", "A: 1; B: 2; C: 3"), ("2", "A: 1, B: 2, C: 3"), ("3", "C: 3; A: 1; B: 2"), ("4", "ΟΔΟΣ ΑΒ"), ("5", "οδοςαβ"), ("6", "ΟΔΟΣΑΒ")]
    folder = put("canonical_sms", rows, "id string, text string")
    assert found(spark, "p3_found", folder) == [("1", "2"), ("1", "3"), ("4", "5"), ("4", "6")]


def far_words():
    """H1 and T1 have twelve frequent long words in common, but each has eight rarer ones of its own that stand in one other text."""
    common = [f"{chr(97 + k) * 3}commonword{k}" for k in range(12)]
    own = [[f"{c}{k}" for k in range(8)] for c in "xy"]
    filler = [(f"T{k:02}{j}", "train", f"{w} {chr(110 + j) * 9}{k}filler") for k, w in enumerate(common) for j in range(3)]
    pair = [("H1", "heldout", " ".join(common + own[0])), ("T1", "train", " ".join(common + own[1]))]
    return [*pair, ("H8", "heldout", " ".join(own[0])), ("T9", "train", " ".join(own[1])), *filler]


def test_p1_every_pair_without_a_rare_word_in_common(spark, put):
    folder = put("canonical_sms", far_words(), "id string, split string, text string")
    with_all = sorted(tuple(r) for r in near.p1_found(spark, folder, every=True).collect())
    assert ("H1", "T1") in with_all and ("H1", "T1") not in found(spark, "p1_found", folder)
    assert {r["id"]: r["class_id"] for r in near.p1_groups(spark, folder, every=True).collect()}["T1"] == "H1"


def test_p6_every_pair_without_a_rare_word_in_common(spark, put):
    folder = put("canonical_sms", far_words(), "id string, split string, text string")
    assert ("H1", "T1") in {tuple(r) for r in overlap.p6_found(spark, folder, every=True).collect()}
    assert ("H1", "T1") not in found(spark, "p6_found", folder)
