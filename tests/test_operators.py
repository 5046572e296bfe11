"""Operators that SQL expresses badly, held against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators import interventions, vectors
from corpuscle.operators.graph import connected
from corpuscle.sources import files

PROMO = re.compile(r"\b(?:" + "|".join(X.PROMO) + r")\b", re.I)


def masked(text):
    out = re.sub(r"(?:https?://|www\.|\b\w+\.(?:com|co\.uk|net|org)\b)", " URL_TOKEN ", text, flags=re.I)
    out = re.sub(r"(?<!\d)(?:\+?\d[\d\s().-]{6,}\d)(?!\d)", " PHONE_TOKEN ", out)
    out = re.sub(rf"(?:[$]|\b(?:{X.MONEY_CUES})\b)", " MONEY_TOKEN ", out, flags=re.I)
    out = re.sub(r"\b\d[\d\s()./-]{1,}\b", " NUMBER_TOKEN ", out)
    return " ".join(PROMO.sub(" PROMO_TOKEN ", out).split())


TEXTS = ["Call 07700-900123 now, FREE 2 win £100 at www.x.com", "pay 100 pounds 150ppm to a.co.uk", "12/05 at 5pm, 3 of 4", "freedom", "", "win", "x" * 5000 + " 12345 ", "école.com, 1.50 GBP (020) 7946 0000"]


def test_masks_as_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = rows.select(X.mask_cues("text"), X.mask_promo("text")).collect()
    assert [tuple(r) for r in got] == [(masked(t), PROMO.sub(" PROMO_TOKEN ", t)) for t in TEXTS]


def test_clip(spark):
    rows = spark.createDataFrame([("a  b",), ("x" * 50,), (None,)], "text string")
    assert [r[0] for r in rows.select(X.clip("text", 10)).collect()] == ["a b", "x" * 7 + "...", ""]


@pytest.mark.parametrize("links", [[], [(None, 1)], [(3, 3)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 300)] + [(500, 501), (501, 500)]])
def test_connected_as_union_find(spark, links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {tuple(r) for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {(x, find(x)) for x in list(parent)}


def test_row_numbers_have_no_gap(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = interventions.row_number_of(rows, "k", "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def char_wb(text):
    out = Counter()
    for word in " ".join(text.lower().split()).split(" "):
        w = f" {word} "
        for n in (3, 4, 5):
            if n > 3 and len(w) < n:
                break
            out.update(w[i : i + n] for i in range(max(len(w) - n + 1, 1)))
    return out


def test_cosine_pairs_as_all_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = {f"i{k:03}": " ".join(rng.choices(words, k=12)) for k in range(60)}
    for k in range(60, 90):
        base = texts[f"i{rng.randrange(60):03}"].split()
        base[rng.randrange(len(base))] = rng.choice(words)
        texts[f"i{k:03}"] = " ".join(base)
    tf = {i: char_wb(t) for i, t in texts.items()}
    df = Counter(g for c in tf.values() for g in c)
    vec = defaultdict(dict)
    for i, c in tf.items():
        raw = {g: (1 + math.log(n)) * (math.log((1 + len(tf)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] >= 2}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vec[i] = {g: w / norm for g, w in raw.items()}
    want = {(a, b) for a in vec for b in vec if a < b and sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) >= 0.7}
    rows = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {(r[0], r[1]) for r in vectors.cosine_pairs(vectors.tfidf(rows, vectors.char_grams("text")), 0.7).collect()}
    assert want and got == want


def shuffled_bytes(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_near_pairs_as_cosine_pairs_with_less_shuffled(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=25)) for _ in range(3000)]
    for _ in range(300):
        base = rng.choice(texts).split()
        base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join(base + base[: rng.randrange(3)]))
    texts += ["", "...", "x", "alone once"]
    rows = spark.createDataFrame([(f"i{k:04}", t) for k, t in enumerate(texts)], "id string, text string")
    begun = shuffled_bytes(spark)
    want = {(r[0], r[1]): r[2] for r in vectors.cosine_pairs(vectors.tfidf(rows, vectors.word_grams("text"), most_share=vectors.MOST_SHARE)).collect()}
    between = shuffled_bytes(spark)
    got = {(r[0], r[1]): r[2] for r in vectors.near_pairs(rows, vectors.word_grams("text")).collect()}
    ended = shuffled_bytes(spark)
    assert want and got == pytest.approx(want)
    assert 2 * (ended - between) < between - begun


def test_near_pairs_of_no_texts(spark):
    rows = spark.createDataFrame([], "id string, text string")
    assert vectors.near_pairs(rows, vectors.word_grams("text")).count() == 0


def test_files_round_trip(spark, tmp_path):
    raw = tmp_path / "raw.tsv"
    raw.write_bytes("ham\tcaf\xe9\tau lait\nspam\tNA\n".encode("cp1252"))
    rows = files.read_labelled_lines(spark, str(raw)).orderBy("row_number").collect()
    assert [tuple(r) for r in rows] == [(1, "ham", "café\tau lait"), (2, "spam", "NA")]
    (tmp_path / "bad.tsv").write_text("no tab\n")
    with pytest.raises(Exception, match="no tab"):
        files.read_labelled_lines(spark, str(tmp_path / "bad.tsv")).collect()
    table = [("1", 'say ""hi"", ok'), ("2", "NA"), ("3", ""), ("4", "two\nlines")]
    files.write_csv(spark.createDataFrame(table, "id string, text string"), str(tmp_path / "t.csv"))
    back = files.read_csv(spark, str(tmp_path / "t.csv"), "id string, text string").orderBy("id").collect()
    assert [tuple(r) for r in back] == table
    assert files.read_json(str(tmp_path / "none.json")) == {}
    assert files.write_json(str(tmp_path / "a/b.json"), {"é": 1}) and not files.write_json(str(tmp_path / "a/b.json"), {"é": 1})
    assert files.read_json(str(tmp_path / "a/b.json")) == {"é": 1}
    assert files.markdown_table(spark.createDataFrame([(1, "a|b")], "n int, t string")).splitlines()[2] == "| 1 | a\\|b |"
    assert files.provenance(str(raw), "test")["sha256"] == files.sha256_file(str(raw))
