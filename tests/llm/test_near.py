"""The steps of near.py and the bit planes, held against plain Python."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import bitslice, near, overlap
from corpuscle.llm.common import drop_shuffles, staged
from corpuscle.llm.copies import canonical_values


def block(seed, lengths, parts=False, sides=(3,)):
    """Rows of groups, sorted by group and size, some of which nearly repeat the row before."""
    rng, rows = np.random.default_rng(seed), []
    for g, length in enumerate(lengths):
        words = set()
        for _ in range(length):
            words = set(rng.integers(0, 4000, rng.integers(1, 160)).tolist()) if rng.random() < 0.7 else {*list(words)[2:], int(rng.integers(4000))}
            bits = np.zeros(bitslice.WIDTH, np.uint8)
            bits[[w * 40503 % 9973 % bitslice.WIDTH for w in words]] = 1
            rows.append((g, len(words), rng.choice(sides), rng.integers(1, 3) if parts and g % 2 else 0, np.packbits(bits, bitorder="little")))
    rows.sort(key=lambda r: r[:2])
    group, size, side, part, sketch = (np.array(x) for x in zip(*rows, strict=True))
    return group, size, side.astype(np.uint8), sketch, part


@pytest.mark.parametrize("sides", [(3,), (1, 2), (1, 2, 3)])
@pytest.mark.parametrize("parts", [False, True])
def test_bit_planes_find_each_near_pair_once(sides, parts):
    group, size, side, sketch, part = block(7, [1, 70, 3, 200, 2, 2, 64, 130], parts, sides)
    got = [tuple(sorted(p)) for i, j in bitslice.close_pairs(group, size, side, sketch, part) for p in zip(i.tolist(), j.tolist(), strict=True)]
    i, j = np.triu_indices(len(group), 1)
    wanted = (group[i] == group[j]) & ((part[i] == 0) | (part[i] != part[j]))
    allowed = wanted & (((side[i] & 1) & (side[j] >> 1)) | ((side[i] >> 1) & (side[j] & 1))).astype(bool)
    near_enough = allowed & (4 * np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64) <= size[i] + size[j]) & (np.minimum(size[i], size[j]) >= 0.6 * np.maximum(size[i], size[j]))
    assert len(set(got)) == len(got)
    assert set(zip(i[near_enough].tolist(), j[near_enough].tolist(), strict=True)) <= set(got) <= set(zip(i[allowed].tolist(), j[allowed].tolist(), strict=True))
    assert near_enough.sum() > 20


def test_pairs_beyond_the_radius_take_half_the_planes(monkeypatch):
    rng, added = np.random.default_rng(1), []
    sketch = np.packbits(rng.random((1024, bitslice.WIDTH)) < 0.35, axis=1, bitorder="little")
    add = bitslice._Adder.add16
    monkeypatch.setattr(bitslice._Adder, "add16", lambda self, x: (added.append(16 * len(x[0])), add(self, x))[1])
    one = np.zeros(1024, np.int64)
    assert not list(bitslice.close_pairs(one, one + 110, np.full(1024, 3, np.uint8), sketch))
    # 16 tiles: 136 pairs of tiles, 64 rows each
    assert sum(added) < 0.4 * 136 * 64 * bitslice.WIDTH


def test_bits_of_a_whole_group_come_last_and_tiles_bound_by_group(monkeypatch):
    """Groups whose rows all have 32 bits in common, beside groups of one small set, which share their last tiles."""
    rng, added, rows = np.random.default_rng(2), [], []
    for g in range(16):
        bits = rng.random((144 if g % 2 == 0 else 1, bitslice.WIDTH)) < (0.2 if g % 2 == 0 else 0.02)
        bits[:, 16 * g : 16 * g + 32] |= g % 2 == 0
        rows += [(g, 85 if g % 2 == 0 else 5, b) for b in bits]
    group, size, bits = (np.array(x) for x in zip(*rows, strict=True))
    add = bitslice._Adder.add16
    monkeypatch.setattr(bitslice._Adder, "add16", lambda self, x: (added.append(16 * len(x[0])), add(self, x))[1])
    list(bitslice.close_pairs(group, size, np.full(len(group), 3, np.uint8), np.packbits(bits, axis=1, bitorder="little")))
    # three tiles a group: 64 rows meet three of them, 64 two, 16 one
    assert sum(added) < 60 * 8 * (64 * 3 + 64 * 2 + 16)


TEXTS = ["Hello, hello WORLD 42", "world 42 hello", "ΟΔΟΣ straße İx", "", "...", None, "a_b-c\x00d é", "z" * 70_000, "naïve 10½", "ẞ 漢字　漢字 x́y"]


def test_forms_have_the_words_of_the_jvm(spark):
    rows = spark.createDataFrame([(str(k), t, 3) for k, t in enumerate(TEXTS)] * 2 + [(None, "hello", 3)], "id string, text string, side int")
    made = near.forms(rows).collect()
    words = {r["id"]: set(r["w"]) - {""} for r in rows.where("id is not null and text is not null").selectExpr("id", r"split(lower(text), '[^\\p{L}\\p{N}]+') AS w").collect()}
    form = {r["f"]: set(r["form"].split(" ")) for r in made if r["form"] is not None}
    assert sorted((r["id"], form[r["f"]]) for r in made) == sorted((i, w) for i, w in words.items() if w)
    assert [r["id"] for r in made if r["other"]] == [max("0", "1")]
    counts = near.word_counts(near.distinct_forms(near.forms(rows)))
    for w, s in spark.createDataFrame([("hello",), ("straße",)], "w string").selectExpr("w", f"pmod(xxhash64(w), {near.COUNTERS})").collect():
        assert counts[s] == sum(w in x for x in form.values()), w


def test_whole_values_of_plain_texts_are_those_of_the_jvm(spark):
    """They are made over batches, those of texts beyond ASCII by the JVM; a Kelvin sign is a k in both."""
    texts = [*TEXTS, "K. 273 \u212a", "k273k", "a: 1; b: 2; c: 3", "C=3|A=1|B=2"]
    rows = spark.createDataFrame([(str(k), t, 3) for k, t in enumerate(texts)], "id string, text string, side int")
    wanted = {r["id"]: (r["whole"], r["fields"]) for r in canonical_values(rows).collect()}
    got = {r["id"]: (r["whole"], r["fields"]) for r in near.forms(rows).collect()}
    assert got == wanted and got["10"] == got["11"] and got["12"][1] == got["13"][1] is not None


def test_known_characters_are_those_of_the_jvm(spark, monkeypatch):
    """Each of them, and those around them, cut by the JVM and over batches; texts of known ones are left to the batches."""
    codes = [*range(0x80, 0x180), *range(0x2000, 0x2100), *range(0x1F2F0, 0x1F650)]
    texts = [f"Ab{chr(c)}Cd {chr(c)}" for c in codes] + ["".join(map(chr, codes[k : k + 9])) for k in range(0, len(codes), 9)]
    rows = spark.createDataFrame([(str(k), t, 3) for k, t in enumerate(texts)], "id string, text string, side int")

    def made():
        forms = near.forms(rows).collect()
        words = {r["f"]: sorted(r["form"].split(" ")) for r in forms if r["form"] is not None}
        return {r["id"]: (r["whole"], words[r["f"]]) for r in forms}

    assert rows.where(F.col("text").rlike(near.KNOWN)).count() > 1000
    over_batches = made()
    monkeypatch.setattr(near, "KNOWN", "^$")
    assert over_batches == made()
    assert {i: whole for i, (whole, _) in over_batches.items()} == {r["id"]: r["whole"] for r in canonical_values(rows).collect()}


def test_p6_texts_are_read_and_cut_once(spark, put, monkeypatch):
    """Neither copies nor splits are joined to the forms by id; they go with them."""
    calls = []
    monkeypatch.setattr(near, "_OWN", near._OWN)
    made = overlap.forms
    monkeypatch.setattr(overlap, "forms", lambda texts: (calls.append(texts.columns), made(texts))[1])
    folder = put("canonical_sms", [("H1", "heldout", "Same words, here"), ("T1", "train", "here same WORDS"), ("T2", "train", "same words here")], "id string, split string, text string")
    assert {tuple(r) for r in overlap.p6_found(spark, folder).collect()} == {("H1", "T1"), ("H1", "T2")}
    assert calls == [["id", "text", "side"]]
    assert {tuple(r) for r in near.p1_found(spark, folder).collect()} == {("H1", "T1"), ("T1", "T2")}
    assert re.fullmatch(r"[HT]\d", near.p1_groups(spark, folder).first()["class_id"])


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffles_of_the_plan_that_ran_last_are_dropped(spark):
    before = shuffle_files(spark)
    staged(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    made = shuffle_files(spark) - before
    assert made
    drop_shuffles(spark)
    end = time.time() + 10
    while made & shuffle_files(spark) and time.time() < end:
        time.sleep(0.2)
    assert not made & shuffle_files(spark)


@pytest.mark.parametrize("every", [False, True])
def test_blocks_in_turns_lose_nothing(spark, put, monkeypatch, every):
    rng, rows, texts = np.random.default_rng(3), [], ["alpha beta gamma delta", "kilo lima mike november oscar"]
    for k in range(40):
        texts.append(" ".join({*texts[rng.integers(len(texts))].split(), f"word{rng.integers(25)}"}))
        rows.append((f"T{k:02}", texts[-1]))
    folder = put("canonical_sms", rows, "id string, text string")
    at_once = sorted(tuple(r) for r in near.p1_found(spark, folder, every).collect())
    shared, turns = [], near._turns
    monkeypatch.setattr(near, "_turns", lambda *a: (shared.append(turns(*a)), shared[-1])[1])
    for name, value in (("PART", 4), ("HELD", 3), ("HELD_LEAST", 1)):
        monkeypatch.setattr(near, name, value)
    assert sorted(tuple(r) for r in near.p1_found(spark, folder, every).collect()) == at_once
    assert len(at_once) > 50 and shared[0] > 2


def test_turns_hold_rows_in_proportion_to_the_texts():
    assert [near._turns(n, near.KEYS, more) for n, more in ((0, 0), (100_000, 0), (1_000_000, 0), (1_000_000, 10**8))] == [1, 1, 2, 22]
