"""Encodings, personal information, tokens, mixes and pieces."""

import random

import pytest
import tiktoken

import __spark_entry__
from corpuscle.llm import cut, encoding, mix, pii
from corpuscle.llm.tokens import encoder

SMALL = "/root/testdata/sf0.001"


def run(spark, name, folder):
    return __spark_entry__.queries()[name](spark, folder).collect()


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
def test_garbled_utf8_comes_back(wrong):
    seen = encoding.table(wrong)
    for text in ("le café de Lyon est fermé, ça coûte 15 €", "das Mädchen über die Straße", "был świetny żółty", "it’s 20° — 👍", "магазин закрыт, купим в другом"):
        garbled = "".join(seen[b] for b in text.encode())
        assert encoding.restored(garbled) == text
        assert encoding.restored("correct: naïve café, " + garbled) == "correct: naïve café, " + text


def test_garbled_twice_and_other_alphabets():
    once = "".join(encoding.table("cp1252")[b] for b in "señor 😀 it’s".encode())
    assert encoding.restored("".join(encoding.table("cp1252")[b] for b in once.encode())) == "señor 😀 it’s"
    text = "позвони когда будешь в городе, нужен хлеб и молоко"
    assert encoding.restored("lol " + "".join(encoding.table("cp1252")[b] for b in text.encode("cp1251"))) == "lol " + text


@pytest.mark.parametrize("text", ["ÂGE D'OR à Paris", "Ângela a cumpărat", "SÃO PAULO, NÃO", "blåbær på Ørland", "20 °C, «CAFÉ»", "Рёбра и ёлка, С… «ЗАВ»", "Þetta er frá", "plain", "ESTÁ BOM? ✓"])
def test_correct_text_is_no_case(text):
    assert encoding.restored(text) is None


def test_lost_characters():
    assert encoding.restored("caf� au lait") == ""


NAMES = pii.Names(["Anna", "Oscar", "Mei"], [a + b for a in ("Tarn", "Brem", "Catt", "Dur", "Eld", "Fen") for b in ("brook", "wick", "shaw", "ley", "moor", "ford")])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail me on anna.bremwick+x (at) mail[dot]example pls", [("email", "anna.bremwick+x (at) mail[dot]example")]),
        ("mission at kunar dot matrix shop @ Noon, @handle posted", []),
        ("Tel (+44 7700 900123); (020) 7946 0654 or 202-555-0100.", [("phone", "+44 7700 900123"), ("phone", "(020) 7946 0654"), ("phone", "202-555-0100")]),
        ("dated 12-05-2026, track 335-3259X9, ORD4222078, code 67533, AB 12345 6", []),
        ("my NI number is qq 12 34 56 C; ssn 932-10-0772, ID: 39151405T", [("identity_number", "qq 12 34 56 C"), ("identity_number", "932-10-0772"), ("identity_number", "39151405T")]),
        ("come to Flat 7, 199a Xyz Terrace. bus 95 to Abc Lane, 399 bis, rue Crailstone now", [("street_address", "Flat 7, 199a Xyz Terrace"), ("street_address", "399 bis, rue Crailstone")]),
        ("Calle de Mapdand, 121 and Fenburystr. 35, Am Gosmill 465; ul. Treb 289", [("street_address", "Calle de Mapdand, 121"), ("street_address", "Fenburystr. 35"), ("street_address", "Am Gosmill 465"), ("street_address", "ul. Treb 289")]),
        ("this is Felix Durbrook speaking, met Dr. Eldshaw today, regards, Fenmoor, Anna", [("person_name", "Felix Durbrook"), ("person_name", "Eldshaw"), ("person_name", "Fenmoor, Anna")]),
        ("ask for O. Cattley, Mei A. Tarnford-Bremley said hello. Anna Bakery is open", [("person_name", "O. Cattley"), ("person_name", "Mei A. Tarnford-Bremley")]),
        ("", []),
        (None, []),
    ],
)
def test_personal_information(text, want):
    assert [(k, text[s:e]) for s, e, k in pii.find(text, NAMES)] == want


def test_surrogates_are_consistent_and_distinct(spark):
    spans, table = pii.surrogates(spark, SMALL)
    rows = table.collect()
    assert rows and len({(r["kind"], r["made"]) for r in rows}) == len(rows) == len({(r["kind"], r["entity"]) for r in rows})
    assert pii.entity("phone", "+44 7700 900123") == pii.entity("phone", "07700-900123") == pii.entity("phone", "0044 7700 900123")
    assert pii.entity("person_name", "Fenmoor, Anna") == pii.entity("person_name", "ANNA FENMOOR")
    new = pii.written("phone", "+44 (0)7700 900123", "7654321")
    assert new == "+44 (0)7707 654321"
    assert pii.written("person_name", "FENMOOR, ANNA", "Greta Ashton-Oakham") == "ASHTON-OAKHAM, GRETA"


def test_masked_keeps_the_rest(spark):
    for r in run(spark, "p5_masked", SMALL):
        assert any(f"[{k.upper()}]" in r["text"] for k in pii.KINDS)


def test_tokens_as_the_library(spark):
    import public_tokenizers

    own = encoder()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", None, "<|endoftext|>", " \n\n  x", "a" * 30_000, "é😀" * 500, *("".join(rng.choice("ab é\n,1") for _ in range(200)) for _ in range(50))]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    ids, begins = own.encode(texts)
    assert [ids[a:b] for a, b in zip(begins, begins[1:], strict=False)] == [library.encode_ordinary(t) if t else [] for t in texts]
    got = {r["doc_id"]: r["ids"] for r in run(spark, "p8_ids", SMALL)}
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_pieces(spark):
    own = encoder()
    rng = random.Random(3)
    words = ["alpha", "beta,", "gamma.", "delta!\n", "epsilon\n\n", "ζήτα", "😀"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 50, 700, 5000)] + ["x" * 9000, "字" * 3000, " " * 4000, "\n" * 100 + "a"]
    for text in texts:
        for limit, overlap in ((1024, 128), (64, 16), (20, 0), (8, 7)):
            pieces = cut.cut(text, limit, overlap, own)
            assert pieces[0][0] == 0 and pieces[-1][2] == len(text)
            assert all(a[2] == b[1] and b[0] <= b[1] for a, b in zip(pieces, pieces[1:], strict=False))
            assert all(n <= limit and n == own.lengths([text[b:e]])[0] for b, _, e, n in pieces)
    # cuts lie at the ends of paragraphs where there are any near the middle
    text = "\n\n".join(["word " * 30] * 20)
    pieces = cut.cut(text, 128, 0, own)
    assert all(text[: p[1]].endswith("\n\n") for p in pieces[1:])


def test_overlaps_hold_what_was_asked():
    own = encoder()
    text = " ".join(f"word{k}" for k in range(3000))
    shared = [own.lengths([text[b:o]])[0] for b, o, _, _ in cut.cut(text, 256, 32, own)[1:]]
    assert all(32 - 4 <= n <= 32 for n in shared)


MIX = "source string, target_share double, max_repeats bigint"


def test_mix_holds_its_shares(spark, put):
    rng = random.Random(4)
    docs = [(k, "word " * rng.randint(1, 400), rng.choice(["Big-Feed", "big_feed ", "small", "other"] if k % 10 else ["small"])) for k in range(3000)]
    docs += [(9001, None, "small"), (9002, "", "small"), (9003, "x", None)]
    put("documents", docs, "doc_id bigint, text string, source string")
    folder = put("mix_targets", [("big_feed", 0.5, 1), ("small", 0.4, 3), ("empty", 0.1, 2)], MIX)
    rows = run(spark, "p9_mix", folder)
    assert {r["source"] for r in rows} == {"big_feed", "small"} and all(r["copies"] <= (1 if r["source"] == "big_feed" else 3) for r in rows)
    shares = {r["source"]: r for r in run(spark, "p9_shares", folder)}
    assert abs(shares["big_feed"]["reached_share"] - 5 / 9) < 0.01 and abs(shares["small"]["reached_share"] - 4 / 9) < 0.01
    assert shares["empty"]["n_tokens"] == 0


def test_mix_of_a_given_size_reports_what_is_wanting(spark, put):
    put("documents", [(k, "word " * 10, "a" if k < 50 else "b") for k in range(100)], "doc_id bigint, text string, source string")
    folder = put("mix_targets", [("a", 0.9, 2), ("b", 0.1, 2)], MIX)
    rows, goals, wanted = mix.mixed(spark, folder, total=5000.0)
    reached = {r["source"]: r["t"] for r in rows.selectExpr("source", "n_tokens * copies AS t").groupBy("source").sum("t").withColumnRenamed("sum(t)", "t").collect()}
    assert wanted["a"] == 4500 and reached["a"] == 50 * 11 * 2 and abs(reached["b"] - 500) <= 22


def test_a_tenth_of_documents_in_one_source_is_rounded_evenly(spark, put):
    put("documents", [(k, "w " * (1 + k % 7), "hot") for k in range(2000)] + [(5000 + k, "w " * 50, "cold") for k in range(20)], "doc_id bigint, text string, source string")
    folder = put("mix_targets", [("hot", 0.5, 1), ("cold", 0.5, 1)], MIX)
    shares = {r["source"]: r["reached_share"] for r in run(spark, "p9_shares", folder)}
    assert abs(shares["hot"] - 0.5) < 0.02


def test_cut_splits_a_text_once_and_each_piece_once(monkeypatch):
    own, seen = encoder(), []
    split = own.split
    monkeypatch.setattr(own, "split", lambda text: seen.append(text) or split(text))
    text = "One sentence of some words. Another one follows it!\n" * 40
    pieces = cut.cut(text, 128, 0, own)
    assert len(pieces) > 1 and seen.count(text) == 1 and len(seen) == 1 + len(pieces)
