import random

import pytest

from examloom.llm.lookalike import LOOK_ALIKE_FROM, LOOK_ALIKE_TO, Trie, canonical_text, fold, is_mixed, is_spelling, same_looking_classes, same_looking_pairs, shelf_of, spellings

SAME = [
    ("TOM-7水平", "ТОМ‑7水平"), ("Ménotte征", "Ménotte征"), ("体温37.2", "体温３７．２"), ("用见", "⽤⻅"), ("a b", "a　b"), ("a b", "a b"),
    ("心率", "​心­率﻿"), (" B ", "B"), ("10μg", "10µg"), ("25℃", "25°C"), ("年", "年"), ("x\r\ny", "x\ny"), ("Ме́notte", "Ménotte"),
]
DIFFERENT = [("10⁹", "109"), ("a", "A"), ("a,b", "a、b"), ("a.b", "a。b"), ("a  b", "a b"), ("ab", "a b"), ("B", "8"), ("e", "é"), ("-", "—"), ("O", "0")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert fold(a) == fold(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert fold(a) != fold(b)


def test_fold_is_idempotent_and_total():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(8))
        assert fold(fold(t)) == fold(t)
    assert fold(None) is None and fold("") == "" and fold("　​ ") == ""


def test_trie_costs_nothing_for_looks_only():
    t = Trie()
    for w in ("TOM-7", "Ménotte", "боль", "cell", "ЗАО"):
        t.add(w)
    assert t.match("Т​ОМ‐7") == ("TOM-7", 0) and t.match("Ｍénotte") == ("Ménotte", 0) and t.match("бoль") == ("боль", 0)
    assert t.match("ceӀӀ") == ("cell", 2) and t.match("сеⅼⅼ") == ("cell", 0) and t.match("сеӀӀ", 1) is None and t.match("ceII") is None
    assert t.match("TON-7") is None and t.match("TON-7", 3) == ("TOM-7", 3) and t.match("TO-7", 3) == ("TOM-7", 3) and t.match("TOMM-7", 3) == ("TOM-7", 3)
    assert t.match("XXX-7", 6) is None
    assert is_spelling("боль") and not is_spelling("сор") and is_spelling("TOM") and not is_mixed("TGF-β1") and is_mixed("бoль")


def test_vocabulary_decides_what_the_table_cannot():
    assert spellings(["cell", "ceӀӀ", "сеӀl"]) == {"ceӀӀ": "cell", "сеӀl": "cell"}
    assert spellings(["ceӀӀ"]) == {} and fold("ceӀӀ") == "ceII"
    assert spellings(["30mg", "З0mg"]) == {"З0mg": "30mg"} and spellings(["ЗАО"]) == {"ЗАО": "ЗАО"}
    assert spellings(["TGF-β1", "TGF-ß1"]) in ({"TGF-ß1": "TGF-β1"}, {"TGF-β1": "TGF-ß1"})
    for a, b in (("cell", "ceӀӀ"), ("30mg", "З0mg"), ("βx", "ßx"), ("Il", "ӀӀ")):
        assert shelf_of(a) == shelf_of(b)


def _df(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "k long, t string, canonical string, key string")


def test_canonical_takes_the_words_own_script(spark):
    got = {r.key: r.canonical for r in canonical_text(_df(spark, ["боль и TOM-7", "бoль", "боль", "ТОМ-7", None, "", "сор", "a" * 200_000]), "k", "t").collect()}
    assert got == {0: "боль и TOM-7", 1: "боль", 2: "боль", 3: "TOM-7", 4: None, 5: "", 6: "cop", 7: "a" * 200_000}


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    swap = dict(zip(LOOK_ALIKE_TO, LOOK_ALIKE_FROM, strict=True))
    texts = [None, "", " ", "​"]
    for i in range(150):
        t = rng.choice(["TOM-7水平 升高", "Menotte征", "ABCE", "x y", f"n{i}"])
        texts.append("".join(swap.get(c, c) if rng.random() < 0.2 else c + "​" if rng.random() < 0.1 else c for c in t) if rng.random() < 0.5 else t)
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a != b and fold(a) and fold(a) == fold(b)}
    got = [(r.key_a, r.key_b) for r in same_looking_pairs(_df(spark, texts), "k", "t").collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_pairs_within_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "q1"), (2, "а", "q1"), (3, "а", "q2"), (4, "a", None), (5, "а", None)], "k long, t string, g string")
    assert [(r.key_a, r.key_b) for r in same_looking_pairs(df, "k", "t", "g").collect()] == [(1, 2)]
    assert same_looking_pairs(df.filter("false"), "k", "t").count() == 0


def test_pair_that_the_table_alone_misses(spark):
    texts = ["one cell here", "one ceӀӀ here", "one ce11", "30mg", "З0mg", "cell"]
    assert fold(texts[0]) != fold(texts[1]) and fold(texts[3]) != fold(texts[4])
    got = {(r.key_a, r.key_b) for r in same_looking_pairs(_df(spark, texts), "k", "t").collect()}
    assert got == {(0, 1), (3, 4)}


def test_classes_and_a_hot_text(spark):
    texts = ["甲乙 TOM"] * 1500 + ["甲乙　TOM", "甲乙 ТОМ", "丙", "丙​", "丁", None, ""]
    df = _df(spark, texts)
    got = {r.k: (r["class"], r.stored, r.n_stored) for r in same_looking_classes(df, "k", "t").collect()}
    assert got == {i: (0, 0, 3) for i in range(1500)} | {1500: (0, 1500, 3), 1501: (0, 1501, 3), 1502: (1502, 1502, 2), 1503: (1502, 1503, 2)}
    pairs = {(r.key_a, r.key_b) for r in same_looking_pairs(df, "k", "t").collect()}
    assert pairs == {(i, j) for i in range(1500) for j in (1500, 1501)} | {(1500, 1501), (1502, 1503)}
    assert same_looking_classes(df.filter("false"), "k", "t").count() == 0
