import random

import numpy as np

from examloom.llm import overlap
from examloom.llm.lookalike import fold
from examloom.llm.overlap import alike, distance, overlap_pairs, overlap_report, plain

SCHEMA = "row_id long, split string, source string, question string, options map<string,string>, c int, h string"


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_distance_is_edit_distance():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        d = _lev(a, b)
        assert distance(a, b, 99) == d and all(distance(a, b, m) > m for m in range(d)) and distance(a, b, d) == d


def test_matching_is_the_cheapest():
    from itertools import permutations

    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(1, 6)
        cost = [[rng.randrange(0, 9) for _ in range(n)] for _ in range(n)]
        assert overlap.matched(cost) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
    many = [[abs(i * 7 % 40 - j) for j in range(40)] for i in range(40)]
    assert overlap.matched(many) == 0
    assert alike("问题" * 20, ["甲乙", "丙"], "问题" * 20, ["丙", "甲乙丁"]) and not alike("问题", ["甲乙丙丁"], "问题", [])


def _text(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(n))


def _edit(rng, t, k):
    t = list(t)
    for _ in range(k):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice(["", chr(rng.randrange(0x4E00, 0x5200)), t[i] + chr(rng.randrange(0x4E00, 0x5200))])
    return "".join(t)


def _rows(rng):
    rows = []
    for i in range(120):
        q, o = _text(rng, rng.randrange(20, 120)), [_text(rng, rng.randrange(3, 15)) for _ in range(5)]
        rows.append((i, "train", q, o))
        kind = i % 6
        size = len(q) + sum(map(len, o))
        if kind == 0:
            rows.append((1000 + i, "val", " ".join(q) + "。", o[::-1] + [""]))
        elif kind == 1:
            rows.append((1000 + i, "test", _edit(rng, q, max(1, size * 5 // 100)), rng.sample(o, 5)))
        elif kind == 2:
            rows.append((1000 + i, "val", q, [_edit(rng, x, 1) if len(x) > 8 else x for x in o]))
        elif kind == 3:
            rows.append((1000 + i, "test", q, [_text(rng, 12) for _ in range(5)]))
        elif kind == 4:
            rows.append((1000 + i, "val", _text(rng, 90), o))
        else:
            rows.append((1000 + i, "test", _edit(rng, q, size * 3 // 10), o))
    return rows + [(3000, "train", "同", ["一"]), (3001, "train", "同", ["一"]), (3002, "val", "同", ["一"]), (3003, "val", "同。", ["一"]), (3004, "other", "同", ["一"])]


def _df(spark, rows):
    return spark.createDataFrame([(i, s, "src" if i % 2 else None, q, None if o is None else dict(zip("ABCDEFG", o)), 1, "x") for i, s, q, o in rows], SCHEMA)


def test_pairs_against_brute_force(spark):
    rows = _rows(random.Random(8))
    norm = {i: (plain(q), sorted(x for x in map(plain, o) if x)) for i, _, q, o in rows}
    side = {i: s for i, s, _, _ in rows}
    want = {(a, b) for a in norm if side[a] == "train" for b in norm if side[b] in ("val", "test") and alike(*norm[a], *norm[b])}
    got = [(r.train_key, r.eval_key) for r in overlap_pairs(_df(spark, rows)).collect()]
    assert set(got) == want and len(got) == len(want) >= 60
    assert {(3000, 3002), (3001, 3002), (3000, 3003), (3001, 3003)} <= set(got)
    report = overlap_report(_df(spark, rows)).collect()
    assert sum(r.n_pairs for r in report) == len(want) and {r.split for r in report} == {"val", "test"}


def test_nulls_empties_and_nothing(spark):
    rows = [(1, "train", None, ["a"]), (2, "val", None, ["a"]), (3, "train", "a", None), (4, "val", "a", None), (5, "train", "", ["", "。"]), (6, "val", " ", []), (7, None, "", [])]
    assert [(r.train_key, r.eval_key) for r in overlap_pairs(_df(spark, rows)).collect()] == [(5, 6)]
    assert overlap_pairs(_df(spark, [])).count() == 0 and overlap_report(_df(spark, [])).count() == 0
    long = "".join(chr(0x4E00 + i * i % 9000) for i in range(20_000))
    got = overlap_pairs(_df(spark, [(1, "train", long, ["x"]), (2, "test", long[:-900] + "y", ["x"])])).collect()
    assert [(r.train_key, r.eval_key) for r in got] == [(1, 2)]


def _edited_pairs(rng):
    """Records with all the edits that are allowed, spent on a repeated name, on one character and on the rarest characters."""
    common = [chr(0x4E00 + i) for i in range(60)]
    word = lambda n: "".join(rng.choice(common) for _ in range(n))
    for i in range(300):
        names = ["".join(chr(rng.randrange(0x6000, 0x9000)) for _ in range(3)) for _ in range(2)]
        q, o = "".join(word(21) + names[0] for _ in range(4)), [word(6) for _ in range(4)]
        if i % 3 == 0:  # a name of 3 characters in 4 places
            changed = q.replace(*names)
        elif i % 3 == 1:  # one character in 12 places
            at = set(rng.sample(range(len(q)), 12))
            changed = "".join(names[1][0] if j in at else c for j, c in enumerate(q))
        else:  # the rarest characters by others that are as rare
            changed = "".join(c if c in common else chr(rng.randrange(0x6000, 0x9000)) for c in q)
        assert alike(q, sorted(o), changed, sorted(o))
        yield i, q, changed, o


def test_edits_of_any_kind_are_found(spark):
    pairs = list(_edited_pairs(random.Random(12)))
    rows = [(i, "train", q, o) for i, q, _, o in pairs] + [(1000 + i, "val", changed, o) for i, _, changed, o in pairs]
    got = {(r.train_key, r.eval_key) for r in overlap_pairs(_df(spark, rows)).collect()}
    assert [i for i, *_ in pairs if (i, 1000 + i) not in got] == []


def test_blocks_miss_few_of_the_farthest_pairs():
    assert overlap.missed(overlap.FARTHEST) < 0.004 and overlap.missed(0.68) < 0.001
    rng = random.Random(9)
    far, hit = [], 0
    for _ in range(600):
        t = _text(rng, 130)
        at = set(rng.sample(range(130), 15))
        words, keys = overlap.fingerprints([[t], ["".join(chr(0x7000 + rng.randrange(999)) if i in at else c for i, c in enumerate(t))]])
        far.append(int(np.unpackbits((words[0] ^ words[1]).view(np.uint8)).sum()))
        hit += bool((keys[0] == keys[1]).any())
    assert hit >= 594 and sum(f > overlap.RADIUS for f in far) <= 3 and 18 <= sum(far) / 600 <= 30


def test_unrelated_records_rarely_meet():
    rng = random.Random(10)
    _, keys = overlap.fingerprints([[_text(rng, 90), _text(rng, 8)] for _ in range(400)])
    assert sum((keys[i] == keys[j]).any() for i in range(400) for j in range(i)) < 40


def test_a_family_of_a_third_of_all_rows(spark, monkeypatch):
    """One template with another name in each row: its blocks are hot, split over tasks, and no pair is lost."""
    monkeypatch.setattr(overlap, "SEEN", 3)
    rng = random.Random(11)
    frame = _text(rng, 60)
    rows = []
    for i in range(900):
        q = frame[:30] + _text(rng, 30) + frame[30:] if i % 3 == 0 else _text(rng, 100)
        rows.append((i, "train", q, ["甲", "乙丙"]))
        if i % 9 == 0:
            rows.append((5000 + i, "test", q[:-1] + "末", ["乙丙", "甲"]))
    got = {(r.train_key, r.eval_key) for r in overlap_pairs(_df(spark, rows)).collect()}
    assert got == {(i, 5000 + i) for i in range(0, 900, 9)}
    codes = overlap.coded(overlap.prepared(_df(spark, rows), "row_id", "split", "question", "options").selectExpr("key as c", "train", "not train as eval", "q", "o"))
    assert overlap.hot_blocks(codes).count() > 0


def test_classes_and_report_from_links(spark):
    q = "患者反复胸闷气促三年加重两天入院后心电图提示心房颤动"
    rows = [(i, "train", q, ["甲", "乙"]) for i in range(40)] + [(100 + i, "val", q + "。", ["乙", "甲"]) for i in range(30)] + [(7, "test", q, ["甲", "乙"]), (200, "test", _text(random.Random(1), 40), ["甲"])]
    df = _df(spark, rows)
    got = {(r.row_id, r.train): (r["class"], r.n_links) for r in overlap.overlap_classes(df).collect()}
    assert len(got) == 72 and got[(3, True)] == got[(101, False)] == (0, 1) and got[(200, False)] == (200, 0)
    report = {(r.split, r.source): (r.n_rows, r.n_overlapping, r.n_pairs) for r in overlap_report(df).collect()}
    assert report == {("val", None): (15, 15, 600), ("val", "src"): (15, 15, 600), ("test", None): (1, 0, 0), ("test", "src"): (1, 1, 39)}


def test_plain_character_by_character():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(["е", "́", "é", "Ａ", " ", "。", "й", "ﬁ", "ß", "Ⅱ", "⽤", "\u200b", chr(rng.randrange(32, 0xD800))]) for _ in range(8))
        assert plain(t) == (fold(t) or "").lower().translate(overlap._VISIBLE)


def test_repeated_ids_with_other_texts(spark):
    q, r = "反复胸闷气促三年加重两天入院后心电图提示心房颤动", "右上腹疼痛五小时向右肩放射墨菲征阳性体温三十八度"
    rows = [(1, "train", q, ["甲"]), (1, "train", r, ["乙"]), (1, "train", q, ["甲"]), (2, "val", q, ["甲"]), (3, "val", r, ["乙"]), (4, "val", q, ["乙"] * 9)]
    got = sorted((x.train_key, x.eval_key) for x in overlap_pairs(_df(spark, rows)).collect())
    assert got == [(1, 2), (1, 3)]
