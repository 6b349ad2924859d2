"""Operators against small brute-force versions."""

import random

import pytest
from pyspark.sql import functions as F

from examloom.functions.text import ngrams, stable_fraction
from examloom.operators import audit, credit, decontam, dedup, evaluation, harness, sampling


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_first_and_last(spark):
    d = spark.createDataFrame([("a", 3, "x"), ("a", 1, None), ("b", 2, None), ("a", 2, None), ("", 4, "y")], "k string, o int, reason string")
    assert _rows(dedup.first_seen(d, "k", "o"), "k", "o") == [("", 4), ("a", 1), ("b", 2)]
    assert _rows(dedup.last_wins(d, "k", "o"), "k", "o", "first_o") == [("", 4, 4), ("a", 3, 1), ("b", 2, 2)]
    got = {(r.k, r.o): r.outcome for r in dedup.first_valid(d, "k", "o", "reason").collect()}
    assert got == {("a", 1): "written", ("a", 2): "duplicate", ("a", 3): "duplicate", ("b", 2): "written", ("", 4): "y"}
    early = spark.createDataFrame([("a", 1, "bad"), ("a", 2, None), ("a", 3, None)], "k string, o int, reason string")
    assert {r.o: r.outcome for r in dedup.first_valid(early, "k", "o", "reason").collect()} == {1: "bad", 2: "written", 3: "duplicate"}


def test_blocked_by_and_without(spark):
    d, ref = spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string"), spark.createDataFrame([("a", i) for i in (5, 3, 9, 7, 1)], "k string, ordinal int")
    r = dedup.blocked_by(d, ref, "k").collect()
    assert [(x.i, x.n_references, x.first_references) for x in r] == [(1, 5, [1, 3, 5])]
    assert _rows(dedup.without(d, ref, "k"), "i") == [(2,)]


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_near_scores_against_brute_force(spark, threshold):
    rng = random.Random(4)

    def text(n):
        return "".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(n))

    left, right = [text(rng.randrange(4, 40)) for _ in range(60)], [text(30) for _ in range(20)]
    right += [t[: len(t) * 3 // 4] + text(3) for t in left[:25]] + left[25:30] + ["x" * 40, ""]
    left += ["x" * 44, "", "y" * 7]
    want = {}
    for a in set(left):
        scores = [(len(ngrams(a, 5) & ngrams(b, 5)) / len(ngrams(a, 5) | ngrams(b, 5)), b) for b in set(right) if len(a) >= 8 and len(b) >= 8]
        if scores and max(scores)[0] >= threshold:
            want[a] = max(scores)
    d = decontam.near_scores(spark.createDataFrame([(x,) for x in left], "k string"), spark.createDataFrame([(x,) for x in right], "r string"), "k", "r", threshold)
    assert {x.k: (x.jaccard, x.r) for x in d.collect()} == want and len(want) > 5


def test_samples(spark):
    d = spark.range(5000).selectExpr("cast(id as string) as u", "if(id % 3 = 0, null, concat('s', id % 7)) as a", "'x' as b")
    half, quarter = ({r.u for r in sampling.nested_subset(d, ["a", "b"], "u", s).collect()} for s in (0.5, 0.25))
    assert quarter < half
    want, groups = set(), {}
    for r in d.withColumn("f", stable_fraction(":", F.lit("42"), F.lit("ablation_scale"), F.col("u"))).collect():
        groups.setdefault(r.a, []).append((r.f, r.u))
    for g in groups.values():
        want |= {u for _, u in sorted(g)[: -(-len(g) // 4)]}
    assert quarter == want
    assert sampling.nested_subset(d, ["a"], "u", 0).count() == 0 and sampling.nested_subset(d, ["a"], "u", 1).count() == 5000
    h = sampling.holdout(d, "u", 100)
    assert h.filter("split = 'val'").count() == 100 and sampling.holdout(d, "u", 0).filter("split = 'val'").count() == 0 and sampling.holdout(d.limit(0), "u", 5).count() == 0
    assert {r.u for r in sampling.pool_sample(d, "u", 50).collect()} < {r.u for r in sampling.pool_sample(d.union(d), "u", 80).collect()}


def test_votes_buckets_and_pairs(spark):
    rows = [("p", i, a) for i, a in enumerate(["A", "B", "A", None])] + [("q", i, a) for i, a in enumerate(["B", "A", "A", "B"])] + [("r", i, None) for i in range(3)]
    v = evaluation.majority_vote(spark.createDataFrame(rows, "g string, o int, a string"), ["g"], "a", "o")
    assert _rows(v, "g", "majority", "votes", "answered") == [("p", "A", 2, 3), ("q", "B", 2, 4), ("r", None, 0, 0)] or {r.g: r.majority for r in v.collect()} == {"p": "A", "q": "B", "r": None}
    b = spark.createDataFrame([(8, "easy"), (6, "medium"), (4, "hard"), (3, "hard"), (0, "zero")], "k int, w string").withColumn("b", evaluation.bucket(F.col("k"), F.lit(8)))
    assert b.filter("b != w").count() == 0
    pairs = spark.createDataFrame([(True, True, "x"), (True, False, "x"), (True, False, None), (False, True, "y"), (False, False, "y")], "a boolean, b boolean, s string")
    r = evaluation.paired(pairs, "a", "b").first()
    assert (r.both_right, r.only_a, r.only_b, r.both_wrong, round(r.delta, 6)) == (1, 2, 1, 1, 20.0)
    s = {(x.slice, x.value): (x.n, x.n_right) for x in evaluation.accuracy_by_slice(pairs, "a", ["s"]).collect()}
    assert s == {("overall", "all"): (5, 3), ("s", "x"): (2, 2), ("s", "y"): (2, 0)}
    c = spark.createDataFrame([("A", ["A", "A"], True), ("A", ["A", None], False), (None, [None], True), ("A", [], False)], "g string, v array<string>, w boolean")
    assert c.filter(evaluation.consistent(F.col("g"), F.col("v")) != F.col("w")).count() == 0
    assert evaluation.paired(pairs.limit(0), "a", "b").first().p_exact == 1.0


def test_credit(spark):
    p = spark.createDataFrame([("c", k, x) for k, x in enumerate([0.2, 0.5, 0.4, 0.9])], "c string, k int, phi double")
    assert [round(r.credit, 6) for r in credit.segment_credit(p, "c", "k", "phi").orderBy("k").collect()] == [0.3, -0.1, 0.5]
    ranges = spark.createDataFrame([("c", 1, 2, 0.3), ("c", None, None, -0.1), ("c", 5, 9, 0.5)], "c string, first int, last int, credit double")
    t = credit.token_credit(ranges, spark.createDataFrame([("c", 8), ("e", 0)], "c string, length int"), "c").orderBy("position").collect()
    assert [r.credit for r in t] == [0.0, 0.3, 0.3, 0.0, 0.0, 0.5, 0.5, 0.5]
    a = credit.group_advantage(spark.createDataFrame([("g", 1.0), ("g", 0.0), ("h", 1.0)], "g string, r double"), "g", "r")
    assert _rows(a, "g", "advantage", "unanimous") == [("g", -0.5, False), ("g", 0.5, False), ("h", 0.0, True)]
    ranks = credit.average_ranks(spark.createDataFrame([(1, v) for v in (10, 30, 20, 30)], "g int, v int"), ["g"], "v", "r")
    assert _rows(ranks, "v", "r") == [(10, 1.0), (20, 2.0), (30, 3.5), (30, 3.5)]
    letters = spark.createDataFrame([("p", "A", 0.2, "AC", "ABC"), ("p", "B", 0.6, "AC", "ABC"), ("p", "Z", 0.2, "AC", "ABC"), ("q", "A", 0.0, "A", "AB"), ("r", "A", 1.0, "F", "AB")], "p string, l string, m double, g string, v string")
    assert {r.p: round(r.phi, 6) for r in credit.letter_probability(letters, "p", "l", "m", "g", "v").collect()} == {"p": 0.25, "q": 0.0, "r": 0.0}


def test_audit_and_copies(spark):
    opts = [("A", "甲"), ("B", "乙"), ("C", "丙")]
    rows = [(1, "u1", "A", "cmb_train"), (2, "u1", "A", "cmb_train"), (3, "u1", "B", "cmb_train"), (4, "u2", "A", "cmb_train"), (5, "u2", "C", "cmb_train"), (6, "u2", "C", "cmexam"), (7, "u3", "A", "cmb_train"), (8, "u4", "AB", "cmb_train")]
    d = spark.createDataFrame([(i, u, opts, ["甲", "乙", "丙"], g, s) for i, u, g, s in rows], "row_id int, unit_hash string, options array<struct<letter:string,text:string>>, option_keys array<string>, gold string, source string")
    d = audit.with_content(d)
    conflicts = audit.label_conflicts(d.filter("row_id != 6"))
    assert _rows(conflicts, "unit_hash", "resolution", "keep_content", "variants") == [("u1", "majority", "甲", 2), ("u2", "tie", None, 2)]
    faults = spark.createDataFrame([("u3", "figure_reference"), ("u4", "style")], "unit_hash string, reason string")
    got = {r.row_id: r.outcome for r in audit.apply_audit(d, conflicts, structural=faults).collect()}
    assert got == {1: "kept", 2: "kept", 3: "minority_label", 4: "tie_conflict", 5: "tie_conflict", 6: "kept", 7: "figure_reference", 8: "kept"}
    q = spark.createDataFrame([(1, "问一", opts, "AB", "问一"), (2, "问二", [*opts[:2], ("C", "以上都是")], "AB", "问二"), (3, "问三", opts, "A", "问三"), (4, "问一", opts, "AB", "问一")], "row_id int, question string, options array<struct<letter:string,text:string>>, gold string, stem string")
    one, three = audit.shuffle_copies(q, 1, multiple_only=True, copies_last=True), audit.shuffle_copies(q, 3, multiple_only=True, copies_last=True)
    assert _rows(one, "row_id", "copy") == [(1, 0), (1, 1), (2, 0), (3, 0)] and three.count() == 6
    # every safe question is copied, single ones too; a copy comes before the rows after its original
    every = audit.shuffle_copies(q, 1)
    assert _rows(every, "row_id", "copy") == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]
    clash = every.filter("copy = 1 and row_id = 1").select(F.lit(9).alias("row_id"), "question", "options", F.col("answer").alias("gold"), "stem")
    assert _rows(audit.shuffle_copies(q.union(clash), 1), "row_id", "copy")[:2] == [(1, 0), (1, 1)] and (9, 0) not in _rows(audit.shuffle_copies(q.union(clash), 1), "row_id", "copy")
    assert (9, 0) in _rows(audit.shuffle_copies(q.union(clash), 1, copies_last=True), "row_id", "copy")
    assert {r.sample_id for r in one.collect()} < {r.sample_id for r in three.collect()}
    for r in three.filter("row_id = 1").collect():
        assert {o.text for o in r.options if o.letter in r.answer} == {"甲", "乙"}


def test_harness(spark):
    f = harness.funnel(spark.createDataFrame([(1,), (5,), (9,), (None,)], "x int"), [("null", F.col("x").isNull()), ("large", F.col("x") > 4)]).first()
    assert (f.selected, f.requested, f["null"], f.large) == (4, 1, 1, 2)
    replies = spark.createDataFrame([("x [3,3] y [1, 3,5，2]",), ("[7]",), ("none",), ("[]",), (None,)], "t string")
    assert [r.s for r in replies.select(harness.parsed_scores(F.col("t")).alias("s")).collect()] == [[1, 3, 5, 2], [7], None, None, None]
    spans = spark.createDataFrame([([1, 2], 2), ([1], 2), ([1, 9], 2), (None, 2)], "s array<int>, n int").withColumn("p", F.array_repeat(F.lit(0), F.col("n")))
    assert [r.d for r in spans.select(harness.score_filters(F.col("s"), F.col("p"))["drop_reason"].alias("d")).collect()] == [None, "count_matches", "range_ok", "unparsed"]
    b = spark.createDataFrame([(i / 100, 1.0) for i in range(100)], "f double, c double")
    assert sorted(r.f for r in harness.within_budget(b, "f", "c", 30.0).collect()) == [i / 100 for i in range(30)]
    items = spark.createDataFrame([("a", "s1", 0.1), ("a", "s2", 0.2), ("b", "s3", 0.0), ("c", "s4", 0.3)], "k string, sample_id string, f double")
    chosen, counts = harness.select_items(items, spark.createDataFrame([("b",)], "k string"), "k", "f", 5)
    assert _rows(chosen, "sample_id") == [("s1",), ("s4",)] and tuple(counts.first()) == (1, 1)
    with pytest.raises(ValueError, match="evaluation item"):
        harness.refuse_if_any(items, spark.createDataFrame([("b",)], "k string"), "k")
    assert harness.refuse_if_any(items, spark.createDataFrame([("z",)], "k string"), "k") is items
    cache = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, o int, reply string")
    assert {r.k: r.answer and r.answer.reply for r in harness.cached(items, cache, "k", "o").collect()} == {"a": "new", "b": None, "c": None}
    assert _rows(harness.cache_misses(items, cache, "k"), "k") == [("b",), ("c",)]

    def fake(messages):
        if messages[0]["content"] == "fail":
            raise RuntimeError("no")
        return messages[0]["content"].upper()

    req = spark.createDataFrame([("1", [("user", "hi")]), ("2", [("user", "fail")])], "request_hash string, messages array<struct<role:string,content:string>>")
    assert _rows(harness.complete(req, fake), "request_hash", "reply", "error") == [("1", "HI", None), ("2", None, "RuntimeError: no")]
    import hashlib
    import json

    m = [{"role": "user", "content": 'a "q" \n 问'}]
    want = hashlib.sha256(json.dumps({"messages": m, "max_tokens": 8, "temperature": 0.5}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    one = spark.createDataFrame([([("user", m[0]["content"])],)], "m array<struct<role:string,content:string>>").select(harness.request_hash(F.col("m"), 8, 0.5).alias("h")).first().h
    assert one == want
    opts = spark.createDataFrame([("问", [("A", "甲")], "A", "依据一。 结论。", [(0, 5), (5, 8)])], "q string, o array<struct<letter:string,text:string>>, g string, e string, s array<struct<start:int,end:int>>")
    made = opts.select(harness.scoring_request(F.col("q"), F.col("o"), F.col("g"), F.col("e"), F.col("s"), "{question}|{options}|{gold}|{sentences}|{count}").alias("t")).first().t
    assert made == "问|A. 甲|A|[1] 依据一。\n[2] 结论。|2"


def test_training_tables(spark):
    from dataclasses import dataclass

    from examloom.operators import training

    s = spark.createDataFrame([(i,) for i in range(0, 7)], "s int").select(training.normalized_score(F.col("s")).alias("x"))
    assert [r.x for r in s.collect()] == [None, 0.0, 0.25, 0.5, 0.75, 1.0, None]
    e = spark.createDataFrame([(1.0, 3.0, True), (5.0, 0.0, False)], "p double, t double, v boolean")
    assert e.agg(training.masked_squared_error(F.col("p"), F.col("t"), F.col("v")).alias("m")).first().m == 4.0
    t = spark.createDataFrame([(0, i, i in (1, 4), i > 2, i in (2, 6)) for i in range(8)] + [(1, 0, True, False, False)], "e int, p int, m boolean, s boolean, x boolean")
    got = {(r.e, r.p) for r in training.answer_mask(t, "e", "p", "m", "s", "x").filter("in_answer").collect()}
    assert got == {(0, 4), (0, 5)}
    ids = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, []), (1, [])], "b int, ids array<int>")
    assert sorted(tuple(r.ids) for r in training.padded(ids, "b", "ids", 9).collect()) == [(), (), (1, 2, 3), (4, 9, 9)]
    ok, dropped = training.usable(ids, F.size("ids"), 2, F.size("ids") > 0)
    assert ok.count() == 1 and {r.reason: r.n for r in dropped.collect()} == {"too_long": 1, "misaligned": 2}

    @dataclass
    class Settings:
        a: int = 1

    assert training.configured({"a": 2}, Settings).a == 2
    with pytest.raises(ValueError, match="unknown settings: b, c"):
        training.configured({"c": 1, "b": 2}, Settings)


def test_average_ranks_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.choice([None, *range(40)]), i) for i in range(900)]
    d = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r.i: r.rank for r in credit.average_ranks(d, ["g"], "v", "rank").collect()}
    for name in {g for g, _, _ in rows}:
        values = sorted((-1 if v is None else v) for g, v, _ in rows if g == name)
        for g, v, i in rows:
            if g == name:
                at = [k for k, x in enumerate(values, 1) if x == (-1 if v is None else v)]
                assert got[i] == sum(at) / len(at)


def test_budget_puts_only_one_slice_in_order(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), float(rng.randrange(0, 5))) for i in range(700)]
    d = spark.createDataFrame(rows, "i int, f double, c double")
    for limit in (0.0, 1.0, 333.0, 1e9):
        want, spent = set(), 0.0
        for i, _, c in sorted(rows, key=lambda r: r[1]):
            if spent < limit:
                want.add(i)
            spent += c
        for slices in (1, 16, 4096):
            assert {r.i for r in harness.within_budget(d, "f", "c", limit, slices).collect()} == want


def test_first_seen_keeps_the_whole_row(spark):
    d = spark.createDataFrame([("a", 2, "x", [1]), ("a", 1, None, None), (None, 5, "n", [2]), (None, 4, "m", [3])], "k string, o int, t string, l array<int>")
    assert _rows(dedup.first_seen(d, "k", "o").fillna("-", ["k", "t"]), "k", "o", "t", "l") == [("-", 4, "m", [3]), ("a", 1, "-", None)]
