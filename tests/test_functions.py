"""Answers, prompts, rewards, segments and statistics against known values."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from examloom.functions import answers, prompts, rewards, segments, stats, text

L = "ABCDE"


def _map(spark, values, make, kind="string"):
    """The values of a column function over a list."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strict_answer(spark):
    assert _map(spark, ["D, A", "AA", "F", "", None, "bd", "A、C/E", "A?"], lambda v: answers.strict_answer(v, F.lit(L))) == ["AD", None, None, None, None, "BD", "ACE", None]
    assert _map(spark, ["F", "a b"], answers.strict_answer) == ["F", "AB"]


def test_other_normalisers(spark):
    assert _map(spark, ["ａＣ-C", None, "none", "答案：B"], answers.scorer_answer) == ["AC", "", "E", "B"]
    assert _map(spark, ["ca", None, "Z"], answers.letter_set) == [["A", "C"], [], ["Z"]]
    labels = F.array(*[F.lit(c) for c in "ABC"])
    got = _map(spark, ["c a", "aa", "AF", "", "A1"], lambda v: answers.distinct_answer(v, labels))
    assert [(r.answer, r.reason) for r in got] == [("AC", None), ("A", None), (None, "answer_not_in_options"), (None, "invalid_answer_format"), (None, "invalid_answer_format")]


PREDICTED = [("C", "C"), ("答案：C\n解析：理由", "C"), ("分析：理由\n最终答案：C", "C"), ("解析：理由\n答案：C", "C"), ("答案：A\n解析：先猜测。\n最终答案：B", None), ("答案: b, d \n", "BD"), ("  ", None), (None, None), ("答案：F", None)]


def test_predicted_answer(spark):
    assert _map(spark, [a for a, _ in PREDICTED], lambda v: answers.predicted_answer(v, F.lit(L))) == [b for _, b in PREDICTED]


def test_reference_target(spark):
    got = _map(spark, ["ACD", "答案：B\n解析：医学解释", "分析：医学解释\n最终答案：D", "解析：医学解释\n答案：A", "答案：B", " ", "解析：x\n答案：ZZ"], lambda v: answers.reference_target(v, F.lit(L)))
    assert [(r.answer, r.answer_format, r.explanation) for r in got[:4]] == [("ACD", "letters_only", ""), ("B", "answer_with_analysis", "医学解释"), ("D", "analysis_with_final_answer", "医学解释"), ("A", "explanation_with_answer", "医学解释")]
    assert [r.reason for r in got] == [None] * 4 + ["unsupported_assistant_target", "empty_assistant_target", "invalid_assistant_answer"]


def test_parse_completion(spark):
    cases = ["解析：依据。\n答案：B", "答案：B", "B", "解析：依据\n答案：A\n所以\n答案：B", "解析：依据。\n答案：BA", "解析：没有答案"]
    cot = _map(spark, cases, lambda v: answers.parse_completion(v, "cot", F.lit(L)))
    assert [(r.answer, r.strict, r.used_cot, r.analysis_chars) for r in cot] == [("B", True, True, 3), ("B", False, False, 0), (None, False, False, 0), (None, False, True, 10), ("AB", False, True, 3), (None, False, True, 0)]
    assert [(r.answer, r.strict, r.used_cot) for r in _map(spark, cases[:2], lambda v: answers.parse_completion(v, "adaptive", F.lit(L)))] == [("B", True, True), ("B", True, False)]
    assert [r.answer for r in _map(spark, ["B"], lambda v: answers.parse_completion(v, "cot", F.lit(L), True))] == ["B"]
    direct = _map(spark, ["D", "答案：D", "DA", "x"], lambda v: answers.parse_completion(v, "direct", F.lit(L)))
    assert [(r.answer, r.strict) for r in direct] == [("D", True), ("D", False), ("AD", False), (None, False)]
    with pytest.raises(ValueError):
        answers.parse_completion(F.lit("x"), "other", F.lit(L))


def test_extract_choice(spark):
    texts = ["答案是 c、a", "ＡＢ。", "我选择B而不是D", "无", "C"]
    assert _map(spark, texts, lambda v: answers.extract_choice(v, F.lit(L), F.lit(True))) == ["AC", "AB", "B", "", "C"]
    assert _map(spark, texts, lambda v: answers.extract_choice(v, F.lit(L), F.lit(False))) == ["C", "A", "B", "", "C"]


OPTIONS = [("A", "甲"), ("B", "乙"), ("C", "丙"), ("D", "丁"), ("E", "戊")]
Q = "question string, options array<struct<letter:string,text:string>>, answer string"


def _q(spark, options=OPTIONS, question="患者，女，10岁，下列错误的是", answer="BD"):
    return spark.createDataFrame([(question, options, answer)], Q)


def test_prompt_round_trip_and_ids(spark):
    d = _q(spark, [*OPTIONS[:4], ("E", "")])
    for mode in ("direct", "cot", "adaptive", "legacy_explain"):
        user = prompts.render_user(F.col("question"), F.col("options"), mode, F.lit("本题是多项选择题"))
        r = d.select(prompts.parse_user(user).alias("p"), "question", "options", prompts.valid_letters(user).alias("v")).first()
        assert (r.p.question, [tuple(o) for o in r.p.options], r.p.hint, r.p.instruction) == (r.question, [tuple(o) for o in r.options], "本题是多项选择题", prompts.SUFFIX[mode])
        assert r.v == "ABCDE"
    m = prompts.training_messages(F.col("question"), F.col("options"), F.col("answer"))
    r = d.select(text.sample_id(m).alias("a"), text.sample_id(prompts.prompt_messages(F.col("question"), F.col("options"), "direct")).alias("b"), m.alias("m")).first()
    assert r.a == r.b and len(r.a) == 64 and [x.role for x in r.m] == ["system", "user", "assistant"]
    bad = spark.createDataFrame([("题目：\nx\n\n选项：\nA. 1\nC. 2\n\n请",), ("no layout",)], "c string").select(prompts.parse_user(F.col("c")).alias("p")).collect()
    assert bad[0].p.options is None and bad[1].p.question is None


def test_permutations(spark):
    p = F.array(*[F.lit(i) for i in (3, 0, 4, 1, 2)])
    r = _q(spark).select(prompts.remap_answer(F.lit("D"), p).alias("d"), prompts.remap_answer(F.lit("BDE"), p).alias("bde"), prompts.unmap_answer(F.lit("ACD"), p).alias("back"), prompts.unmap_answer(F.lit(None).cast("string"), p).alias("none"), prompts.unmap_answer(F.lit("F"), p).alias("out"), prompts.permute_options(F.col("options"), p).alias("o")).first()
    assert (r.d, r.bde, r.back, r.none, r.out) == ("A", "ACD", "BDE", None, None) and [o.text for o in r.o] == ["丁", "甲", "戊", "乙", "丙"]
    df = spark.createDataFrame([(n, f"k{i}") for n in (2, 3, 5) for i in range(60)], "n int, k string")
    rows = df.select("n", "k", prompts.permutations_by_hash(F.col("n"), 1, F.lit("42"), F.col("k"))[0].alias("p"), prompts.permutations_by_hash(F.col("n"), 3, F.lit("42"), F.col("k")).alias("s")).collect()
    for r in rows:
        assert sorted(r.p) == list(range(r.n)) and r.p != list(range(r.n)) and r.s[0] == r.p
        assert len({tuple(x) for x in r.s}) == len(r.s) == min(3, math.factorial(r.n) - 1)


def test_slices_and_safety(spark):
    r = _q(spark).select(prompts.slices(F.col("question"), F.col("options"), F.col("answer")).alias("s")).first().s
    assert (r.multi_choice, r.negation, r.case, r.calc, r.long_stem, r.stem_bucket, r.option_count, r.shuffle_safe) == (True, True, True, False, False, "short", 5, True)
    for unsafe in ([("A", "甲"), ("B", "乙"), ("C", "以上都是")], [("A", "甲"), ("B", "A和B"), ("C", "丙")], OPTIONS[:2]):
        assert not _q(spark, unsafe).select(prompts.shuffle_safe(F.col("options")).alias("s")).first().s
    points = ["本题考查的是“肝硬化的诊断”。A错", "本题考查：A（A对）。", "没有", None, "本题考查" + "长" * 61 + "。"]
    assert _map(spark, points, prompts.knowledge_point) == ["肝硬化的诊断", None, None, None, None]


def test_option_lines(spark):
    got = _map(spark, ["A 甲\nB、乙\n C: 丙 丁 \n", "A 甲\nC 乙", "A 甲\nB 甲\nC 乙", "x", None, "A. 甲\nB. 乙\nC. 丙\nD. 丁\nE. 戊\nF. 己"], prompts.parse_option_lines)
    assert [o.text for o in got[0].options] == ["甲", "乙", "丙 丁"]
    assert [r.reason for r in got] == [None, "invalid_option_sequence", "duplicate_option_content", "invalid_option_line", "empty_options", "invalid_option_sequence"]


def test_hints_and_official_prompt(spark):
    df = spark.createDataFrame([("多项选择题", "A"), (None, "AB"), ("", "A"), (None, None)], "t string, a string")
    assert [r.h for r in df.select(answers.type_hint(F.col("t"), F.col("a")).alias("h")).collect()] == ["本题是多项选择题", "本题是多项选择题", "本题是单项选择题", None]
    none = F.lit(None).cast("string")
    p = _q(spark).select(prompts.official_prompt(none, none, none, F.col("question"), F.col("options")).alias("p")).first().p
    assert p.startswith("以下是中国医学考试中的一道选择题。\n") and "A. 甲\nB. 乙" in p


def test_text_keys(spark):
    assert _map(spark, ["Ａ b，　C。", None], text.stem_key) == ["abc", ""]
    assert _map(spark, ["Ａ b，　C。", None], text.question_key) == ["ab,c。", ""]
    assert _map(spark, [" a \n\t b　", None], text.display_text) == ["a b", ""]
    assert _map(spark, ["x  \r\ny\r z \n"], text.explanation_text) == ["x\ny\n z"]
    assert _map(spark, ["abcdef", "abc", "", None], lambda v: text.shingles(v, 5)) == [["abcde", "bcdef"], ["abc"], [], []]
    assert _map(spark, [([], []), (["a"], ["a", "b"])], lambda v: text.jaccard(v["a"], v["b"]), "struct<a:array<string>,b:array<string>>") == [1.0, 0.5]
    import hashlib

    want = int(hashlib.sha256(b"42:order:x").hexdigest()[:12], 16) / 16**12
    assert _map(spark, ["x"], lambda v: text.stable_fraction(":", F.lit("42"), F.lit("order"), v)) == [want]


def test_rewards(spark):
    s = rewards.RewardSettings(mode="cot", think_cost=0.05, think_chars=10, max_tokens=100, cache_tokens=20)
    df = spark.createDataFrame([("B", "B", True, True, 0, 80), ("B", "B", True, True, 10, 90), ("B", "B", True, True, 99, 100), ("B", "D", True, True, 10, 101), ("B", "B", False, True, 10, None)], "a string, g string, s boolean, u boolean, n int, t int")
    cost = [round(r.c, 6) for r in df.select(rewards.think_cost(F.col("a"), F.col("g"), F.col("s"), F.col("u"), F.col("n"), s).alias("c")).collect()]
    assert cost == [0.0, -0.05, -0.15, 0.0, 0.0]
    assert [r.p for r in df.select(rewards.overlong_penalty(F.col("t"), s).alias("p")).collect()] == [0.0, -0.5, -1.0, -1.0, 0.0]
    steps = spark.createDataFrame([("BD", "BDE", 0), ("BD", "BDE", 50), ("BD", "BDE", 100), ("BDE", "BDE", 0), (None, "BDE", 0), ("B", "D", 0)], "a string, g string, s int")
    got = [round(r.p, 6) for r in steps.select(rewards.partial_reward(F.col("a"), F.col("g"), F.col("s"), s).alias("p")).collect()]
    assert got == [0.666667, 0.333333, 0.0, 0.0, 0.0, 0.0]
    for bad in ({"mode": "x"}, {"think_cost": 1.0}, {"answer_weight": 0.0}, {"max_tokens": 0}, {"mode": "cot", "cache_tokens": 99}, {"partial_weight": -1.0}):
        with pytest.raises(ValueError):
            rewards.RewardSettings(**bad)


CLAUSES = [
    ("患者发热三天伴有咳嗽，查体可见肺部湿啰音。诊断为肺炎链球菌肺炎！", ["患者发热三天伴有咳嗽，", "查体可见肺部湿啰音。", "诊断为肺炎链球菌肺炎！"]),
    ("因此，本病应首选青霉素治疗。对。其他药物均为次选方案", ["因此，本病应首选青霉素治疗。对。", "其他药物均为次选方案"]),
    ("白细胞计数1,000以下者（A错；B对）应住院观察。", ["白细胞计数1,000以下者（A错；B对）应住院观察。"]),
    ("短，", ["短，"]), ("一句短。后面这一句话比较长一些。", ["一句短。后面这一句话比较长一些。"]),
]


@pytest.mark.parametrize("whole,parts", CLAUSES)
def test_clauses(whole, parts):
    assert [whole[a:b] for a, b in segments.spans_of(whole)] == parts


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="患者，。！?;\n（）“”ab1, 　", max_size=120), st.sampled_from(["clause", "sentence"]), st.integers(0, 12))
def test_spans_tile_the_text(whole, level, least):
    spans = segments.spans_of(whole, least, level)
    assert "".join(whole[a:b] for a, b in spans) == whole and all(a < b for a, b in spans)


def test_segment_columns(spark):
    df = spark.createDataFrame([("解析：" + CLAUSES[0][0] + "\n答案：B",), ("B",), ("x\n答案：C",), ("解析：只有解析",)], "t string")
    r = [x.r for x in df.select(segments.rationale_of(F.col("t")).alias("r")).collect()]
    assert [(x.start, x.rationale) for x in r] == [(3, CLAUSES[0][0]), (0, ""), (0, "x"), (3, "只有解析")]
    spans = df.select(segments.segment_spans(F.lit(CLAUSES[0][0])).alias("s")).first().s
    assert [tuple(x) for x in spans] == segments.spans_of(CLAUSES[0][0])
    eleven = spark.createDataFrame([([Row(start=i, end=i + 1) for i in range(11)],)], "s array<struct<start:int,end:int>>")
    m = [tuple(x) for x in eleven.select(segments.merge_spans(F.col("s"), 4).alias("m")).first().m]
    assert len(m) == 4 and m[0][0] == 0 and m[-1][1] == 11 and all(a[1] == b[0] for a, b in zip(m, m[1:]))


def test_score_reasons(spark):
    ok = [(0, 2, 3), (2, 4, 5)]
    rows = [("abcd", "解析：abcd\n答案：A", s) for s in (ok, [], [(1, 4, 3)], [(0, 1, 3), (2, 4, 3)], [(0, 4, 6)])] + [("abcd", "other", ok), ("ab�d", "ab�d", ok)]
    df = spark.createDataFrame(rows, "e string, t string, s array<struct<start:int,end:int,score:int>>")
    got = [r.r for r in df.select(segments.score_reason(F.col("e"), F.col("t"), F.col("s")).alias("r")).collect()]
    assert got == [None, "no_sentences", "spans_do_not_cover", "spans_not_contiguous", "score_out_of_range", "explanation_not_in_target", "garbled_text"]


def test_statistics(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (3, 3), (796, 398), (469, 249), (80, 148), (100_000, 99_000)], "b long, c long")
    got = [r.p for r in df.select(stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()]
    want = [min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0 for b, c in ((5, 0), (0, 0), (3, 3), (796, 398), (469, 249), (80, 148))]
    assert all(abs(a - b) <= 1e-9 * b for a, b in zip(got, want)) and 0.02 < got[-1] < 0.03
    w = spark.createDataFrame([(8824, 11200), (0, 0)], "k long, n long").select(stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert round(w[0].w.low * 100, 2) == 78.02 and round(w[0].w.high * 100, 2) == 79.53 and tuple(w[1].w) == (0.0, 0.0, 0.0)
    assert stats.mcnemar_chi2(0, 0) == (0.0, 1.0) and stats.bootstrap_accuracy(0, 0) == (0.0, 0.0) and stats.bootstrap_delta((0, 0, 0, 0)) == (0.0, 0.0, 0.0)
    point, low, high = stats.bootstrap_delta((9000, 469, 249, 1482), 2000)
    assert abs(point - 220 / 11200 * 100) < 1e-9 and 1.3 < low < point < high < 2.6
    lo, hi = stats.bootstrap_accuracy(940, 1120, 2000)
    assert lo < 940 / 1120 < hi
    e = spark.createDataFrame([(11200, 0.02), (11200, 0.0)], "n long, d double").select(stats.detectable_effect(F.col("n"), F.col("d")).alias("e")).collect()
    assert round(e[0].e, 2) == 0.37 and e[1].e == math.inf
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double").agg(stats.safe_corr("x", "y").alias("c")).first().c
    assert same is None
    p = spark.createDataFrame([(list(range(1, 31)),), ([],)], "v array<int>").select(stats.lower_percentile(F.col("v"), 0.95).alias("p")).collect()
    assert [r.p for r in p] == [28, 0]


def test_shingle_hashes_are_those_of_the_shingles(spark):
    texts = ["", None, "甲", "甲乙丙丁戊", "甲乙丙丁戊己", "a𠀀b😀c\nd e", "aaaaaaaa", "x" * 500]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    from examloom.functions.text import shingle_hashes, shingles

    for r in d.select(F.array_sort(F.array_distinct(shingle_hashes(F.col("t")))).alias("a"), F.array_sort(F.transform(shingles(F.col("t")), lambda g: F.xxhash64(g))).alias("b")).collect():
        assert r.a == r.b
