"""Examples, records and summaries of validation runs."""

import json

from pyspark.sql import functions as F

from examloom.functions import prompts
from examloom.operators import audit, headroom
from examloom.sources import files

OPTIONS = [("A", "甲"), ("B", "乙"), ("C", "丙"), ("D", "丁")]


def _records(spark, tmp_path, n=4):
    q = [(f"患者，第{i}问", OPTIONS, "ABCD"[i % 4] if i % 3 else "AB") for i in range(n)]
    df = spark.createDataFrame(q, "q string, o array<struct<letter:string,text:string>>, a string")
    rows = [json.dumps({"messages": [m.asDict() for m in r.m]}, ensure_ascii=False) for r in df.select(prompts.training_messages(F.col("q"), F.col("o"), F.col("a")).alias("m")).collect()]
    (tmp_path / "v.jsonl").write_text("\n".join(rows), encoding="utf-8")
    return files.load_records(spark, str(tmp_path / "v.jsonl"))


def test_examples(spark, tmp_path):
    r = _records(spark, tmp_path, 8)
    e = headroom.examples(r, "direct")
    assert e.count() == 8
    own, made = r.select("sample_id", F.element_at("messages", 2)["content"].alias("x")), e.select("sample_id", F.element_at("messages", 2)["content"].alias("y"))
    assert own.join(made, "sample_id").filter("x = y").count() == 8
    assert [x.line_no for x in headroom.examples(r, "cot", limit=3).collect()] == [1, 2, 3]
    some = {x.sample_id for x in headroom.examples(r, "direct", limit=3, shuffle_seed=7).collect()}
    assert some < {x.sample_id for x in headroom.examples(r, "direct", limit=6, shuffle_seed=7).collect()} and len(some) == 3
    hints = spark.createDataFrame([(r.first().sample_id, "多项选择题")], "sample_id string, question_type string")
    h = headroom.examples(r, "direct", with_hint=True, hints=hints)
    assert h.filter(F.element_at("messages", 2)["content"].contains("提示：本题是")).count() == 8
    assert e.first().slices.case and e.filter("slices.multi_choice").count() == 3


def test_records_and_summary(spark, tmp_path):
    e = headroom.examples(_records(spark, tmp_path, 2), "direct").orderBy("line_no")
    (a, gold), (b, _) = [(x.sample_id, x.gold) for x in e.collect()]
    assert gold == "AB"
    rows = [(a, "greedy", 0, "AB", None), (b, "greedy", 0, "D", None)]
    rows += [(a, "sample", i, t, None) for i, t in enumerate(["AB", "C", "答案：BA", "zz"])] + [(b, "sample", i, t, None) for i, t in enumerate(["A", "C", "C", "A"])]
    rows += [(a, "permuted", 0, "BC", [3, 0, 1, 2]), (a, "permuted", 1, "AB", [1, 0, 3, 2])]
    c = spark.createDataFrame(rows, "sample_id string, kind string, copy int, text string, permutation array<int>")
    r = {x.sample_id: x for x in headroom.records(e, c, "direct", 4).collect()}
    assert (r[a].greedy_correct, r[a].correct_count, r[a].majority_answer, r[a].bucket, r[a].shuffle_consistent) == (True, 2, "AB", "hard", True)
    assert r[a].sampled_answers == ["AB", "C", "AB", None] and [p.answer_original_letters for p in r[a].permutations] == ["AB", "AB"]
    assert (r[b].greedy_correct, r[b].correct_count, r[b].majority_answer, r[b].bucket, r[b].permutations, r[b].shuffle_consistent) == (False, 0, "A", "zero", None, None)
    s = {x.slice: x for x in headroom.summary(headroom.records(e, c, "direct", 4), 4).collect()}
    o = s["overall"]
    assert (o.questions, o.pass1_greedy, o.pass_at_k, o.sc_at_k, o.sampled_accuracy_mean, o.sharpening_headroom, o.shuffle_consistency_rate, o.shuffle_accuracy) == (2, 0.5, 0.5, 0.5, 0.25, 0.0, 1.0, 1.0)
    assert s["multi_choice"].questions == 1 and s["multi_choice"].pass1_greedy == 1.0 and "negation" not in s


def test_compared(spark):
    schema = "sample_id string, line_no int, greedy_correct boolean, greedy_answer string, slices struct<case:boolean>"
    a = spark.createDataFrame([("x", 1, True, "A", (True,)), ("x", 5, False, "B", (True,)), ("y", 2, True, "A", (False,)), ("z", 3, True, "A", (False,))], schema)
    b = spark.createDataFrame([("x", 1, True, "A", (False,)), ("y", 2, True, "A", (True,)), ("w", 3, True, "A", (False,))], schema)
    got = {r.sample_id: (r["where"], r.a_right, r.b_right) for r in headroom.compared(a, b).collect()}
    assert got == {"x": ("common", False, True), "y": ("common", True, True), "z": ("only_a", True, None), "w": ("only_b", None, True)}


def test_items_and_audit_files(spark):
    user = "题目：\n问\n\n选项：\nA. 甲\nB. 乙\nC. 丙\n\n请"
    turns = [[("user", user), ("assistant", "解析：因为甲。\n答案：A")], [("user", user), ("assistant", "CA")], [("user", "?"), ("assistant", "A")], [("user", user), ("assistant", "不知道")], [("user", user)]]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "i int, messages array<struct<role:string,content:string>>").orderBy("i")
    got = headroom.harness_items(d).collect()
    assert [(r.gold, r.explanation, r.reason) for r in got] == [("A", "因为甲。", None), ("AC", "", None), (None, None, "unparsable"), (None, None, "no_answer"), (None, None, "bad_messages")]
    res = spark.createDataFrame([("h1", "tie", None), ("h2", "majority", ["乙", "甲"])], "hash string, resolution string, keep_content array<string>")
    flags = spark.createDataFrame([("h3", "figure_reference"), ("h4", "style"), (None, "truncated_stem")], "hash string, reason string")
    conflicts, faults = headroom.audit_tables(res, flags)
    rows = spark.createDataFrame([("h1", "x", "cmb_train"), ("h2", "甲", "cmb_train"), ("h2", "乙|甲", "cmb_train"), ("h3", "x", "cmb_train"), ("h4", "x", "cmb_train"), ("h1", "x", "other")], "unit_hash string, content string, source string")
    out = sorted((r.unit_hash, r.content, r.source, r.outcome) for r in audit.apply_audit(rows, conflicts, structural=faults).collect())
    assert [(u, c, o) for u, c, s, o in out] == [("h1", "x", "tie_conflict"), ("h1", "x", "kept"), ("h2", "乙|甲", "kept"), ("h2", "甲", "minority_label"), ("h3", "x", "figure_reference"), ("h4", "x", "kept")]
