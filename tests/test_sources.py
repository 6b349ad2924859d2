"""Readers and writers in temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from examloom.functions import prompts
from examloom.operators.records import conversation_reason, parse_exam_row, parse_sheet_row
from examloom.sources import files, sinks
from examloom.streaming import incremental

OPTIONS = [("A", "甲"), ("B", "乙"), ("C", "丙"), ("D", "丁"), ("E", "戊")]
USER = "题目：\n问\n\n选项：\nA. 甲\nB. 乙\nC. 丙\nD. 丁\nE. 戊\n\n请直接输出正确选项字母；多选题按字母顺序连续输出。"


def _line(answer, user=USER, **more):
    return json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": user}, {"role": "assistant", "content": answer}], **more}, ensure_ascii=False)


def _write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_records(spark, tmp_path):
    six = USER.replace("E. 戊", "E. 戊\nF. 己")
    good = _write(tmp_path / "a.jsonl", _line("CA"), "", _line("F", six))
    p = files.load_records(spark, good).orderBy("line_no").collect()
    assert [(r.line_no, r.target.answer, r.valid_letters, r.is_multi_choice) for r in p] == [(1, "AC", "ABCDE", True), (3, "F", "ABCDEF", False)]
    other = files.load_records(spark, _write(tmp_path / "b.jsonl", _line("B"))).first()
    assert other.sample_id == p[0].sample_id and len(other.sample_id) == 64
    counts = {(r.what, r.value): r.n for r in files.record_counts(files.load_records(spark, good)).collect()}
    assert counts == {("format", "letters_only"): 2, ("kind", "multiple"): 1, ("kind", "single"): 1, ("answer", "AC"): 1, ("answer", "F"): 1}
    for bad, why in ((_line("A", extra=1), "unexpected_keys"), (_line("G"), "unsupported_assistant_target"), (_line(" "), "blank_content"), (_line("A", "no options"), "no_option_letters")):
        with pytest.raises(ValueError, match=f":2: {why}"):
            files.load_records(spark, _write(tmp_path / "c.jsonl", _line("B"), bad))
    with pytest.raises(ValueError, match="2 times"):
        files.load_records(spark, _write(tmp_path / "d.jsonl", _line("A"), _line("B")))
    with pytest.raises(ValueError, match="no records"):
        files.load_records(spark, _write(tmp_path / "e.jsonl", ""))


def test_conversation_reasons(spark):
    turns = [[("user", "q"), ("assistant", "a")], [("user", "q")], [("user", "q"), ("assistant", "a"), ("user", "q")], [("assistant", "a"), ("assistant", "b")], [("tool", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "x\n答案：B")]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "i int, m array<struct<role:string,content:string>>")
    assert [r.r for r in df.orderBy("i").select(conversation_reason(F.col("m")).alias("r")).collect()] == [None, "too_few_messages", "last_is_not_assistant", "early_assistant", "unknown_role", None]
    assert [r.r for r in df.orderBy("i").select(conversation_reason(F.col("m"), None, True).alias("r")).collect()][0] == "no_answer_line"


def test_line_numbers_over_splits(spark, tmp_path):
    path = _write(tmp_path / "long.txt", *[f"line {i} " + "x" * 200 for i in range(1, 3001)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        d = files.read_lines(spark, path)
        assert d.count() == 3000 and d.filter(~F.col("value").startswith(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" ")))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_exam_json_and_reasons(spark, tmp_path):
    def row(i, question="问", answer="B", option=None):
        return {"id": str(i), "question": question, "answer": answer, "option": option if option is not None else dict(OPTIONS[:4]), "question_type": "单项选择题"}

    rows = [
        row(0), row(1, answer="db"), row(2, question=" "), row(3, option={}), row(4, option={"A": "1", "C": "2", "D": "3"}), row(5, option={"A": "1", "B": "", "C": "3", "D": "4"}), row(6, option={"A": "1", "B": "2", "C": ""}),
        row(7, option={"A": "1", "B": "1", "C": "3"}), row(8, answer="BB"), row(9, answer="E"), row(10, answer="E", option=dict(OPTIONS[:4]) | {"E": ""}), row(11, option=dict(OPTIONS[:4]) | {"E": " "}),
    ]
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    d = files.read_exam_json(spark, str(path)).withColumn("p", parse_exam_row(F.col("question"), F.col("option"), F.col("answer"))).orderBy(F.col("id").cast("int")).collect()
    assert [r.p.reason for r in d] == [None, None, "empty_question", "empty_options", "invalid_option_letters", "empty_option_text", "too_few_options", "duplicate_option_text", "invalid_answer", "answer_not_in_options", "answer_on_empty_option", None]
    assert d[1].p.answer == "BD" and d[11].p.has_empty_option and [o.text for o in d[11].p.options] == ["甲", "乙", "丙", "丁", ""]


def test_sheet(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('﻿Question,Options,Answer,Explanation\n问 一,"A 甲\nB 乙\nC 丙",c a,"说""明"\n问二,"A 甲\nB 乙",A,\n', encoding="utf-8")
    d = files.read_sheet(spark, str(path)).withColumn("p", parse_sheet_row(F.col("Question"), F.col("Options"), F.col("Answer"))).collect()
    assert [(r.p.reason, r.p.answer) for r in d] == [(None, "AC"), ("invalid_option_sequence", None)] and d[0].Explanation == '说"明'
    with pytest.raises(ValueError, match="Missing"):
        files.read_sheet(spark, str(path), ("Missing",))


@pytest.mark.parametrize("shape", ["list", "wrapped", "object", "plain"])
def test_polymorphic_records(spark, tmp_path, shape):
    rows = [{"id": "x", "answer": " A "}, {"id": "y", "gold_answer": "B"}, {"id": "z", "answer": " "}]
    data = {"list": rows, "wrapped": {"answers": rows}, "object": {r["id"]: {k: v for k, v in r.items() if k != "id"} for r in rows}, "plain": {"x": "A", "y": "B"}}[shape]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    assert {(r.id, r.answer) for r in files.read_ground_truth(spark, str(path)).collect()} == {("x", "A"), ("y", "B")}


TRUTHS = [
    ({"answers": [{"id": "1", "answer": "A"}, "no record", {"answer": "b"}]}, {("1", "A"), ("3", "B")}),
    ([{"id": "1", "answer": None, "gold_answer": "C"}, {"id": 2, "model_answer": ["A", "C"]}, {"id": "3", "standard_answer": "d, a"}], {("2", "AC"), ("3", "AD")}),
    ({"data": {"answer": "B"}, "q2": {"correct_answer": "ＣＤ"}}, {("data", "B"), ("q2", "CD")}),
    ({"1": "A", "2": "bcd", "3": None, "4": ""}, {("1", "A"), ("2", "BCD")}),
    ([{"id": "x", "answer": "A"}, {"id": "x", "answer": "B"}], {("x", "B")}), ([], set()), ({"items": []}, set()),
]


@pytest.mark.parametrize("data,want", TRUTHS)
def test_ground_truth_layouts(spark, tmp_path, data, want):
    (tmp_path / "t.json").write_text(json.dumps(data), encoding="utf-8")
    assert {(r.id, r.answer) for r in files.read_ground_truth(spark, str(tmp_path / "t.json")).collect()} == want


def test_every_file_has_its_own_layout(spark, tmp_path):
    for i, data in enumerate(([{"answer": "A"}], {"data": [{"id": "b", "answer": "B"}]}, {"c": {"answer": "C"}}, {"data": {"answer": "D"}, "e": {"answer": "E"}}, [])):
        (tmp_path / f"{i}.json").write_text(json.dumps(data), encoding="utf-8")
    got = {(r.id, r.answer) for r in files.predictions(files.read_records(spark, str(tmp_path))).collect()}
    assert got == {("1", "A"), ("b", "B"), ("c", "C"), ("data", "D"), ("e", "E")}
    (tmp_path / "bad.json").write_text('{"a": "A"}', encoding="utf-8")
    with pytest.raises(ValueError, match="bad.json"):
        files.read_records(spark, str(tmp_path))


def test_reference_stems_by_suffix(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "问 A。", "x": 1}, {"question": None}]), encoding="utf-8")
    (tmp_path / "b.csv").write_text("\ufeffQuestion,question\n,问b\n问C,x\n", encoding="utf-8")
    lines = [json.dumps({"question": "问d"}), _line("A"), json.dumps({"messages": [{"role": "user", "content": "free text"}]}), "", json.dumps({"question": None, "messages": []})]
    c = _write(tmp_path / "c.jsonl", *lines)
    got = {(r.stem, r.source.rsplit("/", 1)[-1]) for r in files.read_reference_stems(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.csv"), c]).collect()}
    assert got == {("问a", "a.json"), ("问b", "b.csv"), ("问c", "b.csv"), ("问d", "c.jsonl"), ("问", "c.jsonl")}
    with pytest.raises(ValueError, match="x.txt"):
        files.read_reference_stems(spark, ["x.txt"])


def test_predictions(spark, tmp_path):
    a = _write(tmp_path / "a.jsonl", *[json.dumps({"id": i, "answer": "AC", "prediction": "CA" if i < 30 else "B"}) for i in range(40)])
    assert files.read_predictions(spark, a).filter("right").count() == 30
    b = _write(tmp_path / "b.jsonl", *[json.dumps({"question_id": f"q{i}", "is_correct": "yes" if i % 2 else "no"}) for i in range(10)])
    assert files.read_predictions(spark, b).filter("right").count() == 5
    c = _write(tmp_path / "c.jsonl", json.dumps({"gold": "A", "pred": "A"}), json.dumps({"gold": "", "pred": ""}))
    assert [(r.id, r.right) for r in files.read_predictions(spark, c).orderBy("id").collect()] == [("0", True), ("1", False)]
    e = _write(tmp_path / "e.jsonl", *[json.dumps({"id": i, "correct": x, "exam_type": "t"}) for i, x in enumerate([True, False, 1, 0, None, "TRUE", "no"])])
    assert [(r.id, r.right, r.exam_type) for r in files.read_predictions(spark, e, columns=("exam_type",)).orderBy("id").collect()] == [(str(i), i in (0, 2, 5), "t") for i in range(7)]
    # the first line names the fields; a field that only later lines have does not count
    f = _write(tmp_path / "f.jsonl", json.dumps({"id": "a", "gold": "A", "pred": "A"}), json.dumps({"id": "b", "gold": "A", "pred": "B", "correct": True}))
    assert [(r.id, r.right) for r in files.read_predictions(spark, f).orderBy("id").collect()] == [("a", True), ("b", False)]
    truth = spark.createDataFrame([("0", "B")], "id string, answer string")
    assert files.read_predictions(spark, a, truth).filter("right").count() == 29
    with pytest.raises(ValueError, match="neither"):
        files.read_predictions(spark, _write(tmp_path / "d.jsonl", json.dumps({"x": 1})))
    p = tmp_path / "p.json"
    p.write_text(json.dumps([{"id": "a", "model_answer": "B", "answer": "C"}, {"id": "b", "answer": "D"}]), encoding="utf-8")
    assert {(r.id, r.answer) for r in files.predictions(files.read_records(spark, str(p))).collect()} == {("a", "B"), ("b", "D")}
    p.write_text(json.dumps([{"id": "a", "answer": "C"}, {"id": "a", "answer": "D"}]), encoding="utf-8")
    with pytest.raises(ValueError, match="2 times"):
        files.predictions(files.read_records(spark, str(p)))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("问", OPTIONS, "BD")], "question string, options array<struct<letter:string,text:string>>, answer string")
    made = df.select(prompts.training_messages(F.col("question"), F.col("options"), F.col("answer")).alias("messages"))
    out = str(tmp_path / "out")
    sinks.write_messages(made, out)
    assert files.load_records(spark, out).first().target.answer == "BD" and "问" in spark.read.text(out).first().value
    with pytest.raises(Exception, match="exist"):
        sinks.write_messages(made, out)
    sinks.write_messages(made, out, overwrite=True)
    ids = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    sinks.append_results(ids, str(tmp_path / "res"), "id")
    again = sinks.append_results(spark.createDataFrame([(2, "c"), (3, "d")], "id long, x string"), str(tmp_path / "res"), "id")
    assert sorted((r.id, r.x) for r in again.collect()) == [(1, "a"), (2, "b"), (3, "d")]
    target = str(tmp_path / "table")
    sinks.replace_table(ids, target)
    sinks.replace_table(ids.filter("id = 1"), target)
    assert spark.read.parquet(target).count() == 1 and [p.name for p in tmp_path.iterdir() if ".old" in p.name or ".new" in p.name] == []
    with pytest.raises(Exception):
        sinks.replace_table(ids.selectExpr("assert_true(id > 1) as x"), target)
    assert spark.read.parquet(target).count() == 1
    assert json.loads(sinks.report_json(ids.groupBy("x").count(), seed=42))["seed"] == 42
    sinks.write_groups(spark.createDataFrame([("g", 1 / 3)], "g string, a double"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().a == "0.333333"
    assert files.file_hashes(spark, str(tmp_path / "csv") + "/*.csv").first().bytes > 0
    table = sinks.score_markdown(spark.createDataFrame([("overall", "all", 4, 0.5, 0.15, 0.85)], "slice string, value string, n int, accuracy double, low double, high double"))
    assert table.endswith("| overall | all | 4 | 50.00 | 15.00–85.00 |")


def test_evaluation_export(spark):
    rows = spark.createDataFrame([("s1", "h1", "问", OPTIONS, "B "), ("s2", "h2", "问", OPTIONS, "BD")], "sample_id string, unit_hash string, question string, options array<struct<letter:string,text:string>>, gold string")
    meta = spark.createDataFrame([(2, "h1", "later", "", "", ""), (1, "h1", "药学类", None, "内科", "单选")], "row_id int, unit_hash string, exam_type string, exam_class string, exam_subject string, question_type string")
    got = {r.id: r for r in sinks.evaluation_export(rows, meta).collect()}
    assert (got["s1"].exam_type, got["s1"].exam_class, got["s1"].question_type, got["s1"].answer, got["s1"].option["B"]) == ("药学类", "", "单选", "B", "乙")
    assert (got["s2"].exam_type, got["s2"].question_type) == ("医学", "多项选择题")


def test_reference_stems(spark):
    a, b = spark.createDataFrame([("问 A。",), (None,)], "q string"), spark.createDataFrame([("问a",)], "question string")
    assert {(r.stem, r.source) for r in files.reference_stems([("x", a, "q"), ("y", b, "question")]).collect()} == {("问a", "x"), ("问a", "y")}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 01:00:00"), ("b", "2025-01-01 02:00:00"), ("x", "2025-01-01 02:00:00")], "key string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    blocked = spark.createDataFrame([("x",)], "key string")
    for n in (1, 2):  # a second run finds everything written
        incremental.decontaminate_into(stream, blocked, "key", str(tmp_path / "out"), str(tmp_path / f"cp{n}")).awaitTermination()
        assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    q = incremental.new_records(stream, "key", "at").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.sql("select key from fresh").collect()) == ["a", "b", "x"]
    q = incremental.arrivals(stream, "at", "1 hour", "0 seconds", "key").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp4")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == 4
