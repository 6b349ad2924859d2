"""Tokens, spans, examples and variants on small inputs."""

import pytest
from pyspark.sql import functions as F

from examloom.operators import alignment, variants


def test_token_ranges(spark):
    # eight tokens of "ab" and so on over 11 characters; two tokens end at 4, of which the first covers character 3
    d = spark.createDataFrame([([2, 4, 4, 7, 11], [(0, 1), (1, 5), (4, 4), (5, 12), (3, 4), (10, 11)])], "e array<int>, s array<struct<start:int,end:int>>")
    got = d.select(alignment.token_ranges(F.col("e"), F.col("s")).alias("r")).first().r
    assert [x and (x.first, x.last) for x in got] == [(0, 0), (0, 3), None, None, (1, 1), (4, 4)]
    none = spark.createDataFrame([([], [(0, 1)])], "e array<int>, s array<struct<start:int,end:int>>")
    assert none.select(alignment.token_ranges(F.col("e"), F.col("s")).alias("r")).first().r == [None]


def _encode(spark, explanation, content, sentences, limit=50, width=2):
    text = "PP" + content
    starts = list(range(0, len(text), width))
    row = [(list(range(100, 100 + len(starts))), starts, [min(s + width, len(text)) for s in starts], content, explanation, sentences)]
    d = spark.createDataFrame(row, "ids array<int>, starts array<int>, ends array<int>, content string, explanation string, s array<struct<start:int,end:int,score:int>>")
    c = F.col
    return d.select(alignment.encoded_example(c("ids"), c("starts"), c("ends"), F.lit(2), c("content"), c("explanation"), c("s"), limit).alias("e")).first().e


def test_encoded_example(spark):
    e = _encode(spark, "甲乙丙。 丁戊己。", "解：甲乙丙。 丁戊己。答A", [(0, 5, 5), (5, 9, 1)])
    assert e.reason is None and e.labels[0] == -100 and -100 not in e.labels[1:]
    # the first sentence shows characters 2 to 5 of the content, 4 to 7 of the text
    assert e.positions == [3, 6] and e.targets == [1.0, 0.0] and e.weights == [1.0, 1.0, 5.0, 5.0, 1.0, 1.0, 1.0, 1.0]
    assert _encode(spark, "甲乙", "无关", [(0, 2, 3)]).reason == "not_in_content"
    assert _encode(spark, "甲  乙", "甲  乙", [(0, 1, 3), (1, 3, 3)]).reason == "empty_segment"
    assert _encode(spark, "甲乙", "甲乙", [(0, 1, 3), (1, 2, 3)]).reason == "too_fine"
    assert _encode(spark, "甲乙", "甲乙", [(0, 5, 3)], limit=1).reason == "too_long"


def test_prompt_and_completion(spark):
    d = spark.createDataFrame([([("system", "s"), ("user", "u"), ("assistant", "a")],), ([("assistant", "a")],), ([],)], "m array<struct<role:string,content:string>>")
    got = [(len(r.p.prompt), [x.content for x in r.p.completion]) for r in d.select(alignment.prompt_and_completion(F.col("m")).alias("p")).collect()]
    assert got == [(2, ["a"]), (0, ["a"]), (0, [])]


def test_variants(spark):
    v = variants.parse_variant("tagged_100:1.0:3:1:x")
    assert (v.name, v.scale, v.copies, v.clean, v.hint) == ("tagged_100", 1.0, 3, True, False)
    with pytest.raises(ValueError, match="a:1"):
        variants.parse_variant("a:1")
    opts = [("A", "甲"), ("B", "乙"), ("C", "丙"), ("D", "丁")]
    rows = [(i, "cmb_train", "original", f"u{i}", "x", "t", f"问{i}", opts, "AB" if i % 2 else "A") for i in range(8)]
    rows += [(20, "cmb_train", "shuffled", "u1", "x", "t", "问1", opts[::-1], "CD"), (30, "cmexam", "original", None, None, None, "他问", opts, "A"), (31, "cmexam", "original", None, None, None, "他问", opts, "A"), (32, None, "original", "", None, None, "再问", opts, "A")]
    d = spark.createDataFrame(rows, "row_id int, source string, variant string, unit string, exam_type string, question_type string, question string, options array<struct<letter:string,text:string>>, gold string")
    build = lambda spec, **k: variants.build_variant(d, variants.parse_variant(spec), **k)
    none = build("none:0:0:0:0").collect()
    assert sorted(r.row_id for r in none) == [30, 32]
    half = {r.row_id for r in build("half:0.5:0:0:0").collect()}
    assert len(half & set(range(8))) == 4 and 20 not in half
    dose = build("dose:1:3:0:0")
    assert dose.filter("copy > 0").count() in range(10, 13) and dose.filter("copy > 0 and length(gold) < 2").count() == 0
    outcomes = spark.createDataFrame([(0, "minority_label"), (1, "tie_conflict"), (2, "kept")], "row_id int, outcome string")
    clean = {r.row_id for r in build("clean:1:0:1:1", outcomes=outcomes).collect()}
    assert clean == {2, 3, 4, 5, 6, 7, 30, 32}
    with pytest.raises(ValueError, match="audit"):
        build("clean:1:0:1:0")
    assert {(r.what, r.value): r.n for r in variants.variant_report(build("full:1:1:0:0")).collect()}[("rows", "all")] == 11


def test_patched_report():
    report = {"seed": 1, "counts": {"train": {"input_rows_read": 10, "written": 8, "rejected": 2, "rejection_counts": {"overlap_with_cmb_test": 1}}}}
    new = variants.patched_report(report, "train", 5, 3, "ff")
    assert new["counts"]["train"] == {"input_rows_read": 10, "written": 5, "rejected": 5, "rejection_counts": {"overlap_with_cmb_test": 4}, "sha256": "ff"} and new["seed"] == 1
    assert report["counts"]["train"]["written"] == 8 and variants.patched_report(report, "val", 1, 1) == report


def test_segment_count(spark):
    d = spark.createDataFrame([(1, "甲乙丙丁戊己庚辛。" * 3), (2, "短。"), (3, None), (4, "甲乙丙丁戊己庚辛。" * 9)], "i int, t string")
    assert [(r.i, r.n_segments) for r in variants.with_segment_count(d, "t", 2, 5).collect()] == [(1, 3)]
    assert sorted(r.i for r in variants.with_segment_count(d, "t").collect()) == [1, 2, 4]
