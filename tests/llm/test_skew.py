"""A third of all rows under one key: results stay whole."""

from pyspark.sql import functions as F

from examloom.llm._common import hot_keys, salted_join, unit_hash
from examloom.llm.quotas import sample_to_quotas
from examloom.llm.related_splits import related_units, split_related


def test_salted_join_equals_the_plain_one(spark):
    rows = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 500)) as k", "'x' as n2")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("k != 'k7'")
    assert [r.k for r in hot_keys(groups, ["k"], "n").collect()] == ["hot"]
    for how in ("inner", "left"):
        got = salted_join(rows, groups, ["k"], "n", F.col("id"), how)
        want = rows.join(groups, "k", how)
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(want.columns)
        assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))


def test_unit_hash_is_uniform_and_stable(spark):
    d = spark.range(20000).select(unit_hash(F.lit(3), "id").alias("u"))
    lo, hi, mean = d.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= lo < 0.001 and 0.999 < hi < 1 and abs(mean - 0.5) < 0.01


def test_hot_cell_and_hot_unit(spark):
    rows = spark.range(9000).selectExpr(
        "id as row_id", "if(id % 11 = 0, null, concat('s', if(id % 3 = 0, id, id % 4000))) as sample_id", "if(id % 3 = 0, 'aaa', concat('u', id % 2500)) as unit", "if(id % 3 = 0, 'hot', 'other') as exam_type", "'x' as question_type"
    )
    targets = spark.createDataFrame([("p", "hot", "x", 0.5, 0, 3000), ("p", "other", "x", 0.5, 0, 3000)], "plan_name string, exam_type string, question_type string, target_share double, min_rows long, sample_rows long")
    sample, report = sample_to_quotas(rows, targets)
    assert {r.exam_type: r.selected for r in report.collect()} == {"hot": 1500, "other": 1500} and sample.count() == 3000
    pairs = related_units(rows)
    assert pairs.filter("unit = 'aaa' and smallest != 'aaa'").count() == 0
    split = split_related(rows, spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, target_share double"))
    assert split.count() == 9000 and split.join(rows, "row_id").filter("unit = 'aaa'").select("split").distinct().count() == 1
