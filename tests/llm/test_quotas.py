from examloom.llm.quotas import sample_to_quotas

ROWS = "row_id long, sample_id string, exam_type string, question_type string, unit string, slice int"
TARGETS = "plan_name string, exam_type string, question_type string, target_share double, min_rows long, sample_rows long"


def _rows(spark, n=3000):
    data = [(i, f"s{i % 2500}", "a" if i % 2500 < 2000 else None, "x", None, 1) for i in range(n)]
    return spark.createDataFrame(data + [(n, None, "a", "x", None, 1), (n + 1, "z", "never", "x", None, 1)], ROWS)


def _targets(spark, rows):
    return spark.createDataFrame(rows, TARGETS)


def test_exact_counts_and_deficits(spark):
    t = _targets(spark, [("p", "a", "x", 0.5, 0, 601), ("p", None, "x", 0.4, 0, 601), ("p", "none", "x", 0.1, 3, 601), ("q", "a", "x", 1.0, 5000, 10)])
    sample, report = sample_to_quotas(_rows(spark), t)
    got = {(r.plan_name, r.exam_type): r for r in report.collect()}
    assert (got["p", "a"].quota, got["p", "a"].selected, got["p", "a"].deficit) == (301, 301, 0)
    assert (got["p", None].quota, got["p", None].selected) == (241, 241)
    assert (got["p", "none"].available, got["p", "none"].deficit) == (0, 61)
    assert (got["q", "a"].available, got["q", "a"].selected, got["q", "a"].deficit) == (2000, 2000, 3000)
    rows = sample.collect()
    assert len(rows) == 301 + 241 + 2000 and len({(r.plan_name, r.exam_type, r.sample_id) for r in rows}) == len(rows)
    assert all(r.row_id < 2500 for r in rows)  # the first of repeated records


def test_same_on_any_partitioning(spark):
    t = _targets(spark, [("p", "a", "x", 0.5, 0, 777)])
    one = {tuple(r) for r in sample_to_quotas(_rows(spark).repartition(1), t)[0].collect()}
    two = {tuple(r) for r in sample_to_quotas(_rows(spark).repartition(13), t)[0].collect()}
    assert one == two and len(one) == 389


def test_empty_and_null_targets(spark):
    none = spark.createDataFrame([], ROWS)
    sample, report = sample_to_quotas(none, _targets(spark, [("p", "a", "x", None, None, None), ("p", "b", "x", 0.5, 1, 10)]))
    assert sample.count() == 0
    assert sorted((r.exam_type, r.quota, r.selected) for r in report.collect()) == [("a", 0, 0), ("b", 5, 0)]
    sample, report = sample_to_quotas(_rows(spark, 10), _targets(spark, []))
    assert sample.count() == 0 and report.count() == 0
