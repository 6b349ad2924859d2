from examloom.llm import formatting
from examloom.llm.formatting import collapse_formatting, formatting_members

SCHEMA = "row_id long, question string, options array<struct<letter:string,text:string>>, gold string, first string, f1 int"


def _df(spark, rows):
    return spark.createDataFrame([(i, q, None if o is None else [("ABCDEFG"[j], x) for j, x in enumerate(o)], None, "x", 1) for i, q, o in rows], SCHEMA)


def _groups(spark, rows):
    return sorted((r["first"], r["id"]) for r in formatting_members(_df(spark, rows)).collect() if r["first"] != r["id"])


def test_formatting_does_not_count(spark):
    rows = [
        (5, "Anŭska征阴性，结肠压痛。最符合的是：", ["aPoC(+)且肿大", "2～14天", "体温 37.2℃"]),
        (7, " ANŬSKA征阴性,结 肠　压痛.最符合的是", ["体温37.2℃。", "“2～14”天", "APOC（＋）且肿大", "体温37.2℃"]),
        (9, "Anŭska征阴性结肠压痛最符合的是___", ["体温37.2℃", "aPoC(+)且肿大", "2~14天", " ?"]),
    ]
    assert _groups(spark, rows) == [(5, 7), (5, 9)]


def test_marks_with_a_value_count(spark):
    q = ["水平>21.9", "水平>2.19", "水平<21.9", "水平219", "TOM-7(+)", "TOM-7(-)", "tom7(-)", "血压-5", "血压5", "3-5天", "35天", "1:2", "12", "5%", "5"]
    got = _groups(spark, [(i, x, ["a"]) for i, x in enumerate(q)])
    assert got == [(5, 6)]


def test_nulls_empties_and_sets(spark):
    rows = [(1, None, ["a"]), (2, None, ["a"]), (3, "q", None), (4, "q", []), (5, "Q.", [None, "  "]), (6, "", []), (7, "!", []), (8, "q", ["a", "b"]), (9, "q", ["b", "a", "A"])]
    assert _groups(spark, rows) == [(4, 5), (6, 7), (8, 9)]
    got = {r["first"]: r.copies for r in collapse_formatting(_df(spark, rows)).collect()}
    assert got == {4: 2, 6: 2, 8: 2}
    assert formatting_members(_df(spark, [])).count() == 0


def test_hot_group_is_salted_and_whole(spark, monkeypatch):
    base = spark.range(4000).selectExpr("id as row_id", "if(id % 2 = 0, 'hot', concat('q', id)) as question", "array(named_struct('letter', 'A', 'text', 'x')) as options")
    got = formatting_members(base)
    assert got.count() == 2000 and got.selectExpr("max(first)").first()[0] == 0


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(formatting, "multiset_hash", lambda lane, q, o: F.lit(1).cast("long"))
    rows = [(1, "a", ["x"]), (2, "b", ["x"]), (3, "B", ["x"]), (4, "c", ["x"]), (5, "A.", ["x"])]
    assert _groups(spark, rows) == [(1, 5), (2, 3)]
