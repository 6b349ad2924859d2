"""Every registered query over the smallest tables, against its SQL where it has one."""

import math
import os

import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.8g}") if v else 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return c


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n[1:2].isdigit()])
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(repr([_plain(r[i]) for i in at]) for r in cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["outcome", "n"] and df.count() > 0


def _round_trip_rows(spark, path):
    abc = lambda *t: list(zip("ABCDEFG", t))
    cases = [
        ("问", abc("甲", "乙", "丙"), True, None), ("问\n题", abc("甲", "乙", "丙"), True, None), (" 问", abc("甲", "乙", "丙"), False, None), ("问", abc("甲", "乙\n丙", "丁"), False, "invalid_option_line"), ("问", abc("甲", " 乙", "丙"), False, None),
        ("问", [("A", "甲"), ("C", "乙"), ("B", "丙")], False, "invalid_option_sequence"), ("问", abc("甲", "", "丙"), True, "invalid_option_line"), ("问", abc("甲", None, "丙"), False, "invalid_option_line"), ("问", [("a", "甲"), ("b", "乙"), ("c", "丙")], False, "invalid_option_line"),
        ("问", [], False, "empty_options"), ("  ", abc("甲", "乙", "丙"), False, "empty_question"), (None, abc("甲", "乙", "丙"), None, None), ("问", None, None, None),
    ]
    rows = [(i, q, o, "A") for i, (q, o, *_) in enumerate(cases)]
    spark.createDataFrame(rows, "row_id long, question string, options array<struct<letter:string,text:string>>, gold string").write.parquet(f"{path}/build_ablation_sets.parquet")
    return cases


def test_round_trips_of_every_row(spark, sf, tmp_path):
    cases = _round_trip_rows(spark, tmp_path)
    whole = [i for i, c in enumerate(cases) if c[0] is not None and c[1] is not None]
    assert {r.row_id: r.same for r in QUERIES["prompt_round_trip_all"](spark, str(tmp_path)).collect()} == {i: cases[i][2] for i in whole}
    assert {r.row_id: r.reason for r in QUERIES["sheet_round_trip_all"](spark, str(tmp_path)).collect()} == {i: cases[i][3] for i in whole}
    n = spark.read.parquet(f"{sf}/build_ablation_sets.parquet").filter("question is not null and options is not null").count()
    for name, column in (("prompt_round_trip", "same"), ("sheet_round_trip", "reason")):
        some, every = ([(r.row_id, r[column]) for r in QUERIES[x](spark, sf).collect()] for x in (name, f"{name}_all"))
        assert len(every) == n > len(some) and set(some) <= set(every)


def test_explanations_of_every_document(spark, tmp_path):
    import duckdb

    ends = ["\x1c", "\x1d", "\x1e", "\x1f", " \x1f\t", "\x85", "\u2028 ", "\u3000"]
    texts = [None, "", "\x1f", *(f"解{e}\n析{e}中{e}\r\n{e}\r尾{e}" for e in ends), *(f"解{e}\n\n{e}\n析" for e in ends)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.text_hash for r in QUERIES["explanations"](spark, str(tmp_path)).collect()}
    every = SQL["explanations"].replace("FROM documents", f"FROM read_parquet('{path}/*.parquet')")
    assert got == dict(duckdb.sql(every).fetchall()) and len(got) == len(texts)
