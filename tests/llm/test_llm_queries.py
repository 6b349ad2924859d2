"""The registered queries of the training-data problems over the smallest tables."""

import math
import os

import pytest

from examloom.llm import queries as registry
from examloom.llm.bpe import default_vocabulary

QUERIES, SQL = registry.queries(), registry.oracle_sql()
COLUMNS = {
    "p1_found": ["plan_name", "exam_type", "question_type"], "p2_found": ["first_row_id", "row_id"], "p3_found": ["field", "key_a", "key_b"], "p4_found": ["unit_a", "unit_b"],
    "p6_found": ["row_id_a", "row_id_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["source"], "p9_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return c


def _plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, duck, name):
    if name[:2] in ("p7", "p8") and not os.path.exists(default_vocabulary()):
        pytest.skip("no vocabulary files here")
    df = QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    cols = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    if name.endswith("_found"):
        assert len(set(got)) == len(got)
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted(repr([_plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def test_sample_matches_its_report(spark, sf):
    sample = {(r.plan_name, r.exam_type, r.question_type): r["count"] for r in QUERIES["p1_sample"](spark, sf).groupBy("plan_name", "exam_type", "question_type").count().collect()}
    for r in QUERIES["p1_report"](spark, sf).collect():
        assert sample.get((r.plan_name, r.exam_type, r.question_type), 0) == r.selected == min(r.quota, r.available)
