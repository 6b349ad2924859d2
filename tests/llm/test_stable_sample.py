import pytest

from examloom.llm.stable_sample import BUCKETS, LIST, extend_list, first_list, stable_sample


def _df(spark, n, parts=3, start=0, batch="cast(id div 1000 as int)"):
    return spark.range(start, start + n).repartition(parts).selectExpr("id as row_id", "if(id % 50 = 0, null, concat('s', id div 2)) as sample_id", "case when id % 7 = 0 then null when id % 11 = 0 then '' else concat('u', id % 100) end as unit", f"{batch} as batch", "1 as place", "2 as since")


def _rows(df):
    return {r.row_id: r.chosen_from for r in df.select("row_id", "chosen_from").collect()}


def _kept(spark, path, buckets):
    buckets.write.mode("overwrite").parquet(path)
    return spark.read.schema(LIST).parquet(path)


def test_keeps_what_it_chose(spark):
    full = _rows(stable_sample(_df(spark, 10000), 0.1))
    assert 850 <= len(full) <= 1150
    for b in (0, 3, 7):
        part = _rows(stable_sample(_df(spark, (b + 1) * 1000, 5), 0.1))
        assert part == {k: v for k, v in full.items() if v <= b}


@pytest.mark.parametrize("batch", ["0", "cast(null as int)", "4", "9"])
@pytest.mark.parametrize("more", [200, 1000, 3000])
def test_nothing_is_lost_whichever_batch_grows(spark, batch, more):
    old = _df(spark, 2000, batch="cast(id div 400 as int)")
    grown = old.union(_df(spark, more, start=50_000, batch=batch))
    before, after = _rows(stable_sample(old, 0.1)), _rows(stable_sample(grown, 0.1))
    assert before and {k: after.get(k, "lost") for k in before} == before


def test_stored_list_is_only_appended_to(spark, tmp_path):
    old = _df(spark, 2000, batch="0")
    first = _kept(spark, f"{tmp_path}/0", extend_list(old, 0.1))
    chosen = _rows(stable_sample(old, 0.1, stored=first))
    assert 200 <= len(chosen) <= 260
    names, stored, rows, seen = {r.bucket: r.since for r in first.collect()}, first, old, chosen
    for step, (n, batch) in enumerate([(700, "0"), (900, "cast(null as int)"), (3000, "1"), (1, "0")], 1):
        rows = rows.union(_df(spark, n, start=100_000 * step, batch=batch))
        stored = _kept(spark, f"{tmp_path}/{step}", extend_list(rows, 0.1, stored))
        now = {r.bucket: r.since for r in stored.collect()}
        assert len(now) == stored.count() and {b: now[b] for b in names} == names
        got = _rows(stable_sample(rows, 0.1, stored=stored))
        assert set(seen) <= set(got) and len(got) >= 0.1 * rows.count()
        names, seen = now, got


def test_a_higher_rate_nests_and_short_lists_are_filled(spark):
    d = _df(spark, 4000)
    low, high = _rows(stable_sample(d, 0.05)), _rows(stable_sample(d, 0.2))
    assert set(low) < set(high)
    short = first_list(spark, 0.01)
    assert set(_rows(stable_sample(d, 0.1))) <= set(_rows(stable_sample(d, 0.1, stored=extend_list(d, 0.1, short))))
    assert first_list(spark, 0.0).count() == 0 and first_list(spark, 1.0).count() == BUCKETS


def test_repeats_nulls_and_empty(spark):
    d = _df(spark, 3000)
    got = stable_sample(d.union(d), 0.2).groupBy("row_id").count()
    assert got.filter("count != 2").count() == 0
    assert stable_sample(d.filter("false"), 0.1).count() == 0
    assert extend_list(d.filter("false"), 0.1).count() == first_list(spark, 0.1).count()
    nulls = spark.createDataFrame([(i, None, None, None) for i in range(500)], "row_id long, sample_id string, unit string, batch int")
    got = _rows(stable_sample(nulls, 0.2))
    assert 60 <= len(got) <= 140 and set(got.values()) == {None}


def test_a_hot_key_does_not_shorten_the_list(spark):
    d = _df(spark, 3000)
    hot = spark.range(1500).selectExpr("id + 900000 as row_id", "'hot' as sample_id", "'hot' as unit", "0 as batch", "1 as place", "2 as since")
    assert set(_rows(stable_sample(d, 0.1))) <= set(_rows(stable_sample(d.union(hot), 0.1)))
