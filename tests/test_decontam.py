"""Near-duplicate stems: every pair is found, and shuffle files stay within the budget of disk."""

import random

import pytest

from examloom.functions.text import ngrams
from examloom.operators import decontam
from examloom.plans import mcq


def _best(left, right, n, threshold):
    sets = {t: ngrams(t, n) for t in {*left, *right} if t}
    out = {}
    for a in set(left) - {""}:
        score, b = max((len(sets[a] & sets[b]) / len(sets[a] | sets[b]), b) for b in set(right) - {""})
        if score >= threshold:
            out[a] = (score, b)
    return out


def _scores(spark, left, right, **how):
    d = decontam.near_scores(spark.createDataFrame([(x,) for x in left], "k string"), spark.createDataFrame([(x,) for x in right], "r string"), "k", "r", **how)
    rows = d.collect()
    assert len({x.k for x in rows}) == len(rows)
    return {x.k: (x.jaccard, x.r) for x in rows}


def _shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.9])
def test_no_pair_is_lost(spark, threshold):
    rng = random.Random(5)
    clauses = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(rng.randrange(3, 14))) for _ in range(40)]
    text = lambda most: "".join(rng.choice(clauses) for _ in range(rng.randrange(1, most)))
    # few clauses for many texts; texts with more grams than there are bits; parts of others; astral and zero characters; short ones
    left, right = [text(7) for _ in range(120)] + [text(90) for _ in range(6)], [text(7) for _ in range(80)] + [text(90) for _ in range(6)]
    right += [t[: max(1, int(len(t) * threshold) + k)] for k in (0, 1, 2) for t in left[::7]] + ["𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇𠀈", "a\0bcdefgh", "甲乙", "aaaaaaaaaaaa", ""]
    left += ["𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇", "a\0bcdefg", "甲乙", "甲", "aaaaaaaaa", ""]
    want = _best(left, right, 5, threshold)
    assert _scores(spark, left, right, threshold=threshold, min_chars=1) == want and len(want) > 20


def test_shuffle_files_within_four_times_the_texts(spark):
    rng = random.Random(6)
    clauses = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20)) for _ in range(300)]
    texts = ["".join(rng.sample(clauses, 2)) + "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20)) for _ in range(5000)]
    left, right = texts[:3500], texts[3500:] + [t[:-9] + "末" * 9 for t in texts[:50]]
    before = _shuffle_bytes(spark)
    d = decontam.near_scores(spark.createDataFrame([(x,) for x in left], "k string"), spark.createDataFrame([(x,) for x in right], "r string"), "k", "r")
    left_over = _shuffle_bytes(spark) - before
    assert {x.k for x in d.collect()} >= set(left[:50])
    assert left_over < 4 * sum(len(t.encode()) for t in left + right)


def test_gates_of_the_funnel_leave_no_shuffle_files(spark, sf):
    before = _shuffle_bytes(spark)
    outcomes = mcq.build_outcomes(spark, sf)
    left_over = _shuffle_bytes(spark) - before
    assert outcomes.count() == spark.read.parquet(f"{sf}/build_cmb_train_sft.parquet").filter("split = 'train'").count()
    assert left_over < 5000
