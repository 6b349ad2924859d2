"""Queries over scored answers: normalisers, paired tests, slices, votes, headroom and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.functions import answers, rewards, stats
from examloom.operators import evaluation
from examloom.plans import sqltext as q
from examloom.plans.registry import load, register


@register("answer_normalisers", f"SELECT score_id, {q.strict('answer', "'ABCDE'")} AS strict_answer, {q.scorer('answer')} AS scorer_answer, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(coalesce(answer, '')), '[A-Z]'))), '') AS letter_set FROM score_cmb")
def answer_normalisers(spark, d):
    s, a = load(spark, d, "score_cmb"), F.col("answer")
    return s.select("score_id", answers.strict_answer(a, F.lit("ABCDE")).alias("strict_answer"), answers.scorer_answer(a).alias("scorer_answer"), F.array_join(answers.letter_set(a), "").alias("letter_set"))


_CLEAN = "trim(regexp_replace(replace(coalesce(answer, ''), '\r\n', '\n'), '^[\\p{Z}\\s]+|[\\p{Z}\\s]+$', '', 'g'))"
_LABEL = "'(?im)^[ \\t]*(?:最终答案|答案)[ \\t]*[:：][ \\t]*([A-Za-z](?:[\\p{Z}\\s,，、/]*[A-Za-z])*)[ \\t]*$'"


@register("predicted_answers", f"WITH t AS (SELECT score_id, {_CLEAN} AS t FROM score_cmb), f AS (SELECT *, regexp_extract_all(t, {_LABEL}, 1) AS f FROM t) SELECT score_id, coalesce({q.strict('t', "'ABCDE'")}, CASE WHEN len(f) = 1 THEN {q.strict('f[1]', "'ABCDE'")} END) AS predicted FROM f")
def predicted_answers(spark, d):
    return load(spark, d, "score_cmb").select("score_id", answers.predicted_answer(F.col("answer"), F.lit("ABCDE")).alias("predicted"))


@register("choices")
def choices(spark, d):
    """The evaluator's lenient reading of every answer as single and as multiple choice."""
    s, a, v = load(spark, d, "score_cmb"), F.col("answer"), F.lit("ABCDE")
    return s.select("score_id", answers.extract_choice(a, v, F.lit(False)).alias("single"), answers.extract_choice(a, v, F.lit(True)).alias("multiple"))


def scored(spark, d):
    """The last row of each question and run as normalised letters, runs side by side, joined with gold.

    One aggregation by question: the runs are a handful, so they are columns of a map-side combined group, not joins.
    """
    s = load(spark, d, "score_cmb").withColumn("letters", answers.scorer_answer(F.col("answer")))
    last = lambda run, c: F.max_by(F.when(F.col("run") == run, F.col(c)), F.when(F.col("run") == run, F.struct("scored_at", "score_id")))
    runs = [last(r, "letters").alias(r) for r in ("gold", "base", "sft", "sft_v2")]
    shape = [F.max_by(F.coalesce(c, F.lit("")), F.when(F.col("run") == "gold", F.struct("scored_at", "score_id"))).alias(c) for c in ("exam_type", "question_type")]
    g = s.groupBy("id").agg(*runs, *shape).filter("gold is not null and gold != ''")
    for r in ("base", "sft", "sft_v2"):
        g = g.withColumn(f"{r}_right", (F.coalesce(r, F.lit("")) == F.col("gold")))
    return g


_S = f"""WITH n AS (SELECT *, {q.scorer('answer')} AS letters FROM score_cmb),
l AS (SELECT id, run, arg_max(letters, {{'a': scored_at, 'b': score_id}}) AS letters, arg_max(coalesce(exam_type, ''), {{'a': scored_at, 'b': score_id}}) AS exam_type, arg_max(coalesce(question_type, ''), {{'a': scored_at, 'b': score_id}}) AS question_type FROM n GROUP BY id, run),
s AS (SELECT g.id, g.letters AS gold, g.exam_type, g.question_type, b.letters AS base, a.letters AS sft, v.letters AS sft_v2, coalesce(b.letters, '') = g.letters AS base_right, coalesce(a.letters, '') = g.letters AS sft_right, coalesce(v.letters, '') = g.letters AS sft_v2_right
 FROM l g LEFT JOIN l b ON b.id = g.id AND b.run = 'base' LEFT JOIN l a ON a.id = g.id AND a.run = 'sft' LEFT JOIN l v ON v.id = g.id AND v.run = 'sft_v2' WHERE g.run = 'gold' AND g.letters <> '')"""


@register("scored_questions", f"{_S} SELECT * FROM s")
def scored_questions(spark, d):
    return scored(spark, d)


_CELLS = "count(*) AS n, count(*) FILTER (sft_right AND base_right) AS both_right, count(*) FILTER (sft_right AND NOT base_right) AS only_a, count(*) FILTER (NOT sft_right AND base_right) AS only_b, count(*) FILTER (NOT sft_right AND NOT base_right) AS both_wrong"
_PAIR = f"round((both_right + only_a) / n, 9) AS accuracy_a, round((both_right + only_b) / n, 9) AS accuracy_b, round((only_a - only_b) / n * 100, 9) AS delta, round({q.mcnemar('only_a', 'only_b')}, 9) AS p_exact, CASE WHEN only_a + only_b = 0 THEN 'Infinity'::DOUBLE ELSE round(2.8015852181129672 * sqrt(only_a + only_b) / n * 100, 9) END AS detectable"


def _rounded(df, cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@register("paired_overall", f"{_S}, c AS (SELECT {_CELLS} FROM s) SELECT n, both_right, only_a, only_b, both_wrong, {_PAIR} FROM c")
def paired_overall(spark, d):
    return _rounded(evaluation.paired(scored(spark, d), "sft_right", "base_right"), ["accuracy_a", "accuracy_b", "delta", "p_exact", "detectable"])


@register("paired_by_type", f"{_S}, c AS (SELECT exam_type, {_CELLS} FROM s GROUP BY exam_type) SELECT exam_type, n, both_right, only_a, only_b, both_wrong, {_PAIR} FROM c")
def paired_by_type(spark, d):
    return _rounded(evaluation.paired(scored(spark, d), "sft_right", "base_right", ["exam_type"]), ["accuracy_a", "accuracy_b", "delta", "p_exact", "detectable"])


_W = q.wilson("n_right", "n")


@register("accuracy_slices", f"{_S}, u AS (SELECT 'overall' AS slice, 'all' AS value, sft_right FROM s UNION ALL SELECT 'exam_type', nullif(exam_type, ''), sft_right FROM s UNION ALL SELECT 'question_type', nullif(question_type, ''), sft_right FROM s), g AS (SELECT slice, value, count(*) AS n, count(*) FILTER (sft_right) AS n_right FROM u WHERE value IS NOT NULL GROUP BY ALL) SELECT slice, value, n, n_right, round({_W[0]}, 9) AS accuracy, round({_W[1]}, 9) AS low, round({_W[2]}, 9) AS high FROM g")
def accuracy_slices(spark, d):
    return _rounded(evaluation.accuracy_by_slice(scored(spark, d), "sft_right", ["exam_type", "question_type"]), ["accuracy", "low", "high"])


@register("group_statistics", f"{_S} SELECT coalesce(nullif(exam_type, ''), 'unknown') AS \"group\", count(*) AS total, round(avg(base_right::INT), 9) AS base_accuracy, round(avg(sft_right::INT), 9) AS candidate_accuracy, round((avg(sft_right::INT) - avg(base_right::INT)) * 100, 9) AS gain FROM s GROUP BY 1")
def group_statistics(spark, d):
    g = evaluation.group_statistics(scored(spark, d), F.coalesce(F.nullif("exam_type", F.lit("")), F.lit("unknown")), "base_right", "sft_right")
    return _rounded(g, ["base_accuracy", "candidate_accuracy", "gain"])


@register("paired_grouping_sets", f"{_S} SELECT exam_type, question_type, grouping(exam_type, question_type) AS level, {_CELLS} FROM s GROUP BY GROUPING SETS ((), (exam_type), (question_type))")
def paired_grouping_sets(spark, d):
    scored(spark, d).createOrReplaceTempView("examloom_scored")
    cells = "count(*) AS n, count_if(sft_right AND base_right) AS both_right, count_if(sft_right AND NOT base_right) AS only_a, count_if(NOT sft_right AND base_right) AS only_b, count_if(NOT sft_right AND NOT base_right) AS both_wrong"
    return spark.sql(f"SELECT exam_type, question_type, grouping_id(exam_type, question_type) AS level, {cells} FROM examloom_scored GROUP BY GROUPING SETS ((), (exam_type), (question_type))")


@register("changes", f"{_S} SELECT id, gold, base, sft, CASE WHEN sft_right THEN 'improved' ELSE 'regressed' END AS change FROM s WHERE sft_right <> base_right")
def changes(spark, d):
    s = scored(spark, d).filter("sft_right != base_right")
    return s.select("id", "gold", "base", "sft", F.when(F.col("sft_right"), "improved").otherwise("regressed").alias("change"))


@register("format_and_change_rates", f"{_S} SELECT count(*) AS n, count(*) FILTER (coalesce(sft, '') = '') AS unreadable, count(*) FILTER (sft IS NOT NULL AND base IS NOT NULL) AS compared, count(*) FILTER (sft <> base) AS changed FROM s")
def format_and_change_rates(spark, d):
    return scored(spark, d).agg(F.count("*").alias("n"), F.count_if(F.coalesce("sft", F.lit("")) == "").alias("unreadable"), F.count_if(F.col("sft").isNotNull() & F.col("base").isNotNull()).alias("compared"), F.count_if(F.col("sft") != F.col("base")).alias("changed"))


@register("missing_predictions", "SELECT DISTINCT g.id FROM score_cmb g WHERE g.run = 'gold' AND NOT EXISTS (SELECT 1 FROM score_cmb p WHERE p.id = g.id AND p.run = 'sft')")
def missing_predictions(spark, d):
    s = load(spark, d, "score_cmb")
    return s.filter("run = 'gold'").select("id").distinct().join(s.filter("run = 'sft'").select("id").distinct(), "id", "left_anti")


@register("repeated_predictions", "SELECT id, run, count(*) AS n FROM score_cmb GROUP BY id, run HAVING count(*) > 1")
def repeated_predictions(spark, d):
    return load(spark, d, "score_cmb").groupBy("id", "run").agg(F.count("*").alias("n")).filter("n > 1")


@register("majority_votes", f"WITH n AS (SELECT id, score_id, {q.strict('answer', "'ABCDE'")} AS a FROM score_cmb WHERE run <> 'gold'), v AS (SELECT id, a, count(a) AS n, min(score_id) AS seen FROM n GROUP BY id, a) SELECT id, (arg_min(a, {{'n': -n, 's': seen}}) FILTER (a IS NOT NULL)) AS majority, coalesce(max(n) FILTER (a IS NOT NULL), 0) AS votes, sum(n)::BIGINT AS answered FROM v GROUP BY id")
def majority_votes(spark, d):
    s = load(spark, d, "score_cmb").filter("run != 'gold'").withColumn("a", answers.strict_answer(F.col("answer"), F.lit("ABCDE")))
    return evaluation.majority_vote(s, ["id"], "a", "score_id")


@register("sample_buckets", f"{_S}, b AS (SELECT base_right::INT + sft_right::INT + sft_v2_right::INT AS k, (base IS NOT NULL)::INT + (sft IS NOT NULL)::INT + (sft_v2 IS NOT NULL)::INT AS m FROM s) SELECT CASE WHEN k = m THEN 'easy' WHEN k = 0 THEN 'zero' WHEN k * 2 > m THEN 'medium' ELSE 'hard' END AS bucket, count(*) AS n FROM b WHERE m > 0 GROUP BY 1")
def sample_buckets(spark, d):
    s, total = scored(spark, d), lambda cols: sum((c.cast("int") for c in cols), F.lit(0))
    k, m = total([F.col(f"{r}_right") for r in ("base", "sft", "sft_v2")]), total([F.col(r).isNotNull() for r in ("base", "sft", "sft_v2")])
    return s.select(k.alias("k"), m.alias("m")).filter("m > 0").groupBy(evaluation.bucket(F.col("k"), F.col("m")).alias("bucket")).agg(F.count("*").alias("n"))


@register("headroom", f"""{_S}, h AS (SELECT question_type, sft_right AS greedy, (base_right OR sft_right OR sft_v2_right) AS any_right, (base_right::INT + sft_right::INT + sft_v2_right::INT) / 3 AS mean_right, (base <=> sft AND sft <=> sft_v2) AS same FROM s)
SELECT question_type, count(*) AS questions, round(avg(greedy::INT), 9) AS pass1, round(avg(any_right::INT), 9) AS pass_at_k, round(avg(mean_right), 9) AS sampled_accuracy, round(avg(any_right::INT) - avg(greedy::INT), 9) AS sharpening_headroom, round(avg(same::INT), 9) AS consistency FROM h GROUP BY question_type""".replace("base <=> sft AND sft <=> sft_v2", "base IS NOT DISTINCT FROM sft AND sft IS NOT DISTINCT FROM sft_v2"))
def headroom(spark, d):
    s = scored(spark, d)
    rate = lambda c: F.round(F.avg(c.cast("int")), 9)
    any_ = F.col("base_right") | F.col("sft_right") | F.col("sft_v2_right")
    same = evaluation.consistent(F.col("sft"), F.array("base", "sft_v2"))
    mean = (F.col("base_right").cast("int") + F.col("sft_right").cast("int") + F.col("sft_v2_right").cast("int")) / 3
    g = s.groupBy("question_type").agg(F.count("*").alias("questions"), rate(F.col("sft_right")).alias("pass1"), rate(any_).alias("pass_at_k"), F.round(F.avg(mean), 9).alias("sampled_accuracy"), F.round(F.avg(any_.cast("int")) - F.avg(F.col("sft_right").cast("int")), 9).alias("sharpening_headroom"), rate(same).alias("consistency"))
    return g


@register("detectable_table", "SELECT n, d AS discordance, round(2.8015852181129672 * sqrt(n * d) / n * 100, 9) AS detectable, round(1.959963984540054 * sqrt(0.84 * 0.16 / n) * 100, 9) AS half_width FROM (SELECT unnest([3000, 6657, 11200])::BIGINT AS n), (SELECT unnest([0.02, 0.05, 0.064, 0.1])::DOUBLE AS d)")
def detectable_table(spark, d):
    n = spark.createDataFrame([(3000,), (6657,), (11200,)], "n long").withColumn("discordance", F.explode(F.array(*[F.lit(x) for x in (0.02, 0.05, 0.064, 0.1)])))
    return n.select("n", "discordance", F.round(stats.detectable_effect(F.col("n"), F.col("discordance")), 9).alias("detectable"), F.round(stats.half_width(F.col("n"), F.lit(0.84)), 9).alias("half_width"))


@register("paired_bootstrap")
def paired_bootstrap(spark, d):
    """Intervals of accuracy and difference; only four counts leave the cluster."""
    c = evaluation.paired(scored(spark, d), "sft_right", "base_right").first()
    cells = (c["both_right"], c["only_a"], c["only_b"], c["both_wrong"])
    low, high = stats.bootstrap_accuracy(cells[0] + cells[1], sum(cells))
    delta = stats.bootstrap_delta(cells)
    chi2, p = stats.mcnemar_chi2(cells[1], cells[2])
    return spark.createDataFrame([(low, high, *delta, chi2, p)], "accuracy_low double, accuracy_high double, delta double, delta_low double, delta_high double, chi2 double, p_chi2 double")


_J = "len(list_intersect(string_split(p, ''), string_split(gold, ''))) / len(list_distinct(list_concat(string_split(p, ''), string_split(gold, ''))))"


@register("answer_rewards", f"""{_S}, a AS (SELECT n.score_id, s.gold, {_CLEAN.replace('answer', 'n.answer')} AS t, n.score_id % 120 AS step FROM score_cmb n JOIN s ON s.id = n.id WHERE n.run <> 'gold'),
b AS (SELECT *, {q.strict('t', "'ABCDE'")} AS bare, regexp_extract_all(t, {_LABEL}, 1) AS f FROM a), p AS (SELECT score_id, gold, step, coalesce(bare, CASE WHEN len(f) = 1 THEN {q.strict('f[1]', "'ABCDE'")} END) AS p, coalesce(bare = t, FALSE) AS strict FROM b),
r AS (SELECT score_id, CASE WHEN p = gold THEN 1.0 ELSE 0.0 END::DOUBLE AS answer, strict::INT::DOUBLE AS format, CASE WHEN length(gold) >= 2 AND p <> gold THEN {_J} * greatest(0.0, 1 - step / 100) ELSE 0.0 END::DOUBLE AS partial FROM p)
SELECT score_id, answer, format, round(partial, 9) AS partial, round(0.95 * answer + 0.05 * format + 0.475 * partial, 9) AS total FROM r""")
def answer_rewards(spark, d):
    """Rewards of every answer in direct mode, the row number standing for the training step."""
    gold = scored(spark, d).select("id", "gold")
    s = load(spark, d, "score_cmb").filter("run != 'gold'").join(gold, "id")
    parsed = answers.parse_completion(F.col("answer"), "direct", F.lit("ABCDE"))
    r = s.select("score_id", rewards.rewards(parsed, F.col("gold"), F.pmod("score_id", F.lit(120)), F.lit(None).cast("int"), rewards.RewardSettings()).alias("r"))
    return r.select("score_id", "r.answer", "r.format", F.round("r.partial", 9).alias("partial"), F.round("r.total", 9).alias("total"))
