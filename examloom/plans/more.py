"""Queries for the smaller operators: split rules, exports, formats read back, masks, padding, metrics and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.functions import answers, prompts, rewards, text
from examloom.functions.text import stable_fraction
from examloom.operators import credit, dedup, harness, training
from examloom.operators.records import parse_sheet_row
from examloom.plans import sqltext as q
from examloom.plans.mcq import _UNIT, with_unit
from examloom.plans.registry import load, register
from examloom.session import scratch_dir
from examloom.sources import files, sinks


@register("split_priority", f"WITH k AS (SELECT row_id, split, {q.question_key('question')} AS k FROM build_cmb_train_sft) SELECT row_id, split FROM k WHERE k <> '' AND (split = 'test' OR (split = 'val' AND k NOT IN (SELECT k FROM k WHERE split = 'test')) OR (split = 'train' AND k NOT IN (SELECT k FROM k WHERE split IN ('test', 'val'))))")
def split_priority(spark, d):
    """A question belongs to test before val before train; later splits lose the rows that earlier ones have."""
    c = load(spark, d, "build_cmb_train_sft").select("row_id", "split", text.question_key(F.col("question")).alias("k")).filter("k != ''")
    part = lambda *s: c.filter(F.col("split").isin(*s))
    return part("test").union(dedup.without(part("val"), part("test"), "k").select(*c.columns)).union(dedup.without(part("train"), part("test", "val"), "k").select(*c.columns)).select("row_id", "split")


@register("split_overlap_stats", f"WITH k AS (SELECT row_id, split, {q.stem('question')} AS k FROM build_cmb_train_sft), t AS (SELECT DISTINCT k FROM k WHERE split = 'train' AND k <> '') SELECT split, count(*) AS n_rows, count(*) FILTER (t.k IS NOT NULL) AS removed, count(DISTINCT t.k) AS matched_keys FROM k LEFT JOIN t USING (k) WHERE split <> 'train' GROUP BY split")
def split_overlap_stats(spark, d):
    c = load(spark, d, "build_cmb_train_sft").select("row_id", "split", text.stem_key(F.col("question")).alias("k"))
    t = c.filter("split = 'train' and k != ''").select("k").distinct().withColumn("hit", F.col("k"))
    return c.filter("split != 'train'").join(t, "k", "left").groupBy("split").agg(F.count("*").alias("n_rows"), F.count("hit").alias("removed"), F.count_distinct("hit").alias("matched_keys"))


@register("evaluation_export", f"WITH a AS (SELECT *, {_UNIT} AS u FROM build_ablation_sets WHERE question IS NOT NULL AND options IS NOT NULL), m AS (SELECT u, arg_min({{'e': coalesce(exam_type, ''), 't': coalesce(question_type, '')}}, row_id) AS m FROM a WHERE source = 'cmb_train' GROUP BY u) SELECT a.row_id, CASE WHEN m IS NULL THEN '医学' ELSE m.e END AS exam_type, CASE WHEN m IS NULL THEN CASE WHEN length(gold) > 1 THEN '多项选择题' ELSE '单项选择题' END ELSE m.t END AS question_type, trim(gold) AS answer FROM a LEFT JOIN m USING (u) WHERE source <> 'cmb_train'")
def evaluation_export(spark, d):
    a = with_unit(load(spark, d, "build_ablation_sets").filter("question is not null and options is not null"))
    meta = a.filter("source = 'cmb_train'").withColumn("exam_class", F.lit("")).withColumn("exam_subject", F.lit(""))
    out = sinks.evaluation_export(a.filter("source != 'cmb_train'").withColumn("sample_id", F.col("row_id")), meta)
    return out.select(F.col("id").alias("row_id"), "exam_type", "question_type", "answer")


@register("pool_exclusion", "SELECT DISTINCT sample_id FROM build_ablation_sets WHERE source = 'cmb_train' AND sample_id IS NOT NULL AND length(question) <= 450 AND sample_id NOT IN (SELECT sample_id FROM build_ablation_sets WHERE sample_id IS NOT NULL AND source <> 'cmb_train')")
def pool_exclusion(spark, d):
    a = load(spark, d, "build_ablation_sets").filter("sample_id is not null")
    return dedup.without(a.filter("source = 'cmb_train' and length(question) <= 450"), a.filter("source != 'cmb_train'"), "sample_id").select("sample_id").distinct()


def _gold(spark, d):
    a = load(spark, d, "build_ablation_sets").filter("question is not null and options is not null")
    return a.withColumn("answer", answers.strict_answer(F.col("gold"), F.array_join(F.transform("options", lambda o: o["letter"]), ""))).filter("answer is not null")


_GOLD = f"SELECT *, {q.strict('gold', "array_to_string(list_transform(options, lambda o: o.letter), '')")} AS answer FROM build_ablation_sets WHERE question IS NOT NULL AND options IS NOT NULL"
_USER = "'题目：\n' || question || '\n\n选项：\n' || array_to_string(list_transform(options, lambda o: o.letter || '. ' || coalesce(o.text, '')), '\n')"


@register("jsonl_round_trip", f"WITH g AS ({_GOLD}) SELECT sha256({_USER} || '\n\n{prompts.SUFFIX['direct']}') AS sample_id, answer, count(*) AS n FROM g WHERE answer IS NOT NULL GROUP BY ALL")
def jsonl_round_trip(spark, d):
    """Training rows written as JSON lines, read again and parsed: ids and answers are those of the source."""
    m = prompts.training_messages(F.col("question"), F.col("options"), F.col("answer"))
    path = f"{scratch_dir(spark)}/jsonl"
    sinks.write_messages(_gold(spark, d).select(m.alias("messages")), path, overwrite=True)
    r = files.read_conversations(spark, path).filter("reason is null")
    target = answers.reference_target(F.element_at("messages", -1)["content"], F.lit("ABCDEFGH"))
    return r.select(text.sample_id(F.col("messages")).alias("sample_id"), target["answer"].alias("answer")).groupBy("sample_id", "answer").agg(F.count("*").alias("n"))


@register("sheet_round_trip", f"WITH g AS (SELECT row_id, {q.display('question')} AS question, list_transform(options, lambda o: {q.display('o.text')}) AS t, array_to_string(list_transform(options, lambda o: o.letter), '') AS ls, upper(regexp_replace(coalesce(gold, ''), '{q.SPACE}', '', 'g')) AS g FROM build_ablation_sets WHERE question IS NOT NULL AND options IS NOT NULL AND NOT regexp_matches(array_to_string(list_transform(options, lambda o: o.text), ''), '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85]')) SELECT row_id, CASE WHEN question = '' THEN 'empty_question' WHEN ls NOT IN ('ABC', 'ABCD', 'ABCDE') THEN 'invalid_option_sequence' WHEN len(list_distinct(t)) <> len(t) THEN 'duplicate_option_content' WHEN NOT regexp_full_match(g, '[A-Z]+') THEN 'invalid_answer_format' WHEN len(list_filter({q.letters('g')}, lambda c: NOT contains(ls, c))) > 0 THEN 'answer_not_in_options' END AS reason FROM g WHERE len(list_filter(t, lambda x: x = '')) = 0 AND regexp_full_match(ls, '[A-Z]*') AND length(ls) = len(t)")
def sheet_round_trip(spark, d):
    """Questions written as a sheet with options as lines, read again and checked."""
    a = load(spark, d, "build_ablation_sets").filter("question is not null and options is not null")
    texts = prompts.option_texts(F.col("options"))
    a = a.filter(~F.array_join(texts, "").rlike(r"[\n\r\x0b\x0c\x1c-\x1e\x85]") & ~F.exists(texts, lambda t: text.display_text(t) == "") & ~F.exists("options", lambda o: ~o["letter"].rlike("^[A-Z]$")))
    return _checked_sheet(spark, a, "sheet")


def _checked_sheet(spark, a, name):
    path = f"{scratch_dir(spark)}/{name}"
    sheet = a.select("row_id", F.col("question").alias("Question"), prompts.render_options(F.col("options")).alias("Options"), F.col("gold").alias("Answer"))
    sheet.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    r = files.read_sheet(spark, path)
    return r.select(F.col("row_id").cast("long").alias("row_id"), parse_sheet_row(F.col("Question"), F.col("Options"), F.col("Answer"))["reason"].alias("reason"))


@register("sheet_round_trip_all")
def sheet_round_trip_all(spark, d):
    """Every row with question and options; line ends in texts, empty options and odd letters are reasons too."""
    return _checked_sheet(spark, load(spark, d, "build_ablation_sets").filter("question is not null and options is not null"), "sheet_all")


@register("token_advantages", "WITH m AS (SELECT event_type, avg(value) AS a FROM events GROUP BY 1), p AS (SELECT event_id, event_type, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events) SELECT event_id, round(CASE WHEN event_id % 4 > 0 THEN a + 0.5 * coalesce(c, 0) ELSE 0 END, 6) AS advantage FROM p JOIN m USING (event_type)")
def token_advantages(spark, d):
    from pyspark.sql import Window

    e = load(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("c", F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)))
    e = e.join(e.groupBy("event_type").agg(F.avg("value").alias("a")), "event_type")
    t = training.token_advantage(e, F.col("a"), F.col("c"), 0.5, F.pmod("event_id", F.lit(4)) > 0)
    return t.select("event_id", F.round("advantage", 6).alias("advantage"))


@register("masked_error", "SELECT event_type, round(sum(CASE WHEN event_id % 3 > 0 THEN (value * 0.9 - value) * (value * 0.9 - value) ELSE 0 END) / greatest(count(*) FILTER (event_id % 3 > 0), 1), 6) AS mse FROM events GROUP BY 1")
def masked_error(spark, d):
    e = load(spark, d, "events").withColumn("guess", F.col("value") * 0.9)
    return e.groupBy("event_type").agg(F.round(training.masked_squared_error(F.col("guess"), F.col("value"), F.pmod("event_id", F.lit(3)) > 0), 6).alias("mse"))


@register("answer_masks", "WITH d AS (SELECT l_orderkey AS id, l_linenumber AS p, l_returnflag = 'R' AS marker, l_linestatus = 'O' AS sup, l_quantity > 40 AS special FROM lineitem), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY marker, sup, special) = 1), s AS (SELECT *, max(p) FILTER (marker AND sup) OVER (PARTITION BY id) AS a FROM t), e AS (SELECT *, min(p) FILTER (special AND p > a) OVER (PARTITION BY id) AS b FROM s) SELECT id, p, coalesce(p >= a AND p < coalesce(b, 1000000), FALSE) AS in_answer FROM e")
def answer_masks(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("p"), (F.col("l_returnflag") == "R").alias("marker"), (F.col("l_linestatus") == "O").alias("sup"), (F.col("l_quantity") > 40).alias("special"))
    one = li.groupBy("id", "p").agg(F.min(F.struct("marker", "sup", "special")).alias("x")).select("id", "p", "x.*")
    return training.answer_mask(one, "id", "p", "marker", "sup", "special").select("id", "p", "in_answer")


@register("padded_batches", "WITH t AS (SELECT o_orderkey AS id, o_orderkey % 50 AS batch, 1 + o_orderkey % 7 AS n FROM orders), m AS (SELECT batch, max(n) AS m FROM t GROUP BY 1) SELECT id, list_concat(list_transform(range(0, n), lambda i: 7), list_transform(range(0, m - n), lambda i: 0))::INTEGER[] AS ids FROM t JOIN m USING (batch)")
def padded_batches(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_orderkey", F.lit(50)).alias("batch"), F.array_repeat(F.lit(7), (1 + F.pmod("o_orderkey", F.lit(7))).cast("int")).alias("ids"))
    return training.padded(o, "batch", "ids", 0).select("id", "ids")


@register("reward_means", f"WITH s AS (SELECT score_id, {q.strict('answer', "'ABCDE'")} AS p, starts_with(coalesce(answer, ''), '答案') AS cot FROM score_cmb), r AS (SELECT *, p IS NOT DISTINCT FROM 'B' AS ok FROM s) SELECT round(avg(ok::INT), 9) AS reward_mean, round(avg((p IS NOT NULL)::INT), 9) AS parse_rate, round(avg(cot::INT), 9) AS cot_rate, round(avg(cot::INT) FILTER (ok), 9) AS cot_when_right, round(avg(cot::INT) FILTER (NOT ok), 9) AS cot_when_wrong FROM r")
def reward_means(spark, d):
    p = answers.strict_answer(F.col("answer"), F.lit("ABCDE"))
    s = load(spark, d, "score_cmb").select(p.alias("p"), F.coalesce("answer", F.lit("")).startswith("答案").alias("cot")).withColumn("reward", rewards.answer_reward(F.col("p"), F.lit("B"))).withColumn("ok", F.col("reward") > 0)
    m = training.reward_metrics(s, "reward", "p", "cot", "ok")
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@register("credit_means", "WITH e AS (SELECT user_id, value, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events), g AS (SELECT user_id, arg_min(value, event_id) AS a, arg_max(value, event_id) AS b, count(*) AS n FROM e GROUP BY 1) SELECT round(avg(a), 6) AS phi_first, round(avg(b), 6) AS phi_last, round(avg((n < 2)::INT), 6) AS without_segments, count(*) AS completions, (SELECT round(avg(abs(c)), 6) FROM e) AS mean_credit FROM g")
def credit_means(spark, d):
    m = training.credit_metrics(load(spark, d, "events"), "user_id", "event_id", "value")
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@register("anneal_schedule", "SELECT event_id, greatest(0.0, 1 - (event_id % 150) / 100)::DOUBLE AS factor, event_id % 150 < 20 AS lenient FROM events")
def anneal_schedule(spark, d):
    step = F.pmod("event_id", F.lit(150))
    return load(spark, d, "events").select("event_id", rewards.anneal(step, 100).alias("factor"), (step < 20).alias("lenient"))


@register("budget_cut", f"WITH f AS (SELECT doc_id, {q.fraction("'42'", "'harness'", 'doc_id', sep='|')} AS f, coalesce(n_chars, 0)::DOUBLE AS c FROM documents), s AS (SELECT *, coalesce(sum(c) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f) SELECT doc_id FROM s WHERE b < 20000")
def budget_cut(spark, d):
    t = load(spark, d, "documents").select("doc_id", stable_fraction("|", F.lit("42"), F.lit("harness"), F.col("doc_id")).alias("f"), F.coalesce("n_chars", F.lit(0)).cast("double").alias("c"))
    return harness.within_budget(t, "f", "c", 20000.0).select("doc_id")


@register("score_targets", "SELECT event_id, CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN (event_id % 7 - 1) / 4 END::DOUBLE AS target FROM events")
def score_targets(spark, d):
    return load(spark, d, "events").select("event_id", training.normalized_score(F.pmod("event_id", F.lit(7))).alias("target"))


@register("numbered_segments")
def numbered_segments(spark, d):
    """The scoring prompt's numbered list for every text, as a hash with the number of segments."""
    from examloom.functions.segments import segment_spans

    t = load(spark, d, "documents").filter("text != ''").select("doc_id", "text", segment_spans(F.col("text")).alias("s"))
    return t.select("doc_id", F.md5(harness.numbered_segments(F.col("text"), F.col("s"))).alias("prompt_hash"), F.size("s").alias("n"))


@register("unanimous_groups", "SELECT user_id, event_type, count(*) AS n, min(round(value)) = max(round(value)) AS unanimous FROM events GROUP BY ALL")
def unanimous_groups(spark, d):
    e = load(spark, d, "events").withColumn("r", F.round("value")).withColumn("g", F.struct("user_id", "event_type"))
    a = credit.group_advantage(e, "g", "r")
    return a.groupBy("g.user_id", "g.event_type").agg(F.count("*").alias("n"), F.bool_and("unanimous").alias("unanimous"))
