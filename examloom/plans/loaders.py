"""Queries that write files in the layouts that exam data come in, read them back and compare with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.functions import answers, prompts
from examloom.functions.text import stable_fraction
from examloom.operators import alignment, audit, harness, variants
from examloom.plans import sqltext as q
from examloom.plans.mcq import _UNIT, _labelled
from examloom.plans.registry import load, register
from examloom.session import scratch_dir
from examloom.sources import files

#: Records of one JSON document, so that a document fits in a task whatever the size of the table.
IN_A_FILE = 500


def _documents(spark, rows, key, value, layouts, name):
    """Write rows as JSON documents of at most IN_A_FILE consecutive keys, in turn in each of the layouts; the folder's path.

    layouts: functions of an array of struct(id, v) in order of id, which give the text of a document.
    """
    at = F.floor(F.col(key) / IN_A_FILE)
    docs = rows.groupBy(at.alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("id"), value.alias("v")))).alias("all"))
    body = F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        body = F.when(F.pmod("at", F.lit(len(layouts))) == i, layout(F.col("all"))).otherwise(body)
    path = f"{scratch_dir(spark)}/{name}"
    # a document is one line of its own file
    docs.select(F.col("at"), body.alias("value")).repartition("at").write.partitionBy("at").mode("overwrite").option("compression", "none").text(path)
    return f"{path}/*/*.txt"


def _records(field):
    return lambda a: F.to_json(F.transform(a, lambda x: F.struct(x["id"].alias("id"), x["v"].alias(field))), {"ignoreNullFields": "false"})


def _wrapped(wrapper, field):
    return lambda a: F.concat(F.lit(f'{{"{wrapper}": '), _records(field)(a), F.lit("}"))


def _by_id(inner):
    return lambda a: F.to_json(F.map_from_entries(F.transform(a, lambda x: F.struct(x["id"], inner(x["v"])))), {"ignoreNullFields": "false"})


@register("truth_files", f"SELECT row_id::VARCHAR AS id, {q.scorer('answer')} AS answer FROM build_cmb_train_sft WHERE {q.scorer('answer')} <> ''")
def truth_files(spark, d):
    """Answers in four layouts of answer files: a list, a wrapped list, answers by id, records by id."""
    c = load(spark, d, "build_cmb_train_sft").select("row_id", "answer")
    layouts = [_records("standard_answer"), _wrapped("answers", "gold_answer"), _by_id(lambda v: v), _by_id(lambda v: F.struct(v.alias("answer")))]
    return files.read_ground_truth(spark, _documents(spark, c, "row_id", F.col("answer"), layouts, "truth_files"))


@register("prediction_files", f"SELECT score_id::VARCHAR AS id, {q.scorer('answer')} AS answer FROM score_cmb")
def prediction_files(spark, d):
    """Predictions in three layouts of record files, each file read by its own."""
    c = load(spark, d, "score_cmb").select("score_id", "answer")
    layouts = [_records("model_answer"), _wrapped("items", "answer"), _by_id(lambda v: F.struct(v.alias("model_answer")))]
    return files.predictions(files.read_records(spark, _documents(spark, c, "score_id", F.col("answer"), layouts, "prediction_files")))


@register("prediction_lines", "SELECT score_id::VARCHAR AS id, run, list_sort(list_distinct(regexp_extract_all(upper(coalesce(answer, '')), '[A-Z]'))) = ['B'] AS \"right\" FROM score_cmb")
def prediction_lines(spark, d):
    """Lines whose field names are found out from the first of them."""
    s = load(spark, d, "score_cmb").select(F.col("score_id").alias("question_id"), F.lit(" b").alias("gold"), F.col("answer").alias("pred"), "run")
    path = f"{scratch_dir(spark)}/prediction_lines"
    s.select(F.to_json(F.struct(*s.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    return files.read_predictions(spark, path, columns=("run",))


@register("exam_files", "SELECT id, question, answer, question_type, cardinality(options) AS n_options FROM build_cmb_train_sft")
def exam_files(spark, d):
    """Records of exam files, options as an object."""
    c = load(spark, d, "build_cmb_train_sft")
    record = F.struct("id", "question", "answer", "question_type", F.col("options").alias("option"))
    docs = c.groupBy(F.floor(F.col("row_id") / IN_A_FILE).alias("at")).agg(F.to_json(F.collect_list(record), {"ignoreNullFields": "false"}).alias("value"))
    path = f"{scratch_dir(spark)}/exam_files"
    docs.repartition("at").write.partitionBy("at").mode("overwrite").text(path)
    e = files.read_exam_json(spark, f"{path}/*/*.txt")
    return e.select("id", "question", "answer", "question_type", F.when(F.col("option").isNotNull(), F.size("option")).cast("long").alias("n_options"))


@register("reference_files", f"WITH a AS (SELECT 'cmb.json' AS source, question FROM build_cmb_train_sft UNION ALL SELECT 'sets.csv', question FROM build_ablation_sets UNION ALL SELECT 'sets.jsonl', question FROM build_ablation_sets WHERE question IS NOT NULL) SELECT source, {q.stem('question')} AS stem, count(*) AS n FROM a WHERE {q.stem('question')} <> '' GROUP BY ALL")
def reference_files(spark, d):
    """Stems of reference sets kept as records, as a sheet and as lines."""
    c, a = load(spark, d, "build_cmb_train_sft"), load(spark, d, "build_ablation_sets").select("question")
    base = f"{scratch_dir(spark)}/references"
    docs = c.groupBy(F.floor(F.col("row_id") / IN_A_FILE).alias("at")).agg(F.to_json(F.collect_list(F.struct("question")), {"ignoreNullFields": "false"}).alias("value"))
    docs.select("value").repartition(8).write.mode("overwrite").text(f"{base}/cmb.json")
    a.select(F.col("question").alias("Question")).write.mode("overwrite").csv(f"{base}/sets.csv", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    a.filter("question is not null").select(F.to_json(F.struct("question")).alias("value")).write.mode("overwrite").text(f"{base}/sets.jsonl")
    r = files.read_reference_stems(spark, [f"{base}/{n}" for n in ("cmb.json", "sets.csv", "sets.jsonl")])
    return r.groupBy(F.regexp_extract("source", "[^/]+$", 0).alias("source"), "stem").agg(F.count("*").alias("n"))


_PIECES = "SELECT doc_id, text, length(text) AS n, list_transform(range(0, (length(text) + 6) // 7), lambda k: {'a': k * 7, 'b': least(k * 7 + 5, length(text))}) AS spans FROM documents WHERE text <> ''"


def _tokens(n):
    """(starts, ends) of tokens of three characters that cover n characters."""
    starts = F.sequence(F.lit(0), n - 1, F.lit(3))
    return starts, F.transform(starts, lambda s: F.least(s + 3, n))


@register("token_ranges", f"WITH p AS ({_PIECES}) SELECT doc_id, list_transform(spans, lambda s: s.a // 3) AS firsts, list_transform(spans, lambda s: (s.b - 1) // 3) AS lasts FROM p")
def token_ranges(spark, d):
    """Spans of five characters, every seven, as ranges of tokens of three characters; every text whole."""
    t = load(spark, d, "documents").filter("text != ''").withColumn("n", F.length("text"))
    spans = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(7)), lambda k: F.struct(k.alias("start"), F.least(k + 5, F.col("n")).alias("end")))
    r = t.select("doc_id", alignment.token_ranges(_tokens(F.col("n"))[1], spans).alias("r"))
    return r.select("doc_id", F.transform("r", lambda x: x["first"].cast("long")).alias("firsts"), F.transform("r", lambda x: x["last"].cast("long")).alias("lasts"))


_ENCODED = f"""WITH r AS (SELECT row_id, question, trim(gold) AS g FROM build_ablation_sets WHERE length(question) > 0),
p AS (SELECT row_id, length(question) AS n, '解析：' || question || '\n答案：A' AS c, list_transform(range(0, (length(question) + 9) // 10), lambda k: {{'a': k * 10, 'b': k * 10 + length(regexp_replace(question[k * 10 + 1:k * 10 + 10], '{q.SPACE}+$', '')), 's': 1 + k % 5}}) AS ss FROM r),
e AS (SELECT *, 4 + length(c) AS total, list_transform(ss, lambda s: (4 + 3 + s.b - 1) // 3) AS stops FROM p)
SELECT row_id, CASE WHEN (total + 2) // 3 > 100 THEN 'too_long' WHEN len(list_filter(ss, lambda s: s.b <= s.a)) > 0 THEN 'empty_segment' WHEN list_distinct(stops).list_sort() <> stops THEN 'too_fine' END AS reason,
CASE WHEN (total + 2) // 3 <= 100 AND len(list_filter(ss, lambda s: s.b <= s.a)) = 0 AND list_distinct(stops).list_sort() = stops THEN array_to_string(stops, ',') END AS positions,
CASE WHEN (total + 2) // 3 <= 100 AND len(list_filter(ss, lambda s: s.b <= s.a)) = 0 AND list_distinct(stops).list_sort() = stops THEN (total + 2) // 3 - 2 END AS supervised FROM e"""


@register("encoded_examples", _ENCODED)
def encoded_examples(spark, d):
    """Questions as rationales of sentences of ten characters, after a prompt of four, in tokens of three; too long beyond 100."""
    a = load(spark, d, "build_ablation_sets").filter(F.length("question") > 0)
    content = F.concat(F.lit("解析："), F.col("question"), F.lit("\n答案：A"))
    sentences = F.transform(F.sequence(F.lit(0), F.length("question") - 1, F.lit(10)), lambda k: F.struct(k.alias("start"), F.least(k + 10, F.length("question")).alias("end"), (1 + F.pmod((k / 10).cast("int"), F.lit(5))).alias("score")))
    starts, ends = _tokens(F.length(content) + 4)
    e = a.select("row_id", alignment.encoded_example(F.transform(starts, lambda s: s + 1000), starts, ends, F.lit(4), content, F.col("question"), sentences, 100).alias("e"))
    labels = F.size(F.filter("e.labels", lambda x: x != -100)).cast("long")
    return e.select("row_id", F.col("e.reason").alias("reason"), F.array_join(F.col("e.positions").cast("array<string>"), ",").alias("positions"), F.when(F.col("e.reason").isNull(), labels).alias("supervised"))


@register("prompt_completions", "SELECT row_id, 2 AS n_prompt, 'user' AS last_prompt_role, 'assistant' AS role, gold AS completion FROM build_ablation_sets WHERE question IS NOT NULL AND options IS NOT NULL")
def prompt_completions(spark, d):
    a = load(spark, d, "build_ablation_sets").filter("question is not null and options is not null")
    p = alignment.prompt_and_completion(prompts.training_messages(F.col("question"), F.col("options"), F.col("gold")))
    return a.select("row_id", p.alias("p")).select("row_id", F.size("p.prompt").alias("n_prompt"), F.element_at("p.prompt", -1)["role"].alias("last_prompt_role"), F.col("p.completion")[0]["role"].alias("role"), F.col("p.completion")[0]["content"].alias("completion"))


_USER = "'题目：\n' || question || '\n\n选项：\n' || array_to_string(list_transform(options, lambda o: o.letter || '. ' || coalesce(o.text, '')), '\n')"
_HINT = "CASE WHEN coalesce(question_type, '') <> '' THEN CASE WHEN contains(question_type, '多项') THEN '本题是多项选择题' ELSE '本题是单项选择题' END WHEN gold IS NOT NULL THEN CASE WHEN length(trim(gold)) > 1 THEN '本题是多项选择题' ELSE '本题是单项选择题' END END"
_CONTENT = f"array_to_string(list_sort(list_transform(list_filter(options, lambda o: contains(gold, o.letter)), lambda o: {q.stem('o.text')})), '|')"


def _variant_sql(scale: float, clean: bool, hint: bool) -> str:
    """Built set by source and variant: chosen units, no shuffled rows, cleaned, one row a prompt."""
    shown = f"coalesce('\n\n提示：' || {_HINT}, '') || " if hint else ""
    dropped = """bad AS (SELECT row_id FROM lab LEFT JOIN cf USING (unit_hash) WHERE source = 'cmb_train' AND k > 1 AND (tops > 1 OR content <> keep)),""" if clean else "bad AS (SELECT row_id FROM lab WHERE FALSE),"
    return f"""WITH u AS (SELECT unit, arg_min({{'e': coalesce(exam_type, ''), 't': coalesce(question_type, '')}}, row_id) AS s FROM build_ablation_sets WHERE source = 'cmb_train' AND unit <> '' GROUP BY unit),
o AS (SELECT unit, row_number() OVER (PARTITION BY s.e, s.t ORDER BY {q.fraction("'42'", "'ablation_scale'", 'unit')}, unit) AS r, count(*) OVER (PARTITION BY s.e, s.t) AS n FROM u),
lab AS (SELECT row_id, source, {_UNIT} AS unit_hash, {_CONTENT} AS content FROM build_ablation_sets WHERE options IS NOT NULL AND question IS NOT NULL AND gold IS NOT NULL),
c AS (SELECT unit_hash, content, count(*) AS n FROM lab GROUP BY ALL), cf AS (SELECT unit_hash, count(*) AS k, count(*) FILTER (n = mx) AS tops, min(content) FILTER (n = mx) AS keep FROM (SELECT *, max(n) OVER (PARTITION BY unit_hash) AS mx FROM c) GROUP BY unit_hash),
{dropped}
w AS (SELECT a.* FROM build_ablation_sets a LEFT JOIN o USING (unit) WHERE CASE WHEN a.source = 'cmb_train' THEN o.r <= ceil(o.n * {scale}) AND a.variant <> 'shuffled' ELSE TRUE END AND question IS NOT NULL AND options IS NOT NULL AND row_id NOT IN (SELECT row_id FROM bad)),
i AS (SELECT *, sha256({_USER} || {shown} '\n\n{prompts.SUFFIX['direct']}') AS sid FROM w),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY sid ORDER BY row_id) = 1)
SELECT what, value, count(*) AS n FROM (SELECT unnest([{{'what': 'rows', 'value': 'all'}}, {{'what': 'source', 'value': source}}, {{'what': 'variant', 'value': variant}}, {{'what': 'multiple', 'value': CASE WHEN length(gold) > 1 THEN 'yes' ELSE 'no' END}}], recursive := true) FROM f) GROUP BY ALL"""


def _variant(spec: str):
    def run(spark, d):
        rows = load(spark, d, "build_ablation_sets").select("row_id", "source", "variant", "unit", "exam_type", "question_type", "question", "options", "gold")
        v = variants.parse_variant(spec)
        labelled = _labelled(spark, d).select("row_id", "source", "unit_hash", "content") if v.clean else None
        outcomes = audit.apply_audit(labelled, audit.label_conflicts(labelled)).select("row_id", "outcome") if v.clean else None
        return variants.variant_report(variants.build_variant(rows, v, outcomes))

    return run


register("variant_half", _variant_sql(0.5, False, False))(_variant("half:0.5:0:0:0"))
register("variant_tagged", _variant_sql(1.0, True, True))(_variant("tagged:1.0:0:1:1"))
register("variant_dose")(_variant("dose:0.5:3:0:0"))


@register("segment_count_filter")
def segment_count_filter(spark, d):
    """Texts of three to twelve clauses."""
    return variants.with_segment_count(load(spark, d, "documents").select("doc_id", "text"), "text", 3, 12).select("doc_id", "n_segments")


@register("subject_points", f"WITH t AS (SELECT row_id, '本题考查的是' || coalesce(exam_subject, '') || coalesce(question, '') || '。' AS t FROM build_cmb_train_sft), p AS (SELECT row_id, regexp_replace(regexp_replace(regexp_extract(t, '^本题考查(?:的是|了|的知识点是|的内容是)?[:：]?\\s*(.+?)[。．；;\\n]', 1), '^{q.SPACE}+|{q.SPACE}+$', '', 'g'), '^[“”\"'']+|[“”\"'']+$', '', 'g') AS point FROM t) SELECT row_id, point FROM p WHERE point <> '' AND length(point) <= 60 AND NOT regexp_matches(point, '[（(][A-E](对|错)')")
def subject_points(spark, d):
    """The points of explanations made of subject and question; those beyond sixty characters are none."""
    t = F.concat(F.lit("本题考查的是"), F.coalesce("exam_subject", F.lit("")), F.coalesce("question", F.lit("")), F.lit("。"))
    return load(spark, d, "build_cmb_train_sft").select("row_id", prompts.knowledge_point(t).alias("point")).filter("point is not null")


@register("completion_texts", "SELECT doc_id, md5(CASE WHEN source IS NOT NULL THEN coalesce(text, '') ELSE '' END) AS text_hash FROM documents")
def completion_texts(spark, d):
    """The text of a completion that is one assistant turn; documents without a source stand as a user's."""
    role = F.when(F.col("source").isNotNull(), "assistant").otherwise("user")
    t = load(spark, d, "documents").select("doc_id", answers.completion_text(F.array(F.struct(role.alias("role"), F.col("text").alias("content")))).alias("t"))
    return t.select("doc_id", F.md5("t").alias("text_hash"))


@register("reply_scores", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE [event_id % 7, event_id % 4 + 1]::INTEGER[] END AS scores, CASE WHEN event_id % 5 = 0 THEN 'unparsed' WHEN event_id % 7 BETWEEN 1 AND 5 THEN NULL ELSE 'range_ok' END AS drop_reason FROM events")
def reply_scores(spark, d):
    """Scores read from replies that end in a list, some without one, some out of range."""
    e = load(spark, d, "events")
    listed = F.concat(F.lit("第[3]句，评分：["), F.pmod("event_id", F.lit(7)).cast("string"), F.lit("， "), (F.pmod("event_id", F.lit(4)) + 1).cast("string"), F.lit("]。"))
    reply = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit("无法评分")).otherwise(listed)
    s = e.select("event_id", harness.parsed_scores(reply).alias("scores"))
    return s.select("event_id", "scores", harness.score_filters(F.col("scores"), F.array(F.lit(0), F.lit(1)))["drop_reason"].alias("drop_reason"))


@register("selected_items", f"WITH r AS (SELECT DISTINCT unit FROM build_ablation_sets WHERE source = 'cmexam'), k AS (SELECT row_id, unit, {q.fraction("'42'", "'harness'", 'row_id', sep='|')} AS f FROM build_ablation_sets WHERE unit <> '' AND unit NOT IN (SELECT unit FROM r WHERE unit IS NOT NULL)), o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY unit ORDER BY f, row_id) = 1) SELECT unit, row_id FROM o ORDER BY f, row_id LIMIT 200")
def selected_items(spark, d):
    """The first 200 units by stable fraction, none that another source has; a row stands for its unit."""
    a = load(spark, d, "build_ablation_sets").filter("unit != ''")
    items = a.select("unit", F.col("row_id").alias("sample_id"), stable_fraction("|", F.lit("42"), F.lit("harness"), F.col("row_id").cast("string")).alias("f"))
    picked, _ = harness.select_items(items, a.filter("source = 'cmexam'").select("unit"), "unit", "f", 200)
    return picked.select("unit", F.col("sample_id").alias("row_id"))
