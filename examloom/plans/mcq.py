"""Queries over exam records: parsing, keys, deduplication, decontamination, prompts, subsets and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.functions import prompts, text
from examloom.operators import audit, decontam, dedup, records, sampling
from examloom.plans import sqltext as q
from examloom.plans.registry import load, register
from examloom.session import materialize

DROPPED_TYPE, MAX_CHARS, NEAR, BORDER = "配伍题", 900, 0.7, 0.5


def exam_rows(spark, d):
    c = load(spark, d, "build_cmb_train_sft")
    return c.withColumn("p", records.parse_exam_row(F.col("question"), F.col("options"), F.col("answer")))


@register("exam_parse", f"WITH {q.EXAM} SELECT row_id, reason, CASE WHEN reason IS NULL THEN q END AS question, CASE WHEN reason IS NULL THEN array_to_string(list_sort({q.letters('ans')}), '') END AS answer, CASE WHEN reason IS NULL THEN len(t) END AS n_options, CASE WHEN reason IS NULL THEN len(core) < len(t) END AS has_empty_option FROM exam")
def exam_parse(spark, d):
    p = F.col("p")
    return exam_rows(spark, d).select("row_id", p["reason"].alias("reason"), p["question"].alias("question"), p["answer"].alias("answer"), F.when(p["reason"].isNull(), F.size(p["options"])).alias("n_options"), p["has_empty_option"].alias("has_empty_option"))


@register("exam_reasons", f"WITH {q.EXAM} SELECT coalesce(reason, 'ok') AS reason, split, count(*) AS n FROM exam GROUP BY ALL")
def exam_reasons(spark, d):
    return exam_rows(spark, d).groupBy(F.coalesce("p.reason", F.lit("ok")).alias("reason"), "split").agg(F.count("*").alias("n"))


@register("question_keys", f"SELECT row_id, {q.question_key('question')} AS question_key, {q.stem('question')} AS stem_key, {q.display('question')} AS display FROM build_cmb_train_sft")
def question_keys(spark, d):
    c, t = load(spark, d, "build_cmb_train_sft"), F.col("question")
    return c.select("row_id", text.question_key(t).alias("question_key"), text.stem_key(t).alias("stem_key"), text.display_text(t).alias("display"))


_UNIT = f"sha256({q.stem('question')} || '||' || array_to_string(list_sort(list_transform(options, lambda o: {q.stem('o.text')})), '|'))"


def with_unit(a):
    keys = text.option_keys(prompts.option_texts(F.col("options")))
    return a.withColumn("stem", text.stem_key(F.col("question"))).withColumn("option_keys", keys).withColumn("unit_hash", text.stem_option_hash(F.col("stem"), F.col("option_keys")))


@register("unit_hashes", f"SELECT row_id, CASE WHEN options IS NOT NULL THEN {_UNIT} END AS unit_hash FROM build_ablation_sets")
def unit_hashes(spark, d):
    return with_unit(load(spark, d, "build_ablation_sets")).select("row_id", "unit_hash")


@register("unit_first_seen", f"WITH u AS (SELECT row_id, {_UNIT} AS unit_hash FROM build_ablation_sets WHERE options IS NOT NULL) SELECT unit_hash, min(row_id) AS row_id FROM u GROUP BY ALL")
def unit_first_seen(spark, d):
    u = with_unit(load(spark, d, "build_ablation_sets").filter("options is not null")).select("row_id", "unit_hash")
    return dedup.first_seen(u, "unit_hash", "row_id").select("unit_hash", "row_id")


@register("exam_last_wins", "SELECT id, max(row_id) AS row_id, min(row_id) AS first_row_id, arg_max(answer, row_id) AS answer FROM (SELECT id, row_id, coalesce(answer, '') AS answer FROM build_cmb_train_sft) GROUP BY id")
def exam_last_wins(spark, d):
    c = load(spark, d, "build_cmb_train_sft").select("id", "row_id", F.coalesce("answer", F.lit("")).alias("answer"))
    return dedup.last_wins(c, "id", "row_id")


@register("exam_first_valid", f"WITH {q.EXAM}, k AS (SELECT *, {q.question_key('question')} AS k FROM exam), f AS (SELECT k, min(row_id) AS f FROM k WHERE reason IS NULL AND k <> '' GROUP BY k) SELECT row_id, CASE WHEN row_id > f THEN 'duplicate' ELSE coalesce(reason, 'written') END AS outcome FROM k LEFT JOIN f USING (k)")
def exam_first_valid(spark, d):
    e = exam_rows(spark, d).select("row_id", text.question_key(F.col("question")).alias("k"), F.col("p.reason").alias("reason"))
    return dedup.first_valid(e, "k", "row_id", "reason").select("row_id", "outcome")


def _parts(spark, d):
    """(train rows with stem, hash and texts; reference rows of the evaluation splits with a stem)."""
    e = exam_rows(spark, d).withColumn("stem", text.stem_key(F.col("question")))
    values = F.map_values(F.coalesce("options", F.create_map().cast("map<string,string>")))
    ref = e.filter("split in ('val', 'test') and stem != ''").select("stem", F.col("row_id").alias("ordinal"), F.col("split").alias("source"), text.stem_option_hash(F.col("stem"), text.option_keys(values)).alias("unit"))
    train = e.filter("split = 'train'").withColumn("unit", text.stem_option_hash(F.col("stem"), text.option_keys(prompts.option_texts(F.col("p.options")))))
    return train, ref


_REF = f"ref AS (SELECT row_id, split, {q.stem('question')} AS stem, sha256({q.stem('question')} || '||' || array_to_string(list_sort(list_transform(map_values(coalesce(options, MAP {{}})), lambda v: {q.stem('v')})), '|')) AS unit FROM build_cmb_train_sft WHERE split IN ('val', 'test')), refs AS (SELECT * FROM ref WHERE stem <> '')"
_TRAIN = f"train AS (SELECT *, {q.stem('question')} AS stem, sha256({q.stem('question')} || '||' || array_to_string(list_sort(list_transform(t, lambda v: {q.stem('v')})), '|')) AS unit FROM exam WHERE split = 'train')"


@register("decontam_exact", f"WITH {_REF}, c AS (SELECT stem, count(*) AS n_references, list_sort(list(row_id))[1:3] AS first_references FROM refs GROUP BY stem) SELECT row_id, n_references, first_references FROM (SELECT row_id, {q.stem('question')} AS stem FROM build_cmb_train_sft WHERE split = 'train') JOIN c USING (stem)")
def decontam_exact(spark, d):
    c = load(spark, d, "build_cmb_train_sft").select("row_id", "split", text.stem_key(F.col("question")).alias("stem"))
    ref = c.filter("split in ('val', 'test') and stem != ''").select("stem", F.col("row_id").alias("ordinal"))
    return dedup.blocked_by(c.filter("split = 'train'").select("row_id", "stem"), ref, "stem").drop("stem")


_GRAMS = "CASE WHEN length(s) < 5 THEN [s] ELSE list_distinct(list_transform(range(1, length(s) - 3), lambda i: s[i:i+4])) END"


def _near_sql(left: str, right: str, threshold: float) -> str:
    """CTE near(s, r, j): the best reference of each stem by exact Jaccard, over all pairs that share a gram."""
    return f"""l AS (SELECT s, {_GRAMS} AS g FROM (SELECT DISTINCT stem AS s FROM {left} WHERE length(stem) >= 8)), r AS (SELECT s, {_GRAMS} AS g FROM (SELECT DISTINCT stem AS s FROM {right} WHERE length(stem) >= 8)),
lx AS (SELECT s, len(g) AS n, unnest(g) AS x FROM l), rx AS (SELECT s, len(g) AS n, unnest(g) AS x FROM r),
cc AS (SELECT lx.s AS s, rx.s AS r, count(*) / (any_value(lx.n) + any_value(rx.n) - count(*))::DOUBLE AS j FROM lx JOIN rx USING (x) GROUP BY lx.s, rx.s),
near AS (SELECT s, max(j) AS j, max(r) FILTER (j = m) AS r FROM (SELECT *, max(j) OVER (PARTITION BY s) AS m FROM cc WHERE j >= {threshold}) GROUP BY s)"""


@register("decontam_near", f"WITH {_REF}, tr AS (SELECT {q.stem('question')} AS stem FROM build_cmb_train_sft WHERE split = 'train'), {_near_sql('tr', 'refs', BORDER)} SELECT s AS stem, r AS ref_stem, j AS jaccard FROM near")
def decontam_near(spark, d):
    c = load(spark, d, "build_cmb_train_sft").select("split", text.stem_key(F.col("question")).alias("stem"))
    ref = c.filter("split in ('val', 'test')").select(F.col("stem").alias("ref_stem"))
    return decontam.near_scores(c.filter("split = 'train'"), ref, "stem", "ref_stem", BORDER)


_FUNNEL = f"""WITH {q.EXAM}, {_REF}, {_TRAIN},
g1 AS (SELECT *, CASE WHEN question_type = '{DROPPED_TYPE}' THEN 'dropped_type' WHEN reason IS NOT NULL THEN 'invalid' WHEN length(q) + list_sum(list_transform(t, lambda x: length(x))) > {MAX_CHARS} THEN 'too_long' END AS gate FROM train),
fs AS (SELECT unit, min(row_id) AS f FROM g1 WHERE gate IS NULL GROUP BY unit),
g2 AS (SELECT g1.*, CASE WHEN gate IS NOT NULL THEN gate WHEN row_id > f THEN 'duplicate' WHEN stem IN (SELECT stem FROM refs) THEN 'exact_stem' WHEN unit IN (SELECT unit FROM refs) THEN 'stem_options' END AS gate2 FROM g1 LEFT JOIN fs USING (unit)),
left2 AS (SELECT stem FROM g2 WHERE gate2 IS NULL), {_near_sql('left2', 'refs', BORDER)}
SELECT coalesce(gate2, CASE WHEN j >= {NEAR} THEN 'near_duplicate' WHEN j >= {BORDER} THEN 'kept_borderline' ELSE 'kept' END) AS outcome, count(*) AS n FROM g2 LEFT JOIN near ON stem = s GROUP BY ALL"""


def build_outcomes(spark, d):
    """Every training row with the outcome of the decontaminated build; the gates run from cheap to dear."""
    train, ref = _parts(spark, d)
    size = F.length("p.question") + F.aggregate(F.col("p.options"), F.lit(0), lambda a, o: a + F.length(o["text"]))
    gate = dedup.gate([("dropped_type", F.col("question_type") == DROPPED_TYPE), ("invalid", F.col("p.reason").isNotNull()), ("too_long", size > MAX_CHARS)])
    unit = F.unhex("unit").alias("unit")
    t = materialize(train.withColumn("outcome", gate).select("row_id", "stem", unit, "outcome"), "parsed", drop_shuffles=True)
    ref = materialize(ref.select("stem", unit), "references", drop_shuffles=True)
    first = t.filter("outcome is null").groupBy("unit").agg(F.min("row_id").alias("first"))
    stems, units = ref.select("stem").distinct().withColumn("in_stem", F.lit(True)), ref.select("unit").distinct().withColumn("in_unit", F.lit(True))
    # both joins by unit first: the rows are shuffled once for the two, and once more by stem without the unit
    t = t.join(first, "unit", "left").join(units, "unit", "left").drop("unit").join(stems, "stem", "left")
    later = dedup.gate([("duplicate", F.col("row_id") > F.col("first")), ("exact_stem", F.col("in_stem")), ("stem_options", F.col("in_unit"))])
    t = materialize(t.withColumn("outcome", F.coalesce("outcome", later)).select("row_id", "stem", "outcome"), "gated", drop_shuffles=True)
    near = decontam.near_scores(t.filter("outcome is null").select("stem"), ref.select(F.col("stem").alias("ref_stem")), "stem", "ref_stem", BORDER)
    best = F.when(F.col("jaccard") >= NEAR, "near_duplicate").when(F.col("jaccard") >= BORDER, "kept_borderline").otherwise("kept")
    return t.join(near.select("stem", "jaccard"), "stem", "left").withColumn("outcome", F.coalesce("outcome", best))


@register("train_build_funnel", _FUNNEL)
def train_build_funnel(spark, d):
    return build_outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@register("train_holdout", f"WITH f AS (SELECT row_id, {q.fraction("'42'", "'cmb_split'", 'row_id')} AS f FROM build_cmb_train_sft WHERE split = 'train') SELECT row_id, CASE WHEN row_number() OVER (ORDER BY f, row_id) <= 100 THEN 'val' ELSE 'train' END AS split FROM f")
def train_holdout(spark, d):
    c = load(spark, d, "build_cmb_train_sft").filter("split = 'train'").select("row_id")
    return sampling.holdout(c, "row_id", 100)


def _subset_sql(scale: float) -> str:
    return f"""WITH u AS (SELECT unit, arg_min({{'e': coalesce(exam_type, ''), 't': coalesce(question_type, '')}}, row_id) AS s FROM build_ablation_sets WHERE source = 'cmb_train' AND unit <> '' AND variant = 'original' GROUP BY unit),
o AS (SELECT unit, s.e AS exam_type, s.t AS question_type, {q.fraction("'42'", "'ablation_scale'", 'unit')} AS f FROM u)
SELECT unit, exam_type, question_type FROM (SELECT *, row_number() OVER (PARTITION BY exam_type, question_type ORDER BY f, unit) AS r, count(*) OVER (PARTITION BY exam_type, question_type) AS n FROM o) WHERE r <= ceil(n * {scale})"""


def _subset(scale: float):
    def run(spark, d):
        a = load(spark, d, "build_ablation_sets").filter("source = 'cmb_train' and unit != '' and variant = 'original'")
        s = F.struct("row_id", F.coalesce("exam_type", F.lit("")).alias("e"), F.coalesce("question_type", F.lit("")).alias("t"))
        u = a.groupBy("unit").agg(F.min(s).alias("s")).select("unit", F.col("s.e").alias("exam_type"), F.col("s.t").alias("question_type"))
        return sampling.nested_subset(u, ["exam_type", "question_type"], "unit", scale)

    return run


for _name, _scale in (("subset_quarter", 0.25), ("subset_half", 0.5)):
    register(_name, _subset_sql(_scale))(_subset(_scale))


@register("pool_sample", f"SELECT sample_id FROM (SELECT DISTINCT sample_id FROM build_ablation_sets WHERE sample_id IS NOT NULL AND source = 'cmexam') ORDER BY {q.fraction("'42'", "'cot_rl_pool'", 'sample_id', sep='|')}, sample_id LIMIT 500")
def pool_sample(spark, d):
    a = load(spark, d, "build_ablation_sets").filter("sample_id is not null and source = 'cmexam'").select("sample_id")
    return sampling.pool_sample(a, "sample_id", 500)


_USER = "'题目：\n' || question || '\n\n选项：\n' || array_to_string(list_transform(options, lambda o: o.letter || '. ' || coalesce(o.text, '')), '\n')"
_HINT = "CASE WHEN coalesce(question_type, '') <> '' THEN CASE WHEN contains(question_type, '多项') THEN '本题是多项选择题' ELSE '本题是单项选择题' END WHEN gold IS NOT NULL THEN CASE WHEN length(trim(gold)) > 1 THEN '本题是多项选择题' ELSE '本题是单项选择题' END END"


def _whole(spark, d):
    return load(spark, d, "build_ablation_sets").filter("question is not null and options is not null")


@register("prompt_ids", f"SELECT row_id, sha256({_USER} || '\n\n{prompts.SUFFIX['direct']}') AS direct_id, sha256({_USER} || '\n\n{prompts.SUFFIX['cot']}') AS cot_id, sha256({_USER} || coalesce('\n\n提示：' || {_HINT}, '') || '\n\n{prompts.SUFFIX['direct']}') AS hinted_id FROM build_ablation_sets WHERE question IS NOT NULL AND options IS NOT NULL")
def prompt_ids(spark, d):
    from examloom.functions.answers import type_hint

    a, qn, o = _whole(spark, d), F.col("question"), F.col("options")
    made = lambda mode, hint=None: text.sample_id(prompts.prompt_messages(qn, o, mode, hint))
    return a.select("row_id", made("direct").alias("direct_id"), made("cot").alias("cot_id"), made("direct", type_hint(F.col("question_type"), F.col("gold"))).alias("hinted_id"))


@register("prompt_round_trip", "SELECT row_id, TRUE AS same FROM build_ablation_sets WHERE question = trim(question) AND options IS NOT NULL AND NOT regexp_matches(question, '^[\\p{Z}\\s]|[\\p{Z}\\s]$|\\n') AND len(list_filter(options, lambda o: regexp_matches(o.text, '\\n|^[\\p{Z}\\s]|[\\p{Z}\\s]$'))) = 0 AND array_to_string(list_transform(options, lambda o: o.letter), '') = 'ABCDEFG'[1:len(options)]")
def prompt_round_trip(spark, d):
    """Rendered and parsed again, the questions and options are as before."""
    edge = r"\n|^[\p{Z}\s]|[\p{Z}\s]$"
    a = _whole(spark, d).filter(~F.col("question").rlike(edge) & ~F.exists("options", lambda o: o["text"].rlike(edge)))
    a = a.filter(F.array_join(F.transform("options", lambda o: o["letter"]), "") == F.substring(F.lit("ABCDEFG"), F.lit(1), F.size("options")))
    return _parsed_again(a)


def _parsed_again(a):
    p = prompts.parse_user(prompts.render_user(F.col("question"), F.col("options"), "direct"))
    return a.select("row_id", F.coalesce((p["question"] == F.col("question")) & (p["options"] == F.col("options")), F.lit(False)).alias("same"))


@register("prompt_round_trip_all")
def prompt_round_trip_all(spark, d):
    """Every row with question and options; false where line breaks, blanks at the ends, null texts or odd letters do not come back."""
    return _parsed_again(_whole(spark, d))


_OPTS = "array_to_string(list_transform(options, lambda o: o.text), ' ')"


@register("question_slices", f"SELECT row_id, length(coalesce(gold, '')) > 1 AS multi_choice, regexp_matches(question, '{prompts.NEGATION}') AS negation, regexp_matches(question, '{prompts.CASE}') AS \"case\", regexp_matches(question || ' ' || {_OPTS}, '{prompts.CALCULATION}') AS calc, length(question) >= 80 AS long_stem, CASE WHEN length(question) < 30 THEN 'short' WHEN length(question) < 80 THEN 'medium' ELSE 'long' END AS stem_bucket, len(options) AS option_count, len(options) >= 3 AND len(list_filter(options, lambda o: regexp_matches(o.text, '{prompts.UNSAFE}'))) = 0 AS shuffle_safe FROM build_ablation_sets WHERE question IS NOT NULL AND options IS NOT NULL")
def question_slices(spark, d):
    a = _whole(spark, d)
    return a.select("row_id", prompts.slices(F.col("question"), F.col("options"), F.coalesce("gold", F.lit(""))).alias("s")).select("row_id", "s.*")


@register("official_prompts", "SELECT row_id, md5('以下是中国' || CASE WHEN coalesce(exam_type, '') = '' THEN '医学' ELSE exam_type END || '考试中的一道' || CASE WHEN coalesce(question_type, '') = '' THEN '选择题' ELSE question_type END || '。\n请直接给出正确选项，不要输出解析。\n\n题目：\n' || question || '\n\n选项：\n' || array_to_string(list_transform(options, lambda o: o.letter || '. ' || o.text), '\n') || '\n\n只能输出选项字母。单选题例如：A；多选题例如：ABC。') AS prompt_hash FROM build_ablation_sets WHERE question IS NOT NULL AND options IS NOT NULL")
def official_prompts(spark, d):
    p = prompts.official_prompt(F.col("exam_type"), F.lit(None).cast("string"), F.col("question_type"), F.col("question"), F.col("options"))
    return _whole(spark, d).select("row_id", F.md5(p).alias("prompt_hash"))


@register("shuffle_augment")
def shuffle_augment(spark, d):
    """Originals and one permuted copy of each safe question, deduplicated in source order."""
    return audit.shuffle_copies(_whole(spark, d), copies=1).select("row_id", "copy", "sample_id", "answer")


@register("dose_augment")
def dose_augment(spark, d):
    """Three permuted copies of each safe question with several right options, after all originals."""
    return audit.shuffle_copies(_whole(spark, d), copies=3, multiple_only=True, copies_last=True).select("row_id", "copy", "sample_id", "answer")


_CONTENT = f"list_sort(list_transform(list_filter(options, lambda o: contains(gold, o.letter)), lambda o: {q.stem('o.text')}))"


@register("label_conflicts", f"WITH u AS (SELECT row_id, {_UNIT} AS unit_hash, array_to_string({_CONTENT}, '|') AS content FROM build_ablation_sets WHERE options IS NOT NULL AND question IS NOT NULL AND gold IS NOT NULL), c AS (SELECT unit_hash, content, count(*) AS n FROM u GROUP BY ALL), m AS (SELECT unit_hash, count(*) AS k, max(n) AS top, count(*) FILTER (n = mx) AS tops, min(content) FILTER (n = mx) AS keep FROM (SELECT *, max(n) OVER (PARTITION BY unit_hash) AS mx FROM c) GROUP BY unit_hash) SELECT unit_hash, CASE WHEN tops > 1 THEN 'tie' ELSE 'majority' END AS resolution, CASE WHEN tops = 1 THEN keep END AS keep_content, k AS variants FROM m WHERE k > 1")
def label_conflicts(spark, d):
    return audit.label_conflicts(_labelled(spark, d))


def _labelled(spark, d):
    return audit.with_content(with_unit(_whole(spark, d).filter("gold is not null")))


@register("label_audit_clean", f"WITH u AS (SELECT row_id, source, {_UNIT} AS unit_hash, array_to_string({_CONTENT}, '|') AS content FROM build_ablation_sets WHERE options IS NOT NULL AND question IS NOT NULL AND gold IS NOT NULL), c AS (SELECT unit_hash, content, count(*) AS n FROM u GROUP BY ALL), m AS (SELECT unit_hash, count(*) AS k, count(*) FILTER (n = mx) AS tops, min(content) FILTER (n = mx) AS keep FROM (SELECT *, max(n) OVER (PARTITION BY unit_hash) AS mx FROM c) GROUP BY unit_hash), r AS (SELECT * FROM m WHERE k > 1) SELECT source, CASE WHEN source <> 'cmb_train' THEN 'kept' WHEN tops > 1 THEN 'tie_conflict' WHEN tops = 1 AND content <> keep THEN 'minority_label' ELSE 'kept' END AS outcome, count(*) AS n FROM u LEFT JOIN r USING (unit_hash) GROUP BY ALL")
def label_audit_clean(spark, d):
    rows = materialize(_labelled(spark, d).select("row_id", "source", "unit_hash", "content"), "labelled")
    return audit.apply_audit(rows, audit.label_conflicts(rows)).groupBy("source", "outcome").agg(F.count("*").alias("n"))


@register("variant_summary", "SELECT source, variant, count(*) AS n, count(*) FILTER (length(gold) > 1) AS multi, count(DISTINCT exam_type) AS exam_types FROM build_ablation_sets GROUP BY source, variant")
def variant_summary(spark, d):
    a = load(spark, d, "build_ablation_sets")
    return a.groupBy("source", "variant").agg(F.count("*").alias("n"), F.count_if(F.length("gold") > 1).alias("multi"), F.count_distinct("exam_type").alias("exam_types"))


@register("metadata_join", "WITH m AS (SELECT sample_id, max(row_id) AS r FROM build_ablation_sets WHERE sample_id IS NOT NULL GROUP BY sample_id), l AS (SELECT a.* FROM build_ablation_sets a JOIN m ON a.row_id = m.r) SELECT a.row_id, coalesce(l.source, 'unknown') AS source, coalesce(l.variant, 'original') AS variant, coalesce(l.exam_type, '') AS exam_type FROM build_ablation_sets a LEFT JOIN l USING (sample_id)")
def metadata_join(spark, d):
    """Metadata by sample id, of several rows the last one; defaults where there is none."""
    a = load(spark, d, "build_ablation_sets")
    meta = dedup.last_wins(a.filter("sample_id is not null").select("sample_id", "row_id", "source", "variant", "exam_type"), "sample_id", "row_id")
    meta = meta.select("sample_id", F.col("source").alias("s"), F.col("variant").alias("v"), F.col("exam_type").alias("e"))
    j = a.select("row_id", "sample_id").join(meta, "sample_id", "left")
    return j.select("row_id", F.coalesce("s", F.lit("unknown")).alias("source"), F.coalesce("v", F.lit("original")).alias("variant"), F.coalesce("e", F.lit("")).alias("exam_type"))
