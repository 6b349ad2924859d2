"""Validation examples, one record a question from its completions, and the headroom they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions import prompts, text
from examloom.functions.answers import parse_completion, reference_target, type_hint
from examloom.functions.text import stable_fraction
from examloom.operators.evaluation import bucket, consistent, majority_vote

SLICES = ("multi_choice", "negation", "case", "calc", "long_stem")


def examples(records: DataFrame, mode: str, limit: int | None = None, shuffle_seed: int | None = None, hints: DataFrame | None = None, with_hint: bool = False) -> DataFrame:
    """Questions of training records with prompts rendered for a mode; a record of another layout is left out.

    The limit is taken in file order, or by stable hash where a seed is given. hints: (sample_id, question_type).
    """
    user = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["content"]
    d = records.withColumn("p", prompts.parse_user(user)).filter("p.options is not null")
    d = d.select("sample_id", "line_no", F.col("p.question").alias("question"), F.col("p.options").alias("options"), F.col("target.answer").alias("gold"), "valid_letters")
    hint = None
    if with_hint:
        kinds = hints if hints is not None else d.select("sample_id", F.lit(None).cast("string").alias("question_type")).limit(0)
        d = d.join(kinds.dropDuplicates(["sample_id"]), "sample_id", "left")
        hint = type_hint(F.col("question_type"), F.col("gold"))
    s = prompts.slices(F.col("question"), F.col("options"), F.col("gold"))
    d = d.withColumn("s", s).withColumn("messages", prompts.prompt_messages(F.col("question"), F.col("options"), mode, hint))
    d = d.select("sample_id", "line_no", "question", "options", "gold", "valid_letters", F.struct(*[F.col(f"s.{n}").alias(n) for n in SLICES]).alias("slices"), F.col("s.shuffle_safe").alias("shuffle_safe"), "messages")
    if limit is None:
        return d
    order = ["line_no"] if shuffle_seed is None else [stable_fraction(":", F.lit(str(shuffle_seed)), F.lit("diagnose"), F.col("sample_id")), "sample_id"]
    return d.orderBy(*order).limit(limit)


def records(questions: DataFrame, completions: DataFrame, mode: str, samples: int) -> DataFrame:
    """One record a question. completions: sample_id, kind (greedy, sample, permuted), copy, text, permutation.

    A question has a handful of completions, so all kinds are gathered in one group by question.
    """
    c = completions.join(questions.select("sample_id", "gold", "valid_letters"), "sample_id")
    p = c.withColumn("p", parse_completion(F.col("text"), mode, F.col("valid_letters")))
    mine = F.when(F.col("kind") == "permuted", prompts.unmap_answer(F.col("p.answer"), F.col("permutation"))).otherwise(F.col("p.answer"))
    p = p.withColumn("answer", mine).withColumn("right", F.col("answer").eqNullSafe(F.col("gold")))
    kind = lambda k: F.col("kind") == k
    listed = lambda k, *cols: F.transform(F.array_sort(F.collect_list(F.when(kind(k), F.struct("copy", *cols)))), lambda x: x)
    g = p.groupBy("sample_id").agg(
        F.max(F.when(kind("greedy"), F.struct(F.lit(1).alias("one"), F.col("text").alias("text"), "answer", "right", F.col("p.strict").alias("strict"), F.col("p.used_cot").alias("used_cot")))).alias("g"),
        listed("sample", "answer", "right").alias("s"), listed("permuted", "permutation", "answer", "right").alias("v"),
    )
    votes = majority_vote(p.filter(kind("sample")), ["sample_id"], "answer", "copy").select("sample_id", F.col("majority").alias("majority_answer"))
    d = questions.select("sample_id", "line_no", "gold", "slices").join(g, "sample_id").join(votes, "sample_id", "left")
    n = F.size(F.filter("s", lambda x: x["right"]))
    some, varied = F.size("s") > 0, F.size("v") > 0
    answers = F.transform("v", lambda x: x["answer"])
    return d.select(
        "sample_id", "line_no", "gold", "slices", F.col("g.text").alias("greedy_text"), F.col("g.answer").alias("greedy_answer"), F.col("g.right").alias("greedy_correct"), F.col("g.strict").alias("greedy_strict"), F.col("g.used_cot").alias("greedy_used_cot"),
        F.when(some, F.transform("s", lambda x: x["answer"])).alias("sampled_answers"), F.when(some, n).alias("correct_count"), F.when(some, F.col("majority_answer")).alias("majority_answer"),
        F.when(some, F.col("majority_answer").eqNullSafe(F.col("gold"))).alias("majority_correct"), F.when(some, bucket(n, F.lit(samples))).alias("bucket"),
        F.when(varied, F.transform("v", lambda x: F.struct(x["permutation"].alias("permutation"), x["answer"].alias("answer_original_letters"), x["right"].alias("correct")))).alias("permutations"),
        F.when(varied, consistent(F.col("g.answer"), answers)).alias("shuffle_consistent"),
    )


def _rate(c: Column) -> Column:
    """A mean that leaves nulls out, to four places."""
    return F.round(F.avg(c.cast("double")), 4)


def summary(recs: DataFrame, samples: int) -> DataFrame:
    """Rates over all questions and over each slice, from one pass; differences are of rounded rates."""
    every = [F.struct(F.lit("overall").alias("slice"), F.lit(True).alias("inside"))] + [F.struct(F.lit(n).alias("slice"), F.col(f"slices.{n}").alias("inside")) for n in SLICES]
    d = recs.withColumn("w", F.explode(F.array(*every))).filter("w.inside")
    per = F.when(F.size("permutations") > 0, F.size(F.filter("permutations", lambda p: p["correct"])) / F.size("permutations"))
    g = d.groupBy("w.slice").agg(
        F.count("*").alias("questions"), _rate(F.col("greedy_correct")).alias("pass1_greedy"), _rate(F.col("greedy_strict")).alias("greedy_strict_format_rate"), _rate(F.col("greedy_used_cot")).alias("greedy_cot_rate"),
        _rate(F.col("correct_count") > 0).alias("pass_at_k"), _rate(F.when(F.col("correct_count").isNotNull(), F.col("majority_correct"))).alias("sc_at_k"), _rate(F.col("correct_count") / samples).alias("sampled_accuracy_mean"),
        _rate(F.col("shuffle_consistent")).alias("shuffle_consistency_rate"), _rate(per).alias("shuffle_accuracy"),
    )
    return g.withColumn("sharpening_headroom", F.round(F.col("pass_at_k") - F.col("pass1_greedy"), 4)).withColumn("self_consistency_gap", F.round(F.col("sc_at_k") - F.col("pass1_greedy"), 4))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records of two runs side by side: common questions with both flags, others flagged as only in one."""
    last = lambda d: d.groupBy("sample_id").agg(F.max_by(F.struct("greedy_correct", "greedy_answer", "slices"), "line_no").alias("r"))
    j = last(a).withColumnRenamed("r", "a").join(last(b).withColumnRenamed("r", "b"), "sample_id", "full")
    where = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("common")
    return j.select("sample_id", where.alias("where"), F.col("a.greedy_correct").alias("a_right"), F.col("b.greedy_correct").alias("b_right"), F.col("a.greedy_answer").alias("a_answer"), F.col("b.greedy_answer").alias("b_answer"), F.col("b.slices").alias("slices"))


def harness_items(conversations: DataFrame) -> DataFrame:
    """(sample_id, question, options, gold, explanation, messages, reason) of records for annotation; a reason skips one."""
    m = F.col("messages")
    user = F.try_element_at(F.filter(m, lambda x: x["role"] == "user"), F.lit(1))["content"]
    reply = F.try_element_at(m, F.lit(-1))
    p = prompts.parse_user(user)
    letters = F.array_join(F.transform(p["options"], lambda o: o["letter"]), "")
    t = reference_target(reply["content"], F.coalesce(letters, F.lit("")))
    reason = F.when((F.coalesce(F.size(m), F.lit(0)) < 2) | ~F.coalesce(reply["role"] == "assistant", F.lit(False)), "bad_messages").when(p["options"].isNull(), "unparsable").when(t["reason"].isNotNull(), "no_answer")
    return conversations.select(text.sample_id(m).alias("sample_id"), p["question"].alias("question"), p["options"].alias("options"), t["answer"].alias("gold"), t["explanation"].alias("explanation"), m.alias("messages"), reason.alias("reason"))


def audit_tables(resolutions: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conflicts, structural) in the form that audit.apply_audit takes, from a label audit's two files."""
    keep = F.array_join(F.array_sort("keep_content"), "|")
    tie = F.col("resolution") == "tie"
    conflicts = resolutions.select(F.col("hash").alias("unit_hash"), F.when(tie, "tie").otherwise("majority").alias("resolution"), F.when(~tie, keep).alias("keep_content")).dropDuplicates(["unit_hash"])
    known = flags.filter(F.col("reason").isin("figure_reference", "truncated_stem") & (F.coalesce("hash", F.lit("")) != ""))
    return conflicts, known.groupBy(F.col("hash").alias("unit_hash")).agg(F.first("reason").alias("reason"))
