"""Raw exam records to checked rows: one struct with the parsed fields and the first reason against a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.answers import SEPARATORS, characters, distinct_answer, reference_target
from examloom.functions.prompts import letter_at, parse_option_lines, valid_letters
from examloom.functions.text import display_text, sample_id, strip

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parse_exam_row(question: Column, options: Column, answer: Column) -> Column:
    """struct(reason, question, options, answer, has_empty_option) of a record whose options are a map of letter to text.

    The checks run in a fixed order and the first that fails names the row. Empty options at the end are legal and kept.
    """
    q = display_text(question)
    letters = F.array_sort(F.map_keys(F.coalesce(options, F.create_map().cast("map<string,string>"))))
    texts = F.transform(letters, lambda k: display_text(options[k]))
    # the last option with a text ends the list that is checked
    used = F.array_max(F.transform(texts, lambda t, i: F.when(t != "", i + 1).otherwise(0)))
    core = F.slice(texts, F.lit(1), F.coalesce(used, F.lit(0)))
    compact = F.upper(F.regexp_replace(F.coalesce(answer, F.lit("")), SEPARATORS, ""))
    chosen = characters(compact)
    n = F.size(letters)
    reason = (
        F.when(q == "", "empty_question")
        .when(n == 0, "empty_options")
        .when((F.array_join(letters, "") != F.substring(F.lit(ALPHABET), F.lit(1), n)) | (n < 3), "invalid_option_letters")
        .when(F.exists(core, lambda t: t == ""), "empty_option_text")
        .when(F.size(core) < 3, "too_few_options")
        .when(F.size(F.array_distinct(core)) != F.size(core), "duplicate_option_text")
        .when(~compact.rlike("^[A-Z]+$") | (F.size(F.array_distinct(chosen)) != F.size(chosen)), "invalid_answer")
        .when(F.size(F.array_except(chosen, letters)) > 0, "answer_not_in_options")
        .when(F.size(F.array_except(chosen, F.slice(letters, F.lit(1), F.size(core)))) > 0, "answer_on_empty_option")
    )
    good = reason.isNull()
    return F.struct(
        reason.alias("reason"), F.when(good, q).alias("question"), F.when(good, F.transform(texts, lambda t, i: F.struct(letter_at(i).alias("letter"), t.alias("text")))).alias("options"),
        F.when(good, F.array_join(F.array_sort(chosen), "")).alias("answer"), F.when(good, F.size(core) < n).alias("has_empty_option"),
    )


def parse_sheet_row(question: Column, options: Column, answer: Column) -> Column:
    """struct(reason, question, options, answer) of a row whose options are lines of one text field."""
    q, parsed = display_text(question), parse_option_lines(options)
    given = distinct_answer(answer, F.transform(parsed["options"], lambda o: o["letter"]))
    reason = F.when(q == "", "empty_question").otherwise(F.coalesce(parsed["reason"], given["reason"]))
    good = reason.isNull()
    return F.struct(reason.alias("reason"), F.when(good, q).alias("question"), F.when(good, parsed["options"]).alias("options"), F.when(good, given["answer"]).alias("answer"))


def conversation_reason(messages: Column, keys: Column | None = None, need_answer_line: bool = False) -> Column:
    """Why a conversation is no training record, null if it is one: roles, contents, and the assistant's turn last and only."""
    roles = F.transform(messages, lambda m: m["role"])
    blank = F.exists(messages, lambda m: F.coalesce(strip(m["content"]), F.lit("")) == "")
    reason = F.when(keys != F.array(F.lit("messages")), "unexpected_keys") if keys is not None else F.when(F.lit(False), "")
    reason = (
        reason.when(F.coalesce(F.size(messages), F.lit(0)) < 2, "too_few_messages")
        .when(F.exists(roles, lambda r: ~F.coalesce(r.isin("system", "user", "assistant"), F.lit(False))), "unknown_role")
        .when(blank, "blank_content")
        .when(F.element_at(roles, -1) != "assistant", "last_is_not_assistant")
        .when(F.array_position(roles, "assistant") != F.size(roles), "early_assistant")
    )
    if need_answer_line:
        reason = reason.when(~F.element_at(messages, -1)["content"].rlike(r"\n答案：[A-Z]+\s*$"), "no_answer_line")
    return reason


def parsed_records(df: DataFrame, messages: str = "messages") -> DataFrame:
    """df with sample_id, valid letters and the parsed target of each conversation."""
    m = F.col(messages)
    user = F.try_element_at(F.filter(m, lambda x: x["role"] == "user"), F.lit(-1))["content"]
    d = df.withColumn("sample_id", sample_id(m)).withColumn("valid_letters", valid_letters(user))
    d = d.withColumn("target", reference_target(F.element_at(m, -1)["content"], F.coalesce("valid_letters", F.lit(""))))
    return d.withColumn("is_multi_choice", F.length("target.answer") > 1)
