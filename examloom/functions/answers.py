"""Answers: five ways to normalise letters, each with its own treatment of bad input, and parsers of completions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from examloom.functions.text import SPACE, strip, unix_lines

# Separators between answer letters, labels, formats and modes.
SEPARATORS = rf"[{SPACE},，、/]"
LABEL = r"(?:最终答案|答案)"
MODES = ("direct", "cot", "adaptive")
_BODY = rf"[A-Za-z](?:[{SPACE},，、/]*[A-Za-z])*"
_LABELED = rf"(?im)^[ \t]*{LABEL}[ \t]*[:：][ \t]*({_BODY})[ \t]*$"
_TARGETS = {
    "answer_with_analysis": (r"^答案：([A-Z]+)\n解析：(\S[\s\S]*)$", 1, 2),
    "analysis_with_final_answer": (r"^分析：(\S[\s\S]*?)\n最终答案：([A-Z]+)$", 2, 1),
    "explanation_with_answer": (r"^解析：(\S[\s\S]*?)\n答案：([A-Z]+)$", 2, 1),
}


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _sorted(letters: Column) -> Column:
    return F.array_join(F.array_sort(letters), "")


def strict_answer(raw: Column, valid: Column | None = None) -> Column:
    """Sorted letters; null if there is anything but letters and separators, a repeated letter or one that is not valid."""
    compact = F.upper(F.regexp_replace(raw, SEPARATORS, ""))
    letters = characters(compact)
    good = compact.rlike("^[A-Z]+$") & (F.size(F.array_distinct(letters)) == F.size(letters))
    if valid is not None:
        good = good & (F.size(F.array_except(letters, characters(valid))) == 0)
    return F.when(good, _sorted(letters))


def distinct_answer(raw: Column, labels: Column) -> Column:
    """struct(answer, reason): repeated letters count once, other faults give a reason. labels: array of letters."""
    compact = F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), f"[{SPACE}]", "")
    letters = characters(compact)
    reason = F.when(~compact.rlike("^[A-Z]+$"), "invalid_answer_format").when(F.size(F.array_except(letters, labels)) > 0, "answer_not_in_options")
    return F.struct(F.when(reason.isNull(), _sorted(F.array_distinct(letters))).alias("answer"), reason.alias("reason"))


def scorer_answer(raw: Column) -> Column:
    """Every letter A to G found anywhere, full width too, once and in order; null gives an empty answer."""
    text = F.translate(F.upper(F.coalesce(raw, F.lit(""))), "ＡＢＣＤＥＦＧ", "ABCDEFG")
    return _sorted(F.array_distinct(F.regexp_extract_all(text, F.lit("([A-G])"), 1)))


def letter_set(raw: Column) -> Column:
    """Every letter A to Z found anywhere as a sorted array; null gives an empty one."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(raw.cast("string"), F.lit(""))), F.lit("([A-Z])"), 1)))


def completion_text(messages: Column) -> Column:
    """The text of a conversation that is one assistant turn, else empty."""
    first = F.try_element_at(messages, F.lit(1))
    one = (F.size(messages) == 1) & (first["role"] == "assistant")
    return F.when(one, F.coalesce(first["content"], F.lit(""))).otherwise("")


def labeled_answer(text: Column, valid: Column) -> Column:
    """The answer of the only labelled line; null with no such line or several."""
    found = F.regexp_extract_all(text, F.lit(_LABELED), 1)
    return F.when(F.size(found) == 1, strict_answer(F.try_element_at(found, F.lit(1)), valid))


def predicted_answer(text: Column, valid: Column) -> Column:
    """Bare letters, else the only labelled answer."""
    t = strip(unix_lines(F.coalesce(text, F.lit(""))))
    return F.coalesce(strict_answer(t, valid), labeled_answer(t, valid))


def reference_target(text: Column, valid: Column) -> Column:
    """struct(answer, answer_format, explanation, reason) of a training target in one of four layouts."""
    t = strip(unix_lines(F.coalesce(text, F.lit(""))))
    bare = strict_answer(t, valid)
    kind = F.when(t == "", F.lit(None).cast("string")).when(bare.isNotNull(), "letters_only")
    answer, why = F.when(bare.isNotNull(), bare), F.lit("")
    for name, (pattern, letters, words) in _TARGETS.items():
        hit = bare.isNull() & t.rlike(pattern)
        kind = kind.when(hit, name)
        answer = answer.when(hit, strict_answer(F.regexp_extract(t, pattern, letters), valid))
        why = F.when(hit, strip(F.regexp_extract(t, pattern, words))).otherwise(why)
    reason = F.when(t == "", "empty_assistant_target").when(kind.isNull(), "unsupported_assistant_target").when(answer.isNull(), "invalid_assistant_answer")
    good = reason.isNull()
    return F.struct(F.when(good, answer).alias("answer"), F.when(good, kind).alias("answer_format"), F.when(good, why).alias("explanation"), reason.alias("reason"))


def parse_completion(text: Column, mode: str, valid: Column, lenient: Column | bool = False) -> Column:
    """struct(answer, strict, used_cot, analysis_chars) of a model output in one of three modes."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    t = strip(unix_lines(F.coalesce(text, F.lit(""))))
    bare = strict_answer(t, valid)
    if mode == "direct":
        return F.struct(predicted_answer(t, valid).alias("answer"), F.coalesce(bare == t, F.lit(False)).alias("strict"), F.lit(False).alias("used_cot"), F.lit(0).alias("analysis_chars"))
    easy = lenient if isinstance(lenient, Column) else F.lit(lenient)
    # several labelled lines leave the answer open unless the whole output is bare letters and that is allowed
    answer = F.coalesce(labeled_answer(t, valid), F.when(easy, bare))
    pattern = r"^解析：(\S[\s\S]*?)\n答案：([A-Z]+)$" if mode == "cot" else r"^(?:解析：(\S[\s\S]*?)\n)?答案：([A-Z]+)$"
    hit = t.rlike(pattern)
    analysis, raw = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    clean = F.coalesce(strict_answer(raw, valid) == raw, F.lit(False)) & ~analysis.rlike(rf"(?m)^[{SPACE}]*{LABEL}[{SPACE}]*[:：]")
    return F.struct(
        answer.alias("answer"), (hit & clean).alias("strict"), F.when(hit, analysis != "").otherwise(t.startswith("解析：")).alias("used_cot"),
        F.when(hit, F.length(strip(analysis))).otherwise(0).alias("analysis_chars"),
    )


def extract_choice(text: Column, valid: Column, multiple: Column) -> Column:
    """The evaluator's lenient reading: a labelled answer, a bare one, else any valid letter; empty if there is none."""
    t = F.upper(F.translate(F.coalesce(text, F.lit("")), "ａｂｃｄｅｆｇＡＢＣＤＥＦＧ", "abcdefgABCDEFG"))
    allowed, run = characters(valid), rf"([A-Z](?:[{SPACE},，、/;；和与及]*[A-Z])*)"
    among = lambda s: F.filter(characters(s), lambda c: F.array_contains(allowed, c))
    tries = [F.regexp_extract(t, rf"(?:答案|选项|选择)[{SPACE}]*(?:是|为|：|:)?[{SPACE}]*{run}", 1), F.regexp_extract(t, rf"^[{SPACE}]*{run}[{SPACE}]*[。.!！]?[{SPACE}]*$", 1), t]
    letters = among(tries[2])
    for s in (tries[1], tries[0]):
        letters = F.when(F.size(among(s)) > 0, among(s)).otherwise(letters)
    every = F.array_join(F.filter(allowed, lambda c: F.array_contains(letters, c)), "")
    return F.when(F.size(letters) == 0, "").when(multiple, every).otherwise(F.try_element_at(letters, F.lit(1)))


def type_hint(question_type: Column, answer: Column) -> Column:
    """The sentence that tells single from multiple choice; from the type where there is one, else from the answer."""
    # fixed values
    single, many = "本题是单项选择题", "本题是多项选择题"
    return F.when(F.coalesce(question_type, F.lit("")) != "", F.when(question_type.contains("多项"), many).otherwise(single)).when(
        answer.isNotNull(), F.when(F.length(strip(answer)) > 1, many).otherwise(single)
    )
