"""Readers of the formats that exam data come in: JSON lines, JSON arrays and wrappers, sheets, predictions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examloom.functions.answers import letter_set, scorer_answer
from examloom.functions.prompts import parse_user
from examloom.functions.text import question_key, stem_key, strip
from examloom.operators.records import conversation_reason, parsed_records

MESSAGES = "array<struct<role:string,content:string>>"
EXAM_ROW = "id string, exam_type string, exam_class string, exam_subject string, question string, answer string, question_type string, option map<string,string>"
# Names that files use for the same field, first present one first.
ID_FIELDS = ("id", "question_id", "qid", "sample_id")
GOLD_FIELDS = ("gold", "answer", "label", "gold_answer", "reference")
PREDICTION_FIELDS = ("prediction", "pred", "predicted", "model_answer", "predicted_answer", "choice")
CORRECT_FIELDS = ("correct", "is_correct")
TRUTH_FIELDS = ("answer", "model_answer", "correct_answer", "standard_answer", "gold_answer")
WRAPPERS = ("data", "test", "questions", "records", "items")
TRUTH_WRAPPERS = ("data", "test", "answers", "records", "items")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of every line. Split files keep their numbering: lines are counted by split and added up.

    The only window over all is the one over splits, a row for each of some hundred megabytes.
    """
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("file", "block").orderBy("_at")))
    size = d.groupBy("file", "block").agg(F.max("_n").alias("_k"))
    base = size.withColumn("_base", F.sum("_k").over(Window.partitionBy("file").orderBy("block")) - F.col("_k")).drop("_k")
    return d.join(base, ["file", "block"]).select("file", (F.col("_base") + F.col("_n")).alias("line_no"), "value")


def read_conversations(spark: SparkSession, path: str, need_answer_line: bool = False) -> DataFrame:
    """(file, line_no, messages, reason): a line that is no training record has the reason against it. Blank lines are left out."""
    d = read_lines(spark, path).filter(strip(F.col("value")) != "")
    d = d.withColumn("messages", F.from_json("value", f"messages {MESSAGES}")["messages"])
    return d.withColumn("reason", conversation_reason(F.col("messages"), F.json_object_keys("value"), need_answer_line)).drop("value")


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Parsed training records of a file or folder; an error names the first bad line, a repeated prompt or an empty file."""
    d = read_conversations(spark, path)
    p = parsed_records(d)
    bad = p.withColumn("reason", F.coalesce("reason", F.when(F.col("valid_letters").isNull(), "no_option_letters"), "target.reason")).filter("reason is not null").orderBy("file", "line_no").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}:{bad[0]['line_no']}: {bad[0]['reason']}")
    again = p.groupBy("sample_id").agg(F.count("*").alias("n"), F.max("line_no").alias("line_no")).filter("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"line {again[0]['line_no']}: the prompt is there {again[0]['n']} times")
    if p.isEmpty():
        raise ValueError(f"{path}: no records")
    return p


def record_counts(records: DataFrame) -> DataFrame:
    """(what, value, n) by answer format, single or multiple, and answer, in one pass."""
    what = F.array(
        F.struct(F.lit("format").alias("what"), F.col("target.answer_format").alias("value")), F.struct(F.lit("kind").alias("what"), F.when(F.col("is_multi_choice"), "multiple").otherwise("single").alias("value")),
        F.struct(F.lit("answer").alias("what"), F.col("target.answer").alias("value")),
    )
    return records.select(F.explode(what).alias("w")).groupBy("w.what", "w.value").agg(F.count("*").alias("n"))


def read_exam_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, options as a map; the schema is given, so that nothing is read to infer it."""
    return spark.read.schema(EXAM_ROW).json(path, multiLine=True)


def read_sheet(spark: SparkSession, path: str, required: tuple[str, ...] = ("Question", "Options", "Answer")) -> DataFrame:
    """A CSV with multi-line fields and an optional byte order mark; missing columns are an error."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in required if c not in d.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return d


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def _entries(spark: SparkSession, path: str, wrappers: tuple[str, ...]) -> DataFrame:
    """(file, wrapped, pos, key, value) of the JSON documents of a path, each file by its own layout.

    A list, a list under the first wrapper that holds one, or an object, whose entries have a key instead of a place.
    """
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"), F.col("_metadata.file_path").alias("file"))
    root = F.col("v")
    for w in reversed(wrappers):
        inner = F.try_variant_get("v", f"$.{w}", "variant")
        root = F.when(_is(inner, "ARRAY"), inner).otherwise(root)
    whole = whole.withColumn("v", F.when(_is(F.col("v"), "OBJECT"), root).otherwise(F.col("v")))
    return whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", F.when(_is(F.col("v"), "ARRAY"), F.col("pos")).alias("pos"), F.when(_is(F.col("v"), "OBJECT"), F.col("key")).alias("key"), "value")


def _own_id() -> Column:
    return F.try_variant_get("value", "$.id", "string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, record as variant) of a JSON list, a list under a known key, or an object of objects whose keys are ids.

    Any other layout is an error that names the file. Records of a list without an id are numbered from 1 in their file.
    """
    d = _entries(spark, path, WRAPPERS)
    odd = d.filter(F.col("value").isNull() | F.col("pos").isNull() & (F.col("key").isNull() | ~_is(F.col("value"), "OBJECT"))).select("file").limit(1).collect()
    if odd and not _empty(odd[0]["file"], spark):
        raise ValueError(f"{odd[0]['file']}: neither a list of records nor an object of them")
    d = d.filter(F.col("value").isNotNull())
    return d.select(F.coalesce(_own_id(), F.col("key"), (F.col("pos") + 1).cast("string")).alias("id"), F.col("value").alias("record"))


def _empty(path: str, spark: SparkSession) -> bool:
    """Whether a document is an empty list or object."""
    return spark.read.text(path, wholetext=True).filter(F.regexp_replace("value", r"\s+", "").isin("[]", "{}")).limit(1).count() > 0


def _present(record: Column, names: tuple[str, ...]) -> Column:
    """The value of the first of the fields that is there, even if it is null; as text, which for a list is its JSON."""
    out = F.lit(None).cast("string")
    for f in reversed(names):
        own = F.try_variant_get(record, f"$.{f}", "variant")
        out = F.when(own.isNotNull(), F.try_variant_get(own, "$", "string")).otherwise(out)
    return out


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(id, answer) of answer files: a list of records, one under a known key, or an object of records or answers by id.

    The first answer field that is there counts; answers are normalised, empty ones left out. What is no record in a list is
    left out; of a repeated id the last entry of the last file counts.
    """
    d = _entries(spark, path, TRUTH_WRAPPERS).filter("value is not null")
    record = _is(F.col("value"), "OBJECT")
    d = d.filter(F.col("key").isNotNull() | record)
    raw = F.when(record, _present(F.col("value"), TRUTH_FIELDS)).otherwise(F.try_variant_get("value", "$", "string"))
    d = d.select(F.coalesce("key", _own_id(), (F.col("pos") + 1).cast("string")).alias("id"), scorer_answer(raw).alias("answer"), F.struct("file", "pos").alias("at")).filter("answer != ''")
    return d.groupBy("id").agg(F.max_by("answer", "at").alias("answer"))


def predictions(records: DataFrame) -> DataFrame:
    """(id, answer) of a prediction file, answers normalised; the same id twice is an error."""
    p = records.select("id", scorer_answer(_present(F.col("record"), ("model_answer", "answer"))).alias("answer"))
    twice = p.groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"id {twice[0]['id']} is predicted {twice[0]['count']} times")
    return p


def pick(columns: list[str], names: tuple[str, ...], given: str | None = None) -> str | None:
    """The column to use: the given one if it is there, else the first known name."""
    if given:
        return given if given in columns else None
    return next((n for n in names if n in columns), None)


def read_predictions(spark: SparkSession, path: str, truth: DataFrame | None = None, columns: tuple[str, ...] = (), **given: str) -> DataFrame:
    """(id, right, columns) of JSON lines whose field names are found out from the first line; ids are line numbers, from 0,
    where there are none. Nothing is read to infer a schema.

    truth: (id, answer) that replaces the file's own gold answers. columns: fields to keep, as strings.
    """
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    first = lines.select(F.json_object_keys("value").alias("k")).first()
    names = list(first["k"] or []) if first else []
    key, gold = pick(names, ID_FIELDS, given.get("id")), pick(names, GOLD_FIELDS, given.get("gold"))
    pred, right = pick(names, PREDICTION_FIELDS, given.get("prediction")), pick(names, CORRECT_FIELDS, given.get("correct"))
    if right is None and (pred is None or gold is None and truth is None):
        raise ValueError(f"{path}: neither a correct field nor gold and prediction among {', '.join(names)}")
    if key is None:
        lines = read_lines(spark, path).filter(strip(F.col("value")) != "").withColumn("id", (F.col("line_no") - 1).cast("string"))
    d = lines.withColumn("v", F.parse_json("value"))
    field = lambda c: F.try_variant_get("v", f'$["{c}"]', "string") if c else F.lit(None).cast("string")
    d = d.select(field(key).alias("id") if key else F.col("id"), field(gold).alias("_gold"), field(pred).alias("_pred"), field(right).alias("_right"), F.schema_of_variant(F.try_variant_get("v", f'$["{right or ""}"]', "variant")).alias("_kind"), *[field(c).alias(c) for c in columns])
    if truth is not None:
        d = d.join(truth.select("id", F.col("answer").alias("_answer")), "id", "left").withColumn("_gold", F.coalesce("_answer", "_gold"))
    said = F.when(F.col("_kind") == "STRING", F.lower("_right").isin("1", "true", "yes")).otherwise(~F.coalesce(F.col("_right"), F.lit("null")).isin("false", "null", "0", "0.0", "[]", "{}"))
    ok = said if right else (letter_set(F.col("_gold")) == letter_set(F.col("_pred"))) & (F.size(letter_set(F.col("_gold"))) > 0)
    return d.select("id", ok.alias("right"), *columns)


def read_reference_stems(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(stem, source) of question files: records of .json, sheets of .csv, lines of .jsonl with a question or a conversation.

    Another suffix is an error. Lines that cannot be read as a question, and empty stems, are left out.
    """
    out = None
    for path in paths:
        kind = path.rstrip("/").rsplit(".", 1)[-1]
        if kind == "json":
            q = spark.read.schema("question string").json(path, multiLine=True).select("question")
        elif kind == "csv":
            d = spark.read.csv(path, header=True, multiLine=True, escape='"')
            # names that differ in case only get the number of their column
            known = sorted((c for c in d.columns if re.fullmatch(r"[Qq]uestion\d*", c)), key=lambda c: c[0] == "q")
            own = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in known]
            q = d.select((F.coalesce(*own) if own else F.lit(None).cast("string")).alias("question"))
        elif kind == "jsonl":
            j = spark.read.text(path).select(F.from_json("value", f"question string, messages {MESSAGES}").alias("j"), F.array_contains(F.json_object_keys("value"), "question").alias("own"))
            user = F.try_element_at(F.filter("j.messages", lambda m: m["role"] == "user"), F.lit(1))["content"]
            q = j.select(F.when(F.col("own"), F.col("j.question")).otherwise(F.when(parse_user(user)["options"].isNotNull(), parse_user(user)["question"])).alias("question"))
        else:
            raise ValueError(f"{path}: not a .json, .csv or .jsonl file")
        part = q.select(stem_key(F.col("question")).alias("stem"), F.lit(path).alias("source")).filter("stem != ''")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no reference sets")
    return out


def reference_stems(frames: list[tuple[str, DataFrame, str]], strict: bool = True) -> DataFrame:
    """(stem, source) of several (source, data, question column) sets; empty stems are left out."""
    key = stem_key if strict else question_key
    out = None
    for source, df, column in frames:
        part = df.select(key(F.col(column)).alias("stem"), F.lit(source).alias("source")).filter("stem != ''")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no reference sets")
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files; meant for manifests of files that fit in a task."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
