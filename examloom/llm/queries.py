"""Queries of the training-data problems over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.llm import bpe, formatting, lookalike, mixing, overlap, quotas, related_splits, residue, stable_sample
from examloom.llm.oracles import SQL
from examloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_sample(spark, d):
    return quotas.sample_to_quotas(_t(spark, d, "build_ablation_sets"), _t(spark, d, "sample_targets"))[0]


def p1_report(spark, d):
    return quotas.sample_to_quotas(_t(spark, d, "build_ablation_sets"), _t(spark, d, "sample_targets"))[1]


def p1_found(spark, d):
    return p1_report(spark, d).filter("deficit > 0").select("plan_name", "exam_type", "question_type")


def p2_found(spark, d):
    members = formatting.formatting_members(_t(spark, d, "build_ablation_sets"))
    return members.filter("id != first").select(F.col("first").alias("first_row_id"), F.col("id").alias("row_id"))


def p2_records(spark, d):
    return formatting.collapse_formatting(_t(spark, d, "build_ablation_sets")).withColumnRenamed("first", "first_row_id")


def p4_found(spark, d):
    pairs = related_splits.related_units(_t(spark, d, "build_ablation_sets"))
    return pairs.filter("unit != smallest").select(F.col("smallest").alias("unit_a"), F.col("unit").alias("unit_b"))


def p4_splits(spark, d):
    return related_splits.split_related(_t(spark, d, "build_ablation_sets"), _t(spark, d, "split_targets"))


def p4_split_shares(spark, d):
    return related_splits.split_shares(p4_splits(spark, d), _t(spark, d, "split_targets"))


def p5_sample(spark, d):
    s = stable_sample.stable_sample(_t(spark, d, "build_ablation_sets"), rate=0.1)
    return s.select("row_id", "sample_id", "unit", "batch", "bucket", "chosen_from")


def p5_list(spark, d):
    """The list of a sample of one tenth, started before any data and extended by the whole table."""
    return stable_sample.extend_list(_t(spark, d, "build_ablation_sets"), rate=0.1)


def p3_found(spark, d):
    q = lookalike.same_looking_pairs(_t(spark, d, "build_cmb_train_sft"), "row_id", "question").select(F.lit("question").alias("field"), "key_a", "key_b")
    a = lookalike.same_looking_pairs(_t(spark, d, "score_cmb"), "score_id", "answer", "id").select(F.lit("answer").alias("field"), "key_a", "key_b")
    return q.union(a)


def p3_classes(spark, d):
    q = lookalike.same_looking_classes(_t(spark, d, "build_cmb_train_sft"), "row_id", "question").select(F.lit("question").alias("field"), F.col("row_id").alias("key"), "class", "stored", "n_stored")
    a = lookalike.same_looking_classes(_t(spark, d, "score_cmb"), "score_id", "answer", "id").select(F.lit("answer").alias("field"), F.col("score_id").alias("key"), "class", "stored", "n_stored")
    return q.union(a)


def p3_questions(spark, d):
    return lookalike.canonical_text(_t(spark, d, "build_cmb_train_sft"), "row_id", "question").select(F.col("key").alias("row_id"), F.col("canonical").alias("question"))


def p3_answers(spark, d):
    return lookalike.canonical_text(_t(spark, d, "score_cmb"), "score_id", "answer").select(F.col("key").alias("score_id"), F.col("canonical").alias("answer"))


def p6_found(spark, d):
    pairs = overlap.overlap_pairs(_t(spark, d, "build_cmb_train_sft"))
    return pairs.select(F.least("train_key", "eval_key").alias("row_id_a"), F.greatest("train_key", "eval_key").alias("row_id_b"))


def p6_report(spark, d):
    return overlap.overlap_report(_t(spark, d, "build_cmb_train_sft"))


def p6_classes(spark, d):
    return overlap.overlap_classes(_t(spark, d, "build_cmb_train_sft"))


def p7_ids(spark, d):
    return bpe.encode_texts(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_report(spark, d):
    return mixing.mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def p8_found(spark, d):
    return p8_report(spark, d).filter("cannot_fill").select("source")


def p8_mixture(spark, d):
    return mixing.mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p8_copies(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source")
    return mixing.emit_copies(docs, p8_mixture(spark, d)).select("doc_id", "source", "copy")


def p9_kinds(spark, d):
    return residue.residue_documents(_t(spark, d, "documents"))


def p9_found(spark, d):
    return p9_kinds(spark, d).select("doc_id")


_ALL = [
    p1_found, p1_sample, p1_report, p2_found, p2_records, p3_found, p3_classes, p3_questions, p3_answers, p4_found, p4_splits, p4_split_shares,
    p5_sample, p5_list, p6_found, p6_report, p6_classes, p7_ids, p8_found, p8_report, p8_mixture, p8_copies, p9_found, p9_kinds,
]


def _ready(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _ready(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
