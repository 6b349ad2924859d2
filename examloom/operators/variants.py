"""Variants of a training set: what part of the units, how many permuted copies, cleaned or not, with or without type hints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.functions import answers, prompts, text
from examloom.functions.text import stable_fraction
from examloom.operators import audit, sampling
from examloom.operators.dedup import first_seen


@dataclass(frozen=True)
class Variant:
    """name:scale:copies:clean:hint"""

    name: str
    scale: float
    copies: int
    clean: bool
    hint: bool


def parse_variant(spec: str) -> Variant:
    """A variant from its text; clean and hint are 1 or anything else. A wrong number of parts is an error."""
    parts = spec.split(":")
    if len(parts) != 5:
        raise ValueError(f"{spec}: not name:scale:copies:clean:hint")
    name, scale, copies, clean, hint = parts
    return Variant(name, float(scale), int(copies), clean == "1", hint == "1")


def chosen_units(rows: DataFrame, scale: float, source: str = "cmb_train", seed: int = 42) -> DataFrame:
    """(unit) of one source: its first share by exam type and question type, as of each unit's first row."""
    own = rows.filter((F.col("source") == source) & (F.col("unit") != ""))
    kind = F.struct("row_id", F.coalesce("exam_type", F.lit("")).alias("e"), F.coalesce("question_type", F.lit("")).alias("t"))
    units = own.groupBy("unit").agg(F.min(kind).alias("k")).select("unit", F.col("k.e").alias("exam_type"), F.col("k.t").alias("question_type"))
    return sampling.nested_subset(units, ["exam_type", "question_type"], "unit", scale, seed).select("unit")


def build_variant(rows: DataFrame, spec: Variant, outcomes: DataFrame | None = None, source: str = "cmb_train", seed: int = 42) -> DataFrame:
    """The rows of a variant with sample_id, copy and place; other sources are taken whole.

    rows: row_id, source, variant, unit, exam_type, question_type, question, options, gold. outcomes: (row_id, outcome) of a
    label audit, needed by a variant that is cleaned; copies have their original's outcome. Of equal prompts the first
    stays, originals before copies. ``place`` is the fraction that rows are ordered by.
    """
    if spec.clean and outcomes is None:
        raise ValueError(f"{spec.name}: a cleaned variant needs an audit")
    own = rows.filter(F.col("source") == source).join(chosen_units(rows, spec.scale, source, seed), "unit", "left_semi").select(rows.columns)
    if spec.copies == 0:
        own = own.filter("variant != 'shuffled'")
    out = own.union(rows.filter(F.coalesce(F.col("source") != source, F.lit(True)))).withColumn("copy", F.lit(0))
    out = out.filter("question is not null and options is not null")
    if spec.copies > 1:
        copies = audit.shuffle_copies(own.filter("variant = 'original'"), spec.copies, seed, multiple_only=True, copies_last=True).filter("copy > 0")
        out = out.unionByName(copies.withColumn("gold", F.col("answer")).withColumn("variant", F.lit("shuffled")).select(out.columns))
    if spec.clean:
        out = out.join(outcomes.filter("outcome != 'kept'"), "row_id", "left_anti")
    hint = answers.type_hint(F.col("question_type"), F.col("gold")) if spec.hint else None
    out = out.withColumn("sample_id", text.sample_id(prompts.prompt_messages(F.col("question"), F.col("options"), "direct", hint)))
    out = first_seen(out.withColumn("_order", F.struct(F.signum("copy").alias("made"), "row_id", "copy")), "sample_id", "_order").drop("_order")
    return out.withColumn("place", stable_fraction(":", F.lit(str(seed)), F.lit("order"), F.col("sample_id")))


def variant_report(built: DataFrame) -> DataFrame:
    """(what, value, n): rows in all, by source, by variant and with several right options, and units of each source; one pass."""
    what = F.array(
        F.struct(F.lit("rows").alias("what"), F.lit("all").alias("value")), F.struct(F.lit("source").alias("what"), F.col("source").alias("value")), F.struct(F.lit("variant").alias("what"), F.col("variant").alias("value")),
        F.struct(F.lit("multiple").alias("what"), F.when(F.length("gold") > 1, "yes").otherwise("no").alias("value")),
    )
    return built.select(F.explode(what).alias("w")).groupBy("w.what", "w.value").agg(F.count("*").alias("n"))


def patched_report(report: dict, split: str, written: int, removed: int, sha256: str | None = None, reason: str = "overlap_with_cmb_test") -> dict:
    """A build report with the counts of one split brought up to date after more of its rows were removed.

    A report without counts of the split comes back as it is. Removals add to those of the same reason.
    """
    counts = report.get("counts", {}).get(split)
    if not isinstance(counts, dict):
        return report
    rejections = dict(counts.get("rejection_counts", {}))
    rejections[reason] = rejections.get(reason, 0) + removed
    new = {**counts, "written": written, "rejection_counts": rejections, "sha256": sha256}
    if isinstance(counts.get("input_rows_read"), int):
        new["rejected"] = counts["input_rows_read"] - written
    return {**report, "counts": {**report["counts"], split: new}}


def with_segment_count(items: DataFrame, explanation: str, least: int = 0, most: int = 0, min_chars: int = 8, level: str = "clause") -> DataFrame:
    """Items whose explanation has between least and most segments (0: no limit); without an explanation they leave."""
    from examloom.functions.segments import segment_spans

    n = F.size(segment_spans(F.col(explanation), min_chars, level))
    d = items.filter(F.col(explanation) != "").withColumn("n_segments", n).filter(F.col("n_segments") >= least)
    return d.filter(F.col("n_segments") <= most) if most else d
