"""Label audits and permuted copies of training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.functions import prompts, text
from examloom.functions.answers import strict_answer
from examloom.operators.dedup import first_seen


def with_content(df: DataFrame, options: str = "options", keys: str = "option_keys", gold: str = "gold") -> DataFrame:
    """df with ``content``: the normalised texts of the right options in order, whatever their letters."""
    chosen = F.filter(F.arrays_zip(F.transform(options, lambda o: o["letter"]).alias("l"), F.col(keys).alias("k")), lambda z: F.contains(F.col(gold), z["l"]))
    return df.withColumn("content", F.array_join(F.array_sort(F.transform(chosen, lambda z: z["k"])), "|"))


def label_conflicts(df: DataFrame, unit: str = "unit_hash", content: str = "content") -> DataFrame:
    """Units whose rows disagree on the right content: the majority to keep, or a tie."""
    c = df.groupBy(unit, content).agg(F.count("*").alias("n"))
    top = c.groupBy(unit).agg(F.count("*").alias("variants"), F.max(F.struct("n", content)).alias("hi"), F.min(F.struct((-F.col("n")).alias("n"), F.col(content))).alias("lo"))
    top = top.filter("variants > 1")
    # the most frequent content is unique if the largest and the smallest of them are the same
    tie = F.col("hi")[content] != F.col("lo")[content]
    return top.select(unit, F.when(tie, "tie").otherwise("majority").alias("resolution"), F.when(~tie, F.col("hi")[content]).alias("keep_content"), "variants")


def apply_audit(df: DataFrame, conflicts: DataFrame, unit: str = "unit_hash", content: str = "content", source: str = "cmb_train", structural: DataFrame | None = None) -> DataFrame:
    """df with ``outcome`` in a fixed order: tie, minority label, structural fault, kept; only rows of one source are judged."""
    d = df.join(conflicts.select(unit, "resolution", "keep_content"), unit, "left")
    own = F.col("source") == source
    out = F.when(own & (F.col("resolution") == "tie"), "tie_conflict").when(own & (F.col(content) != F.col("keep_content")), "minority_label")
    if structural is not None:
        d = d.join(structural.select(unit, F.col("reason").alias("_fault")), unit, "left")
        out = out.when(own & F.col("_fault").isin("figure_reference", "truncated_stem"), F.col("_fault"))
    return d.withColumn("outcome", out.otherwise("kept")).drop("resolution", "keep_content", "_fault")


def shuffle_copies(df: DataFrame, copies: int, seed: int = 42, multiple_only: bool = False, copies_last: bool = False) -> DataFrame:
    """Rows (copy 0) and up to ``copies`` permuted copies of each question that may be shuffled; one that may not is kept once.

    Permutations are keyed by the sample id of the original. Answers are remapped to the new letters. Of equal prompts the
    first is kept, in the order of (row_id, copy), so the copies of a row come before the rows after it; with copies_last all
    originals come before all copies. multiple_only: only questions with several right options are copied.
    """
    base = df.filter("question is not null and options is not null").withColumn("valid", F.array_join(F.transform("options", lambda o: o["letter"]), ""))
    base = base.withColumn("answer", strict_answer(F.col("gold"), F.col("valid"))).filter("answer is not null")
    named = lambda d: d.withColumn("sample_id", text.sample_id(prompts.prompt_messages(F.col("question"), F.col("options"), "direct")))
    base = named(base)
    full = ~F.exists("options", lambda o: F.coalesce(o["text"], F.lit("")) == "")
    fit = base.filter(full & prompts.shuffle_safe(F.col("options")) & (F.length("answer") > (1 if multiple_only else 0)))
    made = fit.select("*", F.posexplode(prompts.permutations_by_hash(F.size("options"), copies, F.lit(str(seed)), F.col("sample_id"))).alias("at", "p"))
    made = made.withColumn("copy", F.col("at") + 1).withColumn("answer", prompts.remap_answer(F.col("answer"), F.col("p"))).withColumn("options", prompts.permute_options(F.col("options"), F.col("p"))).drop("at", "p")
    both = base.withColumn("copy", F.lit(0)).unionByName(named(made))
    order = F.struct(F.signum("copy").alias("made"), "row_id", "copy") if copies_last else F.struct("row_id", "copy")
    return first_seen(both.withColumn("_order", order), "sample_id", "_order").drop("_order", "valid")
