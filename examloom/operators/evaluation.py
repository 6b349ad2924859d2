"""Votes, paired cells, slices and headroom of scored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.stats import detectable_effect, mcnemar_exact, wilson


def majority_vote(df: DataFrame, groups: list[str], answer: str, order: str) -> DataFrame:
    """The most frequent answer of each group; nulls do not vote, a tie goes to the one seen first, all nulls give null."""
    votes = df.groupBy(*groups, answer).agg(F.count(answer).alias("n"), F.min(order).alias("seen"))
    best = F.min(F.when(F.col(answer).isNotNull(), F.struct((-F.col("n")).alias("n"), "seen", answer)))
    return votes.groupBy(*groups).agg(best[answer].alias("majority"), F.coalesce(-best["n"], F.lit(0)).alias("votes"), F.sum("n").alias("answered"))


def bucket(right: Column, samples: Column) -> Column:
    """How often a question was solved; exactly half counts as hard."""
    return F.when(right == samples, "easy").when(right == 0, "zero").when(right * 2 > samples, "medium").otherwise("hard")


def cells(a: Column, b: Column) -> list[Column]:
    """Both right, only a, only b, both wrong, as aggregates over paired flags."""
    return [F.count_if(a & b).alias("both_right"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("both_wrong")]


def paired(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Accuracies, difference in points, test and detectable effect of two flags, overall or by group."""
    g = (df.groupBy(*by) if by else df.groupBy()).agg(F.count("*").alias("n"), *cells(F.col(a), F.col(b)))
    n = F.nullif(F.col("n"), F.lit(0))
    return g.select(
        *(by or []), "n", "both_right", "only_a", "only_b", "both_wrong", ((F.col("both_right") + F.col("only_a")) / n).alias("accuracy_a"), ((F.col("both_right") + F.col("only_b")) / n).alias("accuracy_b"),
        ((F.col("only_a") - F.col("only_b")) / n * 100).alias("delta"), mcnemar_exact(F.col("only_a"), F.col("only_b")).alias("p_exact"),
        detectable_effect(F.col("n"), (F.col("only_a") + F.col("only_b")) / n).alias("detectable"),
    )


def accuracy_by_slice(df: DataFrame, right: str, slices: list[str]) -> DataFrame:
    """(slice, value, n, right, accuracy, low, high): everything at once and by each slice, in one pass; null values stay out."""
    every = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value"))]
    every += [F.struct(F.lit(s).alias("slice"), F.nullif(F.col(s).cast("string"), F.lit("")).alias("value")) for s in slices]
    g = df.select(right, F.explode(F.array(*every)).alias("s")).filter("s.value is not null").groupBy("s.slice", "s.value")
    g = g.agg(F.count("*").alias("n"), F.count_if(F.col(right)).alias("n_right")).withColumn("w", wilson(F.col("n_right"), F.col("n")))
    return g.select("slice", "value", "n", "n_right", "w.accuracy", "w.low", "w.high")


def group_statistics(df: DataFrame, group: Column, base: str, candidate: str) -> DataFrame:
    """Accuracy of two models by group and the gain in points."""
    g = df.groupBy(group.alias("group")).agg(F.count("*").alias("total"), F.avg(F.col(base).cast("int")).alias("base_accuracy"), F.avg(F.col(candidate).cast("int")).alias("candidate_accuracy"))
    return g.withColumn("gain", (F.col("candidate_accuracy") - F.col("base_accuracy")) * 100).orderBy(F.col("gain").desc(), F.col("total").desc(), "group")


def consistent(greedy: Column, variants: Column) -> Column:
    """Whether all variants, at least one, give the greedy answer; null equals null."""
    return (F.size(variants) > 0) & F.forall(variants, lambda v: v.eqNullSafe(greedy))
