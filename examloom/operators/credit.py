"""Per-segment credit: differences of probe probabilities, spread over tokens, and group-relative advantages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examloom.session import materialize


def segment_credit(probes: DataFrame, completion: str, k: str, phi: str) -> DataFrame:
    """phi minus the phi before it; a completion's credits sum to its last phi minus its first."""
    w = Window.partitionBy(completion).orderBy(k)
    return probes.withColumn("credit", F.col(phi) - F.lag(phi).over(w)).filter("credit is not null")


def token_credit(ranges: DataFrame, lengths: DataFrame, completion: str) -> DataFrame:
    """(completion, position, credit) for every token: 0 outside segments, ranges (first, last) clipped to the length.

    A token has at most one segment, so covered positions are generated and joined instead of compared by range.
    """
    every = lengths.filter("length > 0").select(completion, F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("position"))
    known = ranges.join(lengths, completion).withColumn("last", F.least("last", F.col("length") - 1)).filter("first is not null and first >= 0 and first <= last")
    covered = known.select(completion, F.explode(F.sequence("first", "last")).alias("position"), "credit")
    return every.join(covered, [completion, "position"], "left").withColumn("credit", F.coalesce("credit", F.lit(0.0)))


def group_advantage(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Reward less its group's mean; the means are aggregated apart, so a large group is not gathered in one task."""
    mean = df.groupBy(group).agg(F.avg(reward).alias("group_mean"), (F.min(reward) == F.max(reward)).alias("unanimous"))
    return df.join(mean, group).withColumn("advantage", F.col(reward) - F.col("group_mean"))


def letter_probability(letters: DataFrame, probe: str, letter: str, mass: str, gold: str, valid: str) -> DataFrame:
    """Mass of the gold answer's first letter over the mass of all valid letters; 0 without mass or with an invalid gold letter."""
    own, among = F.substring(gold, 1, 1), F.contains(F.col(valid), F.col(letter))
    g = letters.groupBy(probe).agg(F.sum(F.when(among, F.col(mass)).otherwise(0.0)).alias("letter_mass"), F.sum(F.when(among & (F.col(letter) == own), F.col(mass)).otherwise(0.0)).alias("gold_mass"))
    return g.withColumn("phi", F.when(F.col("letter_mass") > 0, F.col("gold_mass") / F.nullif(F.col("letter_mass"), F.lit(0.0))).otherwise(0.0))


def average_ranks(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1, equal values share their mean rank; nulls are the smallest value.

    Equal values are counted first. The counts are partitioned by range, added up inside a partition and shifted by the
    sums of the partitions before it (a row for each group and partition), so no group is sorted in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_k")).repartitionByRange(parts, *groups, value)
    counts = materialize(counts.withColumn("_part", F.spark_partition_id()), "counts")
    sums = counts.groupBy(*groups, "_part").agg(F.sum("_k").alias("_sum"))
    sums = sums.withColumn("_base", F.sum("_sum").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_sum")).drop("_sum")
    inside = F.sum("_k").over(Window.partitionBy(*groups, "_part").orderBy(value))
    same = lambda names: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    ranked = counts.withColumn("_upto", inside).alias("a").join(sums.alias("b"), same([*groups, "_part"])).select("a.*", "b._base")
    ranked = ranked.select(*groups, value, (F.col("_base") + F.col("_upto") - (F.col("_k") - 1) / 2).alias(out))
    return df.alias("a").join(ranked.alias("b"), same([*groups, value])).select("a.*", f"b.{out}")


def region_loss(tokens: DataFrame, example: str, region: str, loss: str, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the mean losses of an example's regions; a region without tokens adds nothing."""
    parts = [F.coalesce(F.avg(F.when(F.col(region) == r, F.col(loss))), F.lit(0.0)) * w for r, w in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return tokens.groupBy(example).agg(total.alias("loss"))


def weighted_vectors(parts: DataFrame, group: str, position: str, weight: str, value: str) -> DataFrame:
    """Weighted sum of vectors given as (group, position, weight, value)."""
    return parts.groupBy(group, position).agg(F.sum(F.col(weight) * F.col(value)).alias(value))
