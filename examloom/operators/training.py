"""Tables around a trainer: token masks, padding, dropped examples, loss targets and metrics. The trainer itself is elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized_score(score: Column) -> Column:
    """1..5 as 0..1; anything else is null."""
    return F.when(score.between(1, 5), (score - 1) / 4)


def masked_squared_error(prediction: Column, target: Column, valid: Column) -> Column:
    """Mean squared error over valid positions as an aggregate; 0 where there is none."""
    d = prediction - target
    return F.sum(F.when(valid, d * d).otherwise(0.0)) / F.greatest(F.count_if(valid), F.lit(1))


def answer_mask(tokens: DataFrame, example: str, position: str, marker: str, supervised: str, special: str) -> DataFrame:
    """tokens with ``in_answer``: from the last supervised answer marker up to the first special token after it.

    An example's tokens are bounded by the context length, so they may be gathered by example.
    """
    w = Window.partitionBy(example)
    start = F.max(F.when(F.col(marker) & F.col(supervised), F.col(position))).over(w)
    d = tokens.withColumn("_start", start)
    stop = F.min(F.when(F.col(special) & (F.col(position) > F.col("_start")), F.col(position))).over(w)
    return d.withColumn("in_answer", F.coalesce((F.col(position) >= F.col("_start")) & (F.col(position) < F.coalesce(stop, F.lit(1 << 30))), F.lit(False))).drop("_start")


def padded(df: DataFrame, batch: str, ids: str, fill: int) -> DataFrame:
    """Token arrays padded at the end to the longest of their batch."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_n"))
    d = df.join(longest, batch)
    return d.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(fill), F.col("_n") - F.size(ids)))).drop("_n")


def usable(df: DataFrame, length: Column, limit: int, aligned: Column) -> tuple[DataFrame, DataFrame]:
    """(examples within the limit and aligned, counts of the others by reason)."""
    why = F.when(length > limit, "too_long").when(~aligned, "misaligned")
    return df.filter(why.isNull()), df.select(why.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def token_advantage(tokens: DataFrame, sequence: Column, credit: Column, weight: float, mask: Column) -> DataFrame:
    """Sequence advantage plus weighted segment credit, 0 outside the mask."""
    return tokens.withColumn("advantage", F.when(mask, sequence + weight * credit).otherwise(0.0))


def reward_metrics(df: DataFrame, reward: str, parsed: str, cot: str, right: str) -> DataFrame:
    """Means over completions and the share with a rationale among right and wrong ones, one pass."""
    rate = lambda c: F.avg(c.cast("double"))
    return df.agg(
        rate(F.col(reward)).alias("reward_mean"), rate(F.col(parsed).isNotNull()).alias("parse_rate"), rate(F.col(cot)).alias("cot_rate"),
        rate(F.when(F.col(right), F.col(cot))).alias("cot_when_right"), rate(F.when(~F.col(right), F.col(cot))).alias("cot_when_wrong"),
    )


def credit_metrics(probes: DataFrame, completion: str, k: str, phi: str) -> DataFrame:
    """First and last probability, mean size of a credit, and the share of completions without a segment."""
    ends = probes.groupBy(completion).agg(F.min_by(phi, k).alias("first"), F.max_by(phi, k).alias("last"), F.count("*").alias("n"))
    steps = probes.withColumn("_c", F.abs(F.col(phi) - F.lag(phi).over(Window.partitionBy(completion).orderBy(k)))).agg(F.avg("_c").alias("mean_credit"))
    return ends.agg(F.avg("first").alias("phi_first"), F.avg("last").alias("phi_last"), F.avg((F.col("n") < 2).cast("double")).alias("without_segments"), F.count("*").alias("completions")).join(steps)


def configured(given: dict[str, object], known: type) -> object:
    """A settings dataclass from a dict; unknown keys are an error that names them."""
    names = set(known.__dataclass_fields__)
    drift = sorted(set(given) - names)
    if drift:
        raise ValueError("unknown settings: " + ", ".join(drift))
    return known(**given)
