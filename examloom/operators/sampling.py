"""Samples by stable fraction: reproducible, nested, and without sorting whole groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.text import stable_fraction

SLICES = 1024


def first_by_fraction(df: DataFrame, groups: list[str], fraction: str, tie: str, wanted: Column) -> DataFrame:
    """Of each group the first rows in the order of (fraction, tie); ``wanted`` may use the group's size ``n``.

    A histogram of the fraction (bounded by groups x SLICES) shows in which slice a group's quota ends. Slices before it
    are taken whole and only that slice is ranked, so a group with a third of all rows is ranked in a thousandth of them.
    """
    d = df.withColumn("_slice", F.floor(F.col(fraction) * SLICES).cast("int"))
    hist = d.groupBy(*groups, "_slice").agg(F.count("*").alias("_k"))
    whole = Window.partitionBy(*groups)
    run = hist.withColumn("n", F.sum("_k").over(whole)).withColumn("_upto", F.sum("_k").over(whole.orderBy("_slice")))
    run = run.withColumn("_rest", wanted.cast("long") - (F.col("_upto") - F.col("_k"))).filter("_rest > 0").select(*groups, "_slice", "_k", "_rest")
    same = [F.col(f"d.{g}").eqNullSafe(F.col(f"h.{g}")) for g in [*groups, "_slice"]]
    kept = d.alias("d").join(run.alias("h"), same).select("d.*", "h._k", "h._rest")
    sure = kept.filter("_rest >= _k")
    rank = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy(fraction, tie))
    edge = kept.filter("_rest < _k").withColumn("_r", rank).filter("_r <= _rest").drop("_r")
    return sure.union(edge).drop("_slice", "_k", "_rest")


def nested_subset(df: DataFrame, strata: list[str], unit: str, scale: float, seed: int = 42, space: str = "ablation_scale") -> DataFrame:
    """The first ceil(n x scale) units of each stratum; a smaller scale gives a subset of a larger one's."""
    if scale >= 1:
        return df
    if scale <= 0:
        return df.limit(0)
    d = df.withColumn("_f", stable_fraction(":", F.lit(str(seed)), F.lit(space), F.col(unit)))
    return first_by_fraction(d, strata, "_f", unit, F.ceil(F.col("n") * scale)).drop("_f")


def holdout(df: DataFrame, key: str, size: int, seed: int = 42, space: str = "cmb_split", separator: str = ":") -> DataFrame:
    """df with ``split``: the ``size`` rows of the smallest fraction are val, the rest train.

    The cut is one (fraction, key) pair found by a top-k of that size; rows are then only compared with it.
    """
    f = stable_fraction(separator, F.lit(str(seed)), F.lit(space), F.col(key).cast("string"))
    d = df.withColumn("_f", f)
    cut = d.select("_f", key).orderBy("_f", key).limit(size).agg(F.max(F.struct("_f", key)).alias("m")).first()["m"] if size > 0 else None
    if cut is None:
        return d.withColumn("split", F.lit("train")).drop("_f")
    inside = (F.col("_f") < F.lit(cut["_f"])) | ((F.col("_f") == F.lit(cut["_f"])) & (F.col(key) <= F.lit(cut[key])))
    return d.withColumn("split", F.when(inside, "val").otherwise("train")).drop("_f")


def pool_sample(df: DataFrame, key: str, size: int, seed: int = 42, space: str = "cot_rl_pool") -> DataFrame:
    """The first ``size`` distinct keys by stable fraction."""
    f = stable_fraction("|", F.lit(str(seed)), F.lit(space), F.col(key))
    return df.dropDuplicates([key]).withColumn("_f", f).orderBy("_f", key).limit(size).drop("_f")
