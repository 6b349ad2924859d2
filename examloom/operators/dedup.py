"""First-wins rules and exclusions by key. All of them combine on the map side, so a key with many copies is no hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first, in one aggregation that combines on the map side; of equal order one row."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = [F.min_by(F.struct(*rest), order).alias("_row")] if rest else []
    g = df.groupBy(key).agg(F.min(order).alias(order), *first)
    return g.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last, at the place where the key was first seen (``first_<order>``)."""
    ends = df.groupBy(key).agg(F.max(order).alias(order), F.min(order).alias(f"first_{order}"))
    return df.join(ends, [key, order])


def first_valid(df: DataFrame, key: str, order: str, reason: str) -> DataFrame:
    """df with ``outcome``: written, duplicate or the row's own reason.

    Only a written row claims its key: an invalid row before it does not, any row after it is a duplicate. Rows with an
    empty key keep their reason.
    """
    claim = df.filter(F.col(reason).isNull() & (F.col(key) != "")).groupBy(key).agg(F.min(order).alias("_first"))
    done = df.join(claim, key, "left")
    outcome = F.when(F.col(order) > F.col("_first"), "duplicate").when(F.col(reason).isNotNull(), F.col(reason)).otherwise("written")
    return done.withColumn("outcome", outcome).drop("_first")


def without(df: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among blocked ones; Spark broadcasts the keys if their measured size allows it."""
    return df.join(blocked.select(key).distinct(), key, "left_anti")


def blocked_by(df: DataFrame, references: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Audit of an exclusion: blocked rows with the number of references and the first few of them.

    Spark limits the window to its first ranks before the shuffle, so a key with many references sends only a few.
    """
    first = references.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("ordinal"))).filter(F.col("_r") <= most)
    first = first.groupBy(key).agg(F.array_sort(F.collect_list("ordinal")).alias("first_references"))
    total = references.groupBy(key).agg(F.count("*").alias("n_references"))
    return df.join(total, key).join(first, key)


def gate(steps: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, null if none does."""
    out = F.lit(None).cast("string")
    for name, hit in reversed(steps):
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out
