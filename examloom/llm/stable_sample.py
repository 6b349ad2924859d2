"""Problem 5: a sample that is the same on every run and only grows when data are added.

Method: nested hash buckets. A key belongs to one of 4096 fine buckets for ever; a fixed permutation orders the buckets;
the sample is a list of buckets in that order to which buckets are only ever appended. The first list depends on nothing
but the rate and the seed. A stored list can be extended when the rows of its buckets are fewer than wanted; the extended
list holds the stored one as it was, so whatever was chosen stays chosen, whichever batch new rows come in.

Defined cases: the key is (record, unit). A null record id is replaced by the row's own id, null and empty units are
values of their own. A row of a null batch is chosen as any other; its ``chosen_from`` is the batch its bucket joined the
list in, or null. Repeated rows are chosen together. An empty table gives an empty sample and extends no list. A stored
list shorter than the first one is filled up to it. Input columns named bucket, place, since or chosen_from are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX = 3
BUCKETS = 16**BUCKET_HEX
LIST = "bucket int, place int, since int"


def bucket_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, BUCKET_HEX), 16, 10).cast("int")


def bucket_order(spark, seed: str) -> DataFrame:
    """(bucket, place) of the fixed permutation: buckets by the hash of their number."""
    b = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    w = Window.orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col("bucket").cast("string"))), "bucket")
    return b.withColumn("place", F.row_number().over(w) - 1)


def first_list(spark, rate: float, seed: str = "perm") -> DataFrame:
    """(bucket, place, since) of the list that a sample starts with: the first buckets of the permutation, ``rate`` of all."""
    return bucket_order(spark, seed).filter(F.col("place") < F.lit(_first_length(rate))).withColumn("since", F.lit(None).cast("int"))


def _first_length(rate: float) -> int:
    return min(BUCKETS, max(0, math.ceil(rate * BUCKETS)))


def _row_key(record: str, unit: str, row: str) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("s"), F.col(record)), F.concat(F.lit("r"), F.col(row).cast("string"))), F.lit("|"), F.coalesce(F.concat(F.lit("u"), F.col(unit)), F.lit("-")))


def extend_list(
    rows: DataFrame, rate: float, stored: DataFrame | None = None, record: str = "sample_id", unit: str = "unit",
    row: str = "row_id", batch: str = "batch", seed: str = "perm",
) -> DataFrame:
    """The stored list (or the first one) with as many further buckets as bring its rows to ``rate`` of all rows.

    New buckets have the newest batch of rows as ``since``. One aggregation by bucket, combined on the map side; what
    follows has 4096 rows. The result is what must be stored and passed in next time.
    """
    spark = rows.sparkSession
    base = first_list(spark, rate, seed)
    if stored is not None:
        base = stored.select("bucket", "place", "since").union(base.join(F.broadcast(stored.select("bucket")), "bucket", "left_anti").select("bucket", "place", "since"))
    held = F.broadcast(base.select("bucket", F.lit(True).alias("_held")))
    n = rows.select(bucket_of(_row_key(record, unit, row)).alias("bucket"), F.col(batch).alias("_batch")).groupBy("bucket").agg(F.count("*").alias("k"), F.max("_batch").alias("_newest"))
    grid = bucket_order(spark, seed).join(F.broadcast(n), "bucket", "left").join(held, "bucket", "left").fillna(0, ["k"])
    whole, held_rows = Window.partitionBy(), F.sum(F.when(F.col("_held"), F.col("k")).otherwise(0))
    grid = grid.withColumn("_total", F.sum("k").over(whole)).withColumn("_have", held_rows.over(whole)).withColumn("since", F.max("_newest").over(whole).cast("int"))
    # the rows of the further buckets before this one, in the order of the permutation
    more = grid.filter("_held is null").withColumn("_before", F.sum("k").over(Window.orderBy("place")) - F.col("k") + F.col("_have"))
    more = more.filter(F.col("_before") < F.col("_total") * F.lit(float(rate))).filter("_total > 0")
    return base.union(more.select("bucket", "place", "since"))


def stable_sample(
    rows: DataFrame, rate: float, record: str = "sample_id", unit: str = "unit", row: str = "row_id", batch: str = "batch",
    seed: str = "perm", stored: DataFrame | None = None,
) -> DataFrame:
    """The chosen rows with bucket, place and ``chosen_from``, the batch from which on they belong to the sample.

    The sample as of batch b is ``chosen_from <= b``. ``stored`` is a list of extend_list; without it the first list is
    taken, which no data can change. Nothing is shuffled: rows are filtered by a broadcast list of at most 4096 buckets.
    """
    chosen = first_list(rows.sparkSession, rate, seed) if stored is None else stored.select("bucket", "place", "since")
    own = rows.drop("bucket", "place", "since", "chosen_from").withColumn("bucket", bucket_of(_row_key(record, unit, row)))
    return own.join(F.broadcast(chosen), "bucket").withColumn("chosen_from", F.greatest(batch, "since")).drop("since")
