"""What several operators need: hashing to [0, 1) and joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are salted, so the broadcast list of hot keys has a fixed size. Any key beyond the list holds
#: less than a thousandth of the rows.
HOT_KEYS = 1000
SALTS = 64


def unit_hash(*cols: Column | str) -> Column:
    """A double in [0, 1) from 53 bits of a 64-bit hash; the same on every run and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def hot_keys(groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The keys with the most rows, HOT_KEYS at most (a top-k, so its size is bounded whatever the data)."""
    return groups.orderBy(F.col(n).desc(), *keys).limit(HOT_KEYS).filter(F.col(n) > 1000).select(*keys)


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, salt_by: Column, how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row a key and the key's number of rows in n.

    The rows of a hot key go to SALTS tasks, its row of groups is repeated for each of them. Keys are never null.
    """
    hot = hot_keys(groups, keys, n).withColumn("_hot", F.lit(True))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = groups.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def salted_many(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, salt_by: str) -> tuple[DataFrame, DataFrame]:
    """left and right with ``_salt``, to be joined on key and _salt where a key may have many rows on both sides.

    hot has the keys to split, HOT_KEYS at most. The left rows of such a key go to SALTS tasks by the hash of salt_by, its right
    rows to each of them, so every pair meets once and no task holds a whole hot key. Keys are never null.
    """
    marked = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    one = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(marked, key, "left").withColumn("_salt", one).drop("_hot"), right.join(marked, key, "left").withColumn("_salt", F.explode(each)).drop("_hot")
