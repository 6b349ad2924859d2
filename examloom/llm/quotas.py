"""Problem 1: a sample whose categories have given target proportions.

Method: an acceptance probability for each cell (target over observed, slightly more), independent draws by hash, then
exact correction of every cell's count and a report of the cells whose target cannot be met.

Defined cases: a record is a distinct non-null ``sample_id`` within a cell and stands for its smallest ``row_id``; rows
with a null id or in a cell without a target are never drawn. Cells match exactly, null matches null. Null or negative
shares, minimums and sizes count as 0. Equal hashes are ordered by id. Empty tables give an empty sample and, for each
target row, a report row with 0 available.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examloom.llm._common import unit_hash
from examloom.session import materialize

#: More target rows than this are joined by a shuffle, fewer are broadcast.
BROADCAST_ROWS = 20_000
#: Slices of the accepted and of the rejected hash range of a cell; only the slice with the cut is sorted.
SLICES = 512


def sample_to_quotas(
    rows: DataFrame, targets: DataFrame, cell: tuple[str, ...] = ("exam_type", "question_type"), record: str = "sample_id",
    order: str = "row_id", plan: str = "plan_name", share: str = "target_share", least: str = "min_rows",
    size: str = "sample_rows", seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: plan, cell, record, order. report: a row of targets with quota, available, selected, deficit, shares.

    The quota of a cell is the larger of its minimum and its share of the plan's size, rounded up. The shuffle moves
    (cell number, id, row number) once, combined on the map side, so a cell or id with a third of all rows is no hot
    task. No step sorts a whole cell: a histogram over hash slices (bounded by targets x slices) finds where the count
    is exact, and only that slice is ranked.
    """
    spark = rows.sparkSession
    t = targets.select(
        F.col(plan).alias("plan"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(cell)], F.coalesce(F.col(share), F.lit(0.0)).alias("share"),
        F.greatest(F.ceil(F.coalesce(F.col(share), F.lit(0.0)) * F.coalesce(F.col(size), F.lit(0))), F.coalesce(F.col(least), F.lit(0)), F.lit(0)).cast("long").alias("quota"),
    )
    parts = [f"c{i}" for i in range(len(cell))]
    cell_id = F.xxhash64(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("0")) for c in parts]))
    t = materialize(t.withColumn("cell_id", cell_id), "targets")
    small = t.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda d: d)

    own = rows.filter(F.col(record).isNotNull()).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cell)], F.col(record).alias("record"), F.col(order).alias("ord"))
    known = t.select(*parts, "cell_id").distinct()
    wanted = own.alias("a").join(hint(known.alias("b")), [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in parts]).select("b.cell_id", "record", "ord")
    ids = materialize(wanted.groupBy("cell_id", "record").agg(F.min("ord").alias("ord")), "records")

    n = ids.groupBy("cell_id").agg(F.count("*").alias("n"))
    take = F.least("quota", "n")
    cells = t.join(hint(n), "cell_id").withColumn("take", take).filter("take > 0")
    # six standard deviations more than wanted, so that a cell is short of accepted records about once in a thousand million
    cells = cells.withColumn("p", F.least(F.lit(1.0), (F.col("take") + 6 * F.sqrt("take") + 12) / F.col("n"))).select("plan", "cell_id", "take", "p")
    cells = materialize(cells, "probabilities")

    u, p = F.col("u"), F.col("p")
    slice_no = F.when(u < p, F.floor(u / p * SLICES)).otherwise(SLICES + F.floor((u - p) / F.greatest(1 - p, F.lit(1e-12)) * SLICES)).cast("int")
    draws = ids.join(hint(cells), "cell_id").withColumn("u", unit_hash(F.lit(seed), "plan", "record")).withColumn("slice", slice_no)
    hist = draws.groupBy("plan", "cell_id", "take", "slice").agg(F.count("*").alias("k"))
    run = Window.partitionBy("plan", "cell_id").orderBy("slice")
    cut = hist.withColumn("upto", F.sum("k").over(run)).filter(F.col("upto") - F.col("k") < F.col("take"))
    # slices up to the cut: whole ones need no rank, of the last one "rest" records are taken
    cut = cut.groupBy("plan", "cell_id").agg(F.max("slice").alias("last"), (F.max("take") - F.max(F.col("upto") - F.col("k"))).alias("rest"))
    drawn = draws.join(hint(cut), ["plan", "cell_id"]).filter(F.col("slice") <= F.col("last"))
    whole = drawn.filter(F.col("slice") < F.col("last"))
    rank = F.row_number().over(Window.partitionBy("plan", "cell_id").orderBy("u", "record"))
    edge = drawn.filter(F.col("slice") == F.col("last")).withColumn("r", rank).filter(F.col("r") <= F.col("rest"))
    names = t.select("plan", "cell_id", *parts).distinct()
    picked = whole.select("plan", "cell_id", "record", "ord").union(edge.select("plan", "cell_id", "record", "ord"))
    sample = picked.join(hint(names), ["plan", "cell_id"]).select(F.col("plan").alias(plan), *[F.col(f"c{i}").alias(c) for i, c in enumerate(cell)], F.col("record").alias(record), F.col("ord").alias(order))

    got = picked.groupBy("plan", "cell_id").agg(F.count("*").alias("selected"))
    report = t.join(hint(n), "cell_id", "left").join(hint(got), ["plan", "cell_id"], "left").fillna(0, ["n", "selected"])
    total = F.sum("selected").over(Window.partitionBy("plan"))
    report = report.withColumn("actual_share", F.col("selected") / F.nullif(total, F.lit(0))).select(
        F.col("plan").alias(plan), *[F.col(f"c{i}").alias(c) for i, c in enumerate(cell)], F.col("share").alias(share), "quota",
        F.col("n").alias("available"), "selected", (F.col("quota") - F.col("selected")).alias("deficit"), "actual_share",
    )
    return sample, report
