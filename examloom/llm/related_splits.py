"""Problem 4: splits that keep related records together.

Method: frontier breadth-first components. Adjacency lists are hash-partitioned by node; the seeds are the nodes whose
hash is the smallest among their neighbours (at least one a component, so none is missed); all seeds are expanded
together, two levels in a job; edges between differently labelled nodes make a small graph of seed labels, which is merged by
the same steps until no edge is left. Paths to the nearest seed are short whatever the diameter, so a long chain needs a
logarithmic number of rounds. Components get their split in the order of their hash, whatever their size.

Defined cases: units are related if they share a non-null record id, directly or through other units. Null and empty
units relate nothing; such a row follows its record id, and a row without both is alone. Repeated rows change nothing.
Empty tables give empty results.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examloom.llm._common import salted_join
from examloom.session import materialize

#: Resolution of the order of components: 4096 slices, each of 4096 hashes.
SLICES = 4096
#: Shares within this of their targets are met; up to so many splits are put in other orders where they are not.
TOLERANCE, MOST_ORDERED = 0.01, 5


def unit_edges(rows: DataFrame, unit: str, record: str) -> DataFrame:
    """(src, dst) between the smallest unit of each record id and its other units, in both directions."""
    pairs = rows.filter(F.col(record).isNotNull() & F.col(unit).isNotNull() & (F.col(unit) != "")).select(F.col(record).alias("r"), F.col(unit).alias("u")).distinct()
    hubs = pairs.groupBy("r").agg(F.min("u").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    star = salted_join(pairs, hubs, ["r"], "n", F.col("u")).filter("u != hub").select(F.col("u").alias("src"), F.col("hub").alias("dst")).distinct()
    return star.union(star.select("dst", "src"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of a symmetric edge list; nodes of a component share a label, one of the nodes.

    A round is two jobs: its adjacency and its labels are written, everything else is derived. Edges inside a label leave,
    so a finished component costs nothing in later rounds. The labels of all rounds are put together at the end, from the
    smallest table to the largest.
    """
    levels: list[DataFrame] = []
    while True:
        adj = materialize(edges.hint("rebalance", "src"), "adjacency")  # by node, but a hub with very many edges is split
        if adj.isEmpty():
            break
        level = materialize(_expand(adj), "labels")
        levels.append(level)
        end = lambda c: level.select(F.col("node").alias(c), F.col("label").alias(c + "_label"))  # noqa: E731,B023
        met = adj.join(end("src"), "src").join(end("dst"), "dst").filter("src_label != dst_label")
        edges = met.select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).distinct()
    if not levels:
        return adj.select(F.col("src").alias("node"), F.col("src").alias("label"))
    labels = levels.pop()
    while levels:
        step = labels.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        labels = levels.pop().join(step, "label", "left").select("node", F.coalesce("_next", "label").alias("label"))
    return labels


def _expand(adj: DataFrame) -> DataFrame:
    """One round: breadth-first search from all seeds at once, two steps deep.

    Seeds are the nodes whose hash is the smallest among their neighbours. A node that no seed reaches in two steps keeps
    its own name and is reached, under the names of this round's labels, in a later one.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    nodes = adj.groupBy("src").agg(F.min(rank("dst")).alias("best")).select(F.col("src").alias("node"), (rank("src") < F.col("best")).alias("seed"))
    first = nodes.filter("seed").select(F.col("node").alias("src"), F.col("node").alias("label"))
    near = first.join(adj, "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
    # no two seeds are neighbours, so what is near one is no seed
    far = near.select(F.col("node").alias("src"), "label").join(adj, "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label2"))
    known = nodes.join(near, "node", "left").join(far, "node", "left")
    return known.select("node", F.when(F.col("seed"), F.col("node")).otherwise(F.coalesce("label", "label2", "node")).alias("label"))


def related_units(rows: DataFrame, unit: str = "unit", record: str = "sample_id") -> DataFrame:
    """(unit, smallest) of every unit that is related to another one."""
    labels = components(unit_edges(rows, unit, record))
    small = labels.groupBy("label").agg(F.min("node").alias("smallest"), F.count("*").alias("n"))
    return salted_join(labels, small, ["label"], "n", F.col("node")).select(F.col("node").alias("unit"), "smallest")


def group_keys(rows: DataFrame, unit: str = "unit", record: str = "sample_id") -> DataFrame:
    """rows with ``group_key``, equal for all rows that must stay together."""
    related = materialize(related_units(rows, unit, record), "related")
    valid = F.col(unit).isNotNull() & (F.col(unit) != "")
    own = rows.withColumn("_u", F.when(valid, F.col(unit)))
    # rows without a unit follow the smallest unit that has their record id
    lost = own.filter(F.col("_u").isNull() & F.col(record).isNotNull()).select(F.col(record).alias("_r")).distinct()
    homes = own.filter(F.col("_u").isNotNull() & F.col(record).isNotNull()).select(F.col(record).alias("_r"), "_u").join(lost, "_r", "left_semi")
    homes = homes.groupBy("_r").agg(F.min("_u").alias("_home"))
    orphans = own.filter(F.col("_u").isNull()).withColumn("_r", F.col(record)).join(homes, "_r", "left").withColumn("_u", F.col("_home")).drop("_r", "_home")
    placed = own.filter(F.col("_u").isNotNull()).unionByName(orphans)
    # related units are few; only rows of such a unit get another key. A hot unit is split by Spark at run time.
    named = placed.join(related.select(F.col("unit").alias("_u"), F.col("smallest").alias("_s")), "_u", "left")
    key = F.coalesce(F.concat(F.lit("u:"), F.coalesce("_s", "_u")), F.concat(F.lit("r:"), F.col(record)))
    return named.withColumn("group_key", key).drop("_u", "_s")


def split_keys(rows: DataFrame, unit: str = "unit", record: str = "sample_id", row: str = "row_id") -> DataFrame:
    """(_row, group_key, _h): the key of every row and the place of its component in the order of hashes, 24 bits."""
    keyed = group_keys(rows, unit, record).select(F.col(row).alias("_row"), F.coalesce("group_key", F.concat(F.lit("x:"), F.col(row).cast("string"))).alias("group_key"))
    return keyed.withColumn("_h", F.shiftrightunsigned(F.xxhash64("group_key"), 40).cast("int"))


def plan_cuts(keyed: DataFrame, targets: DataFrame) -> list[tuple[str, int]]:
    """[(split, hash below which it ends)] of consecutive stretches of the order of hashes, shares as in targets.

    Splits come in the order of their shares, the largest first. Where a component of very many rows lies across a cut of
    the smaller splits, another order of the splits is taken that keeps it inside one stretch: the first one whose shares are all
    within TOLERANCE, or else the one nearest to the targets. Store the cuts and pass them in again to keep every component in its
    split while the table grows.
    """
    plan = [(r[0], max(0.0, float(r[1] or 0))) for r in targets.select("split", "target_share").orderBy(F.col("target_share").desc(), "split").collect()]
    whole = sum(s for _, s in plan) or 1.0
    coarse = dict(keyed.groupBy(F.shiftright("_h", 12).alias("b")).count().collect())  # at most 4096 slices
    total = sum(coarse.values())
    orders = list(permutations(plan)) if len(plan) <= MOST_ORDERED else [tuple(plan)]
    fine: dict[int, list[int]] = {}
    wanted = {sum(s for _, s in o[: i + 1]) / whole * total for o in orders for i in range(len(o) - 1)}
    ends = {w: _slice_of(coarse, w) for w in wanted}
    inside = sorted({b for b, _ in ends.values() if b < SLICES})
    if inside:
        for r in keyed.filter(F.shiftright("_h", 12).isin(inside)).groupBy("_h").count().collect():  # at most 4096 a slice
            fine.setdefault(r["_h"] >> 12, [0] * SLICES)[r["_h"] & (SLICES - 1)] = r["count"]
    best = None
    for o in orders:
        cuts, seen, off = [], 0, 0.0
        for i, (name, share) in enumerate(o):
            upto, rows_upto = (SLICES * SLICES, total) if i == len(o) - 1 else _cut(*ends[sum(s for _, s in o[: i + 1]) / whole * total], fine, sum(s for _, s in o[: i + 1]) / whole * total)
            off = max(off, abs(rows_upto - seen - share / whole * total))
            cuts.append((name, upto))
            seen = rows_upto
        if off <= TOLERANCE * total:
            return cuts
        if best is None or off < best[0]:
            best = (off, cuts)
    return best[1] if best else []


def _slice_of(coarse: dict[int, int], want: float) -> tuple[int, int]:
    """(slice in which the cut lies, rows before it)."""
    seen = 0
    for b in range(SLICES):
        k = coarse.get(b, 0)
        if seen + k > want:
            return b, seen
        seen += k
    return SLICES, seen


def _cut(b: int, seen: int, fine: dict[int, list[int]], want: float) -> tuple[int, int]:
    """(hash below which about ``want`` rows lie, their number); a component goes to the side that is nearer."""
    for i, k in enumerate(fine.get(b, [])):
        if seen + k > want:
            return (b * SLICES + i, seen) if want - seen < seen + k - want else (b * SLICES + i + 1, seen + k)
        seen += k
    return b * SLICES, seen


def split_related(rows: DataFrame, targets: DataFrame, unit: str = "unit", record: str = "sample_id", row: str = "row_id", cuts: list[tuple[str, int]] | None = None) -> DataFrame:
    """(row, group_key, split): shares of rows as in targets (split, target_share), related rows never separated.

    Every component, whatever its size, gets its split by the place of its hash among the cuts, so rows need no join to
    learn it. How far a component of many rows moves a share from its target is seen in split_shares.
    """
    keyed = materialize(split_keys(rows, unit, record, row), "keyed")
    cuts = plan_cuts(keyed, targets) if cuts is None else cuts
    split = F.lit(cuts[-1][0]) if cuts else F.lit(None).cast("string")
    for s, c in reversed(cuts[:-1]):
        split = F.when(F.col("_h") < c, F.lit(s)).otherwise(split)
    return keyed.select(F.col("_row").alias(row), "group_key", split.alias("split"))


def split_shares(splits: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, n_rows, n_groups, largest_group, target_share, actual_share, deviation) of every split of the targets."""
    groups = splits.groupBy("split", "group_key").agg(F.count("*").alias("n"))
    g = groups.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.max("n").alias("largest_group"))
    g = targets.select("split", F.coalesce("target_share", F.lit(0.0)).alias("target_share")).join(g, "split", "left").fillna(0, ["n_rows", "n_groups", "largest_group"])
    g = g.withColumn("actual_share", F.col("n_rows") / F.nullif(F.sum("n_rows").over(Window.partitionBy()), F.lit(0)))
    return g.withColumn("deviation", F.col("actual_share") - F.col("target_share"))
