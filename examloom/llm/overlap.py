"""Problem 6: evaluation records that also occur, exactly or almost, in the training split.

Method: similarity-hash bit fingerprints. Each distinct record gets min-wise hashes of its pairs of neighbouring characters,
numbered by occurrence: 128 of them give one bit each, which is the fingerprint, and the first 60 give eight bits each, three of
which form a block of 24 bits. Train and evaluation records that agree in one of the 20 blocks and differ in no more than
``radius`` bits of the fingerprint are candidates, whose texts are then compared by edit distance.

The number of blocks is the same at every size. A pair that agrees in a share j of its features agrees in a block with
probability j^3 (0.25 for an edit of 12 % of the characters, scattered, which leaves j = 0.63; 0.00025 for unrelated records
of the test tables), and in none of 20 with probability (1 - j^3)^20, 0.003 for the farthest pairs. Records of a family, which share most
blocks, meet in hot blocks; those are split over many tasks and their pairs leave by the fingerprint, within the join.

Defined cases: question and options are taken together; blanks, letter case, punctuation, the form of characters, the
order and the letters of options and empty options do not count. Two records overlap if the edits that turn one question
into the other, and the options into the best matching options, are at most ``share`` of the longer record's characters.
Rows with a null question or null options take no part, nor do rows of a null or unknown split. A row that is in train
and evaluation under the same id pairs with the other rows, not with itself. Records of nothing visible equal each other.
Equal texts are one class: only classes are compared, so copies cost nothing until the pairs of rows are written out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.llm._common import HOT_KEYS, salted_many
from examloom.llm.lookalike import _Table, fold
from examloom.session import materialize

#: Bits of the fingerprint, blocks, and min-wise hashes of eight bits in a block.
BITS, BLOCKS, LANES = 128, 20, 3
SHARE = 0.12
#: The farthest pairs that overlap, with all edits apart from each other, have this share of features in common.
FARTHEST = (1 - SHARE) ** 2 / (2 - (1 - SHARE) ** 2)
#: Four standard deviations beyond the number of bits in which these pairs differ on average.
RADIUS = round(BITS * (1 - FARTHEST) / 2 + 4 * math.sqrt(BITS * (1 - FARTHEST) / 2 * (1 + FARTHEST) / 2))
#: Records whose features are hashed at once, which bounds the memory of a worker by the texts themselves.
CHUNK_CHARS = 40_000
#: A block row in so many is looked at to find hot blocks, and one seen this often is split. Neither changes the result.
SEEN_OF, SEEN = 32, 40

#: Block rows that one task of the join sorts in memory.
ROWS_A_TASK = 2_000_000


def missed(j: float, blocks: int = BLOCKS) -> float:
    """Share of the pairs with j of their features in common that agree in none of the blocks."""
    return (1 - j**LANES) ** blocks


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(1, 1 << 32, BITS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, BITS, dtype=np.uint32)


_VISIBLE = _Table(lambda c: c if c.isalnum() else "")
_PLAIN = _Table(lambda c: (fold(c) or "").lower().translate(_VISIBLE))
_MARKS = re.compile("[\u0300-\u036f\u20d0-\u20ff\ufe20-\ufe2f]")


def plain(text: str | None) -> str:
    """Letters and digits only, in one form and case."""
    if not text:
        return ""
    t = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    # character by character, unless a mark that stands alone may join the letter that its base looks like
    return (fold(t) or "").lower().translate(_VISIBLE) if _MARKS.search(t) else t.translate(_PLAIN)


def _features(records: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the features of all records, where each record starts), for records that show something.

    A feature is a character and the one before it in its part, or the part's begin; the first such pair, the second one
    and so on of a record differ.
    """
    chars = np.frombuffer("".join("\0" + "\0".join(r) for r in records).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([sum(map(len, r)) + len(r) for r in records])
    owner = np.repeat(np.arange(len(records), dtype=np.uint64), sizes)
    # record, character before, character: 22, 21 and 21 bits, so that one sort of numbers puts equal pairs together
    each = owner << np.uint64(42) | np.concatenate([[np.uint64(0)], chars[:-1] << np.uint64(21)]) | chars
    each = np.sort(each[chars != 0])
    pair, owner = each & np.uint64((1 << 42) - 1), each >> np.uint64(42)
    fresh = np.concatenate([[True], each[1:] != each[:-1]])
    at = np.arange(len(each), dtype=np.uint64)
    nth = at - np.maximum.accumulate(np.where(fresh, at, np.uint64(0)))
    x = (pair ^ nth * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return (x >> np.uint64(32)).astype(np.uint32), starts


def fingerprints(records: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(words of the fingerprints, keys of the blocks) of records that show something."""
    x, starts = _features(records)
    times, plus = _factors()
    least = np.empty((BITS, len(records)), dtype=np.uint32)
    for j in range(BITS):  # a function at a time, over as many features as fit in a processor's cache
        least[j] = np.minimum.reduceat(x * times[j] + plus[j], starts)
    least = np.ascontiguousarray(least.T)
    least *= np.uint32(0x9E3779B1)  # the low bits of a product are poor, its high ones are not
    words = np.packbits((least >> np.uint32(31)).astype(bool), axis=1, bitorder="little").view("<i8")
    lanes = ((least[:, : BLOCKS * LANES] >> np.uint32(23)) & np.uint32(255)).astype(np.int32).reshape(len(records), BLOCKS, LANES)
    keys = np.arange(BLOCKS, dtype=np.int32)
    for i in range(LANES):
        keys = keys << 8 | lanes[:, :, i]
    return words, keys


def distance(a: str, b: str, most: int) -> int:
    """Edit distance by bit-parallel columns, or more than ``most`` as soon as it must be."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    plus, minus, score = full, 0, len(b)
    for done, c in enumerate(a, 1):
        eq = masks.get(c, 0)
        v = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        hp, hm = minus | ~(h | plus) & full, plus & h
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
            # the rest can lower the score by one a character
        if score - (len(a) - done) > most:
            return most + 1
        hp, hm = (hp << 1 | 1) & full, hm << 1 & full
        plus, minus = hm | ~(v | hp) & full, hp & v
    return score


def alike(q1: str, o1: list[str], q2: str, o2: list[str], share: float = SHARE) -> bool:
    """Whether two records differ in at most ``share`` of the longer one's characters, options matched at the least cost."""
    size = max(len(q1) + sum(map(len, o1)), len(q2) + sum(map(len, o2)))
    most = int(share * size)
    left = most - distance(q1, q2, most)
    if left < 0:
        return False
    rest1, rest2 = list(o1), list(o2)
    for x in o1:
        if x in rest2:
            rest1.remove(x)
            rest2.remove(x)
    if abs(len(rest1) - len(rest2)) > left:
        return False
    return _assign(rest1, rest2, left) <= left


def _assign(a: list[str], b: list[str], left: int) -> int:
    """The least total distance of pairing a with b; what has no partner costs its length. Distances count up to left + 1."""
    if not a or not b:
        return sum(map(len, a or b))
    n = max(len(a), len(b))
    cell = lambda i, j: distance(a[i], b[j], left) if i < len(a) and j < len(b) else len(a[i]) if i < len(a) else len(b[j])
    return matched([[cell(i, j) for j in range(n)] for i in range(n)])


def matched(cost: list[list[int]]) -> int:
    """Cost of the cheapest perfect matching of a square matrix: rows join one by one along a cheapest augmenting path."""
    n = len(cost)
    row_of: list[int | None] = [None] * n
    price_row, price_col = [0] * n, [0] * n
    for new in range(n):
        reach, came, done = [math.inf] * n, [-1] * n, [False] * n
        row, at, base = new, -1, 0
        while True:  # Dijkstra over columns with reduced costs
            for j in range(n):
                if not done[j] and (d := base + cost[row][j] - price_row[row] - price_col[j]) < reach[j]:
                    reach[j], came[j] = d, at
            at = min((j for j in range(n) if not done[j]), key=reach.__getitem__)
            base, done[at] = reach[at], True
            if row_of[at] is None:
                break
            row = row_of[at]
        price_row[new] += base
        for j in range(n):
            if done[j] and row_of[j] is not None:
                price_row[row_of[j]] += base - reach[j]
            if done[j]:
                price_col[j] -= base - reach[j]
        while at >= 0:
            row_of[at], at = (row_of[came[at]] if came[at] >= 0 else new), came[at]
    return sum(cost[row_of[j]][j] for j in range(n))


def prepared(rows: DataFrame, key: str, split: str, question: str, options: str) -> DataFrame:
    """(key, train, q, o, h): normalised texts, options in order, and the hash that equal records share."""
    kept = rows.filter(F.col(question).isNotNull() & F.col(options).isNotNull() & F.col(split).isin("train", "val", "test"))
    kind = rows.schema[options].dataType.typeName()
    values = F.map_values(options) if kind == "map" else F.transform(F.col(options), lambda o: o["text"])
    base = kept.select(F.col(key).alias("key"), (F.col(split) == "train").alias("train"), F.col(question).alias("q"), values.alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = [plain(t) for t in b.column("q").to_pylist()]
            o = [sorted(x for x in map(plain, v) if x) for v in b.column("o").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("train"), pa.array(q, pa.string()), pa.array(o, pa.list_(pa.string()))], names=["key", "train", "q", "o"])

    done = base.mapInArrow(run, f"key {rows.schema[key].dataType.simpleString()}, train boolean, q string, o array<string>")
    return done.withColumn("h", F.unhex(F.substring(F.sha2(F.concat_ws("|", F.col("q"), F.array_join("o", "|")), 256), 1, 40)))


def coded(classes: DataFrame) -> DataFrame:
    """(c, train, eval, size, w0, w1, blocks) of every class that has visible text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = [[p for p in (q, *o) if p] for q, o in zip(b.column("q").to_pylist(), b.column("o").to_pylist(), strict=True)]
            chunk: list[int] = []
            size = 0
            for i, r in enumerate(records):
                if r:
                    chunk.append(i)
                    size += sum(map(len, r))
                if chunk and (size > CHUNK_CHARS or i == len(records) - 1):
                    yield _batch(b, chunk, [records[k] for k in chunk])
                    chunk, size = [], 0
            if chunk:
                yield _batch(b, chunk, [records[k] for k in chunk])

    def _batch(b: pa.RecordBatch, at: list[int], records: list[list[str]]) -> pa.RecordBatch:
        words, keys = fingerprints(records)
        own = b.take(pa.array(at, pa.int32()))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BLOCKS), pa.int32()), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([own.column("c"), own.column("train"), own.column("eval"), pa.array([sum(map(len, r)) for r in records], pa.int32()), *[pa.array(np.ascontiguousarray(words[:, j])) for j in range(2)], flat], names=["c", "train", "eval", "size", "w0", "w1", "blocks"])

    return classes.select("c", "train", "eval", "q", "o").mapInArrow(run, f"c {classes.schema['c'].dataType.simpleString()}, train boolean, eval boolean, size int, w0 long, w1 long, blocks array<int>")


def hot_blocks(codes: DataFrame) -> DataFrame:
    """(k) of blocks with very many rows, HOT_KEYS at most, seen in a fixed part of the rows."""
    seen = codes.filter(F.pmod(F.xxhash64("c", F.lit(5)), F.lit(SEEN_OF)) == 0).select(F.explode("blocks").alias("k"))
    return seen.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN).orderBy(F.col("n").desc(), "k").limit(HOT_KEYS).select("k")


def _far(a: str, b: str) -> Column:
    total = F.lit(0)
    for j in range(2):
        total = total + F.bit_count(F.col(f"{a}.w{j}").bitwiseXOR(F.col(f"{b}.w{j}")))
    return total


def overlapping_classes(rows: DataFrame, key: str = "row_id", split: str = "split", question: str = "question", options: str = "options", radius: int = RADIUS, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (key, train, c, first), first being the smallest key of class c; links has (a, b) of train and evaluation classes that overlap, a = b included."""
    base = materialize(prepared(rows, key, split, question, options).withColumn("c", F.monotonically_increasing_id()), "texts")
    # a class is named by the number of its first row in the written table; ids may repeat, these numbers do not
    own = base.groupBy("h").agg(F.min(F.struct("key", "c")).alias("f"), F.max("train").alias("train"), F.max(~F.col("train")).alias("eval"))
    groups = materialize(own.select("h", F.col("f.c").alias("c"), F.col("f.key").alias("first"), "train", "eval"), "groups")
    classes = materialize(base.select("c", "q", "o").join(groups.select("c", "train", "eval"), "c"), "classes")
    codes = materialize(coded(classes), "codes")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), codes.count() * BLOCKS // ROWS_A_TASK)
    side = lambda c: codes.filter(c).select("c", "size", "w0", "w1", F.explode("blocks").alias("k"))
    a, b = salted_many(side("train"), side("eval"), "k", materialize(hot_blocks(codes), "hot"), "c")
    a, b = (d.repartition(parts, "k", "_salt") for d in (a, b))
    # texts whose lengths differ by more than the edits allowed need no comparison
    sized = F.abs(F.col("a.size") - F.col("b.size")) <= share * F.greatest("a.size", "b.size")
    met = a.alias("a").join(b.alias("b"), sized & (F.col("a.k") == F.col("b.k")) & (F.col("a._salt") == F.col("b._salt")) & (F.col("a.c") != F.col("b.c")) & (_far("a", "b") <= radius))
    pairs = materialize(met.select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct(), "candidates")
    text = lambda x: classes.select(F.col("c").alias(x), F.col("q").alias("q" + x), F.col("o").alias("o" + x))
    both = pairs.join(text("a"), "a").join(text("b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = [alike(q1, o1, q2, o2, share) for q1, o1, q2, o2 in zip(*(t.column(c).to_pylist() for c in ("qa", "oa", "qb", "ob")), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = classes.schema["c"].dataType.simpleString()
    linked = both.mapInArrow(verify, f"a {kind}, b {kind}")
    same = classes.filter("train and eval").select(F.col("c").alias("a"), F.col("c").alias("b"))
    members = base.drop("c").join(groups.select("h", "c", "first"), "h").select("key", "train", "c", "first")
    return members, linked.union(same)


def overlap_pairs(rows: DataFrame, key: str = "row_id", **names) -> DataFrame:
    """(train_key, eval_key) of all rows that overlap across the splits."""
    members, links = overlapping_classes(rows, key, **names)
    members = materialize(members.distinct(), "members")
    left = members.filter("train").select(F.col("c").alias("a"), F.col("key").alias("train_key"))
    right = members.filter("not train").select(F.col("c").alias("b"), F.col("key").alias("eval_key"))
    return links.join(left, "a").join(right, "b").select("train_key", "eval_key").filter("train_key != eval_key").distinct()


def overlap_classes(rows: DataFrame, key: str = "row_id", **names) -> DataFrame:
    """(key, train, class, n_links) of every row that takes part: its class of equal texts, and with how many classes of the
    other splits that one overlaps, its own included if it stands in both."""
    members, links = overlapping_classes(rows, key, **names)
    links = materialize(links, "links")
    ends = links.select(F.col("a").alias("c"), F.lit(True).alias("train")).union(links.select(F.col("b").alias("c"), F.lit(False).alias("train")))
    n = ends.groupBy("c", "train").agg(F.count("*").alias("n_links"))
    return members.join(n, ["c", "train"], "left").select(F.col("key").alias(key), "train", F.col("first").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def overlap_report(rows: DataFrame, key: str = "row_id", split: str = "split", source: str = "source", **names) -> DataFrame:
    """By evaluation split and source: rows, rows that overlap with training rows, and pairs. Null sources are a group.

    Pairs are counted from links between classes and the numbers of their rows; no pair of rows is written out.
    """
    members, links = overlapping_classes(rows, key, split=split, **names)
    members, links = materialize(members.distinct(), "members"), materialize(links, "links")
    train = members.filter("train").groupBy(F.col("c").alias("a")).agg(F.count("*").alias("k"))
    n = links.join(train, "a").groupBy(F.col("b").alias("c")).agg(F.sum("k").alias("n"))
    # a row under one id in train and in evaluation is no pair with itself
    twice = members.filter("train").select("key", F.col("c").alias("a")).join(members.filter("not train").select("key", F.col("c").alias("b")), "key")
    own = twice.join(links, ["a", "b"]).groupBy("key", F.col("b").alias("c")).agg(F.count("*").alias("own"))
    per_row = members.filter("not train").join(n, "c").join(own, ["key", "c"], "left").select("key", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).filter("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    mine = rows.filter(F.col(split).isin("val", "test")).select(F.col(key).alias("key"), F.col(split).alias("split"), F.col(source).alias("source"))
    g = mine.join(per_row, "key", "left").groupBy("split", "source")
    return g.agg(F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
