"""Near-duplicate stems against a reference set: exact Jaccard of character n-grams, found through rare grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.functions.text import ngrams
from examloom.session import materialize

#: Counters of grams that are broadcast, a byte each, and the slices in which they are gathered: bounds whatever the data.
SLOT_BITS, SLICES = 22, 1024
#: The grams are joined in so many passes, so that only a part of them lies in shuffle files at a time.
PASSES = 4
#: Words of 64 bits that say of each stem which grams it may hold, and grams that are ordered at once.
WORDS, CELLS = 3, 1 << 20
_EPS = 1e-6


def near_scores(keys: DataFrame, references: DataFrame, key: str, ref_key: str, threshold: float = 0.5, n: int = 5, min_chars: int = 8) -> DataFrame:
    """(key, ref_key, jaccard) of the best reference of each key with at least the threshold; ties go to the largest key.

    Two sets that are that similar share one of the first size - ceil(threshold x size) + 1 grams of either, in any one
    order of all grams; here the rarest come first. Only these are joined, and a pair is left out where the grams that are
    known to be on one side alone make the threshold impossible: no pair is lost as with hashed bands. Keys shorter than
    min_chars are left to the exact match. Grams are 56-bit numbers until the texts of a candidate pair are compared.
    """
    side = lambda d, c, ref: d.select(F.lit(ref).alias("ref"), F.col(c).alias("s"))
    stems = side(keys, key, False).union(side(references, ref_key, True)).distinct()
    stems = materialize(stems.select(F.monotonically_increasing_id().alias("i"), "ref", "s"), "stems", drop_shuffles=True)
    # only now, since a filter before would be worked out on the normal forms once more than they are
    stems = stems.filter(F.length("s") >= min_chars)
    ranks = stems.sparkSession.sparkContext.broadcast(_ranks(stems, n))
    parts = [materialize(_candidates(stems, ranks, n, threshold, k), "pairs", drop_shuffles=True) for k in range(PASSES)]
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.union(p)
    text = lambda ref, i, s: stems.filter(F.col("ref") == ref).select(F.col("i").alias(i), F.col("s").alias(s))
    full = pairs.distinct().join(text(False, "l", "s"), "l").join(text(True, "r", "r_s"), "r")
    scored = full.select("l", "s", "r_s", _similarity(n)("s", "r_s").alias("j")).filter(F.col("j") >= threshold)
    best = scored.groupBy("l").agg(F.max(F.struct("j", "r_s")).alias("best"), F.first("s").alias("s"))
    return best.select(F.col("s").alias(key), F.col("best.r_s").alias(ref_key), F.col("best.j").alias("jaccard"))


def _similarity(n: int):
    def one(a: str, b: str) -> float:
        x, y = ngrams(a, n), ngrams(b, n)
        return (both := len(x & y)) / (len(x) + len(y) - both)

    return F.pandas_udf(lambda a, b: pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")


def _candidates(stems: DataFrame, ranks, n: int, threshold: float, part: int) -> DataFrame:
    """(l, r): pairs that share one of the grams of this pass and may reach the threshold; a pair may come more than once."""
    schema = "x bigint, i bigint, size int, place int" + "".join(f", w{k} bigint" for k in range(WORDS))

    def side(ref: bool) -> DataFrame:
        d = stems.filter(F.col("ref") == ref).select("i", "s")
        return d.mapInArrow(lambda batches: _postings(batches, ranks.value, n, threshold, part, ref), schema)

    a, b = side(False).alias("a"), side(True).hint("merge").alias("b")
    c = lambda name: F.col(name)
    need = (c("a.size") + c("b.size")) * (threshold / (1 + threshold)) - _EPS
    sized = (c("a.size") >= c("b.size") * threshold - _EPS) & (c("b.size") >= c("a.size") * threshold - _EPS)
    # the first gram that two sets share leaves both room for the overlap that the threshold asks for
    room = F.least(c("a.size") - c("a.place"), c("b.size") - c("b.place")) + 1 >= need

    def rest(p: str, q: str) -> Column:
        """The grams of p that q may hold: each bit that q lacks is a gram of p at least."""
        alone = [F.bit_count(c(f"{p}.w{k}").bitwiseAND(F.bitwise_not(c(f"{q}.w{k}")))) for k in range(WORDS)]
        return c(f"{p}.size") - sum(alone[1:], alone[0])

    return a.join(b, (c("a.x") == c("b.x")) & sized & room & (rest("a", "b") >= need) & (rest("b", "a") >= need)).select(c("a.i").alias("l"), c("b.i").alias("r"))


def _ranks(stems: DataFrame, n: int) -> np.ndarray:
    """A byte for each slot of gram hashes: 0 where one side has no gram of it, else higher the more grams it has.

    Grams that share a slot share its rank, which changes the order of the grams but loses none.
    """
    width = (1 << SLOT_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << SLOT_BITS), dtype=np.uint32)
        for b in batches:
            h, g = _gram_hashes(b.column("s").to_pylist(), n)
            of_ref = np.repeat(np.asarray(b.column("ref").to_pylist(), dtype=bool), g)
            slots = _slot(h).astype(np.int64)
            for k, own in enumerate((slots[~of_ref], slots[of_ref])):
                total[k] += np.bincount(own, minlength=1 << SLOT_BITS).astype(np.uint32)
        for k in range(SLICES):
            own = np.ascontiguousarray(total[:, k * width : (k + 1) * width])
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["slice", "counts"])

    def merge(t: pa.Table) -> pa.Table:
        left, right = sum(np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in t.column("counts").to_pylist()).reshape(2, width)
        rank = np.where((left > 0) & (right > 0), np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(left + right, 1)))), 0)
        return pa.table([t.column("slice").slice(0, 1), pa.array([rank.astype(np.uint8).tobytes()], pa.binary())], names=["slice", "ranks"])

    out = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    counted = stems.select("ref", "s").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(merge, "slice int, ranks binary")
    for r in materialize(counted, "ranks", drop_shuffles=True).collect():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["ranks"], dtype=np.uint8)
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - SLOT_BITS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit numbers of the grams at all places of all texts, their number in each text); a text shorter than n is one gram."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    gap = "\0" * (n - 1)
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(length + n - 1) - length - n + 1
    codes[((starts + length)[:, None] + np.arange(n - 1)).ravel()] = 0
    factors = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    places = max(0, len(codes) - n + 1)
    h = np.zeros(places, dtype=np.uint64)
    for k in range(n):
        h += codes[k : k + places] * factors[k]
    g = np.where(length > 0, np.maximum(length - n + 1, 1), 0)
    at = np.repeat(starts - np.cumsum(g) + g, g) + np.arange(g.sum())
    return _mixed(h[at]), g


def _postings(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, n: int, threshold: float, part: int, ref: bool) -> Iterator[pa.RecordBatch]:
    """(x, i, size, place, words) of the first grams of each text, in order of rank, as far as the other side may have them.

    Of two sets, the smaller one shares a gram among its first size - ceil(2 threshold / (1 + threshold) x size) + 1. So
    the last bit of x keeps the later grams of both sides apart: earlier ones of references are given for either.
    """
    names = ["x", "i", "size", "place", *[f"w{k}" for k in range(WORDS)]]
    for b in batches:
        h, g = _gram_hashes(b.column("s").to_pylist(), n)
        first, i = np.cumsum(g) - g, b.column("i").to_numpy(zero_copy_only=False)
        for rows in _by_length(g):
            at = np.arange(g[rows[-1]])
            there = at < g[rows][:, None]
            own = h[np.where(there, first[rows][:, None] + at, 0)]
            bit = (own >> np.uint64(8) & np.uint64(0xFFFFF)) % np.uint64(64 * WORDS)
            one = np.uint64(1) << (bit & np.uint64(63))
            words = [np.bitwise_or.reduce(np.where(there & (bit >> np.uint64(6) == k), one, np.uint64(0)), axis=1).view(np.int64) for k in range(WORDS)]
            # rank and hash in one number, so that equal grams stand side by side; places without a gram come last
            x = np.where(there, ranks[_slot(own).astype(np.int64)].astype(np.uint64) << np.uint64(56) | own >> np.uint64(8), ~np.uint64(0))
            x.sort(axis=1)
            new = at < g[rows][:, None]
            new[:, 1:] &= x[:, 1:] != x[:, :-1]
            place, size = new.cumsum(axis=1), new.sum(axis=1)
            asked = lambda share: (size - np.ceil(size * share - _EPS) + 1)[:, None]  # noqa: E731, B023
            known = new & (place <= asked(threshold)) & (x >> np.uint64(56) > 0) & ((x >> np.uint64(1)) % np.uint64(PASSES) == part)
            early = place <= asked(2 * threshold / (1 + threshold))
            for late, kept in enumerate((known, known & early) if ref else (known & early, known & ~early)):
                r, c = np.nonzero(kept)
                if len(r):
                    key = (x[r, c] & ~np.uint64(1) | np.uint64(late)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key, i[rows][r], size[r].astype(np.int32), place[r, c].astype(np.int32), *[w[r] for w in words])], names)


def _by_length(g: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the texts that have grams, shorter ones first, in groups of a bounded number of grams with their gaps."""
    order = np.argsort(g, kind="stable")
    at = int(np.searchsorted(g[order], 1))
    while at < len(order):
        to = min(len(order), at + 4096)
        while to - at > 1 and (to - at) * int(g[order[to - 1]]) > CELLS:
            to = at + max(1, CELLS // int(g[order[to - 1]]))
        yield order[at:to]
        at = to
