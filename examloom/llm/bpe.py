"""Problem 7: the corpus encoded with a public byte-level BPE vocabulary.

Method: dynamic programming over prefixes. The encoding of every prefix of a piece ends in exactly one token. That token
is among the vocabulary entries that end at this place (given by an automaton over the vocabulary's suffixes), and it is
the one that may follow the last token of the prefix before it: two tokens may stand side by side if encoding their
joined bytes gives these two again. Back-pointers from the end give the ids. The work is linear in the length of a
piece, however long (a run of 100,000 equal characters is one piece).

Defined cases: null and empty texts give an empty list. No special token is ever produced; their strings are ordinary
text. Unpaired surrogates cannot occur in Spark strings. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-tokenizer's pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces that a worker remembers; a bound on memory, not on what is encoded.
CACHE_PIECES = 200_000
CACHE_PIECE_CHARS = 64


_SHIPPED: set[tuple[str, str]] = set()


def default_vocabulary() -> str:
    """Where the driver keeps the vocabulary file; a parameter of every operator. Executors get it from the driver."""
    return os.environ.get("EXAMLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


class Encoder:
    """Encodes with a file of base64 token and rank; ranks are ids and the order of merges."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.ranks = ranks
        self._split = self._parts(ranks)
        self._joined = {parts: rank for rank, parts in self._split.items() if parts[0] >= 0}
        self._find = regex.compile(pattern).findall
        # every entry that ends at a place, longest first; bytes are looked up as latin-1 characters
        self._ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1 and self._split[rank][0] < 0:
                continue  # no sequence of merges makes it; it stands only for a piece equal to it
            self._ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self._ends.make_automaton()
        self._pair: dict[int, bool] = {}
        self._pieces: dict[str, list[int]] = {}

    @staticmethod
    def _parts(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
        """rank: the two tokens whose merge makes it, (-1, -1) for single bytes."""
        out = {}
        for token, rank in ranks.items():
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = rank, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1], rank)
                    if r < best:
                        best, at = r, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out[rank] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether b may directly follow a. No merge across their border may come before the merges that made them.

        The later-made of the two tokens is undone again and again; the pair that then touches at the border would have
        been merged first if the merge exists and is older than all that was undone.
        """
        limit, split, joined = 1 << 62, self._split, self._joined
        while True:
            made = joined.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b and split[a][1] >= 0:
                limit, a = a, split[a][1]
            elif split[b][0] >= 0:
                # on equal age the left one is merged first, so the merge at the border still precedes b's own
                limit, b = b + 1, split[b][0]
            elif split[a][1] >= 0:
                limit, a = a, split[a][1]
            else:
                return True

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pair, fits = self._pair, self.fits
        done = 0
        for end, (rank, length) in self._ends.iter(raw.decode("latin-1")):
            end += 1
            if done == end:
                continue  # its last token is known
            start = end - length
            if start:
                before = last[start]
                key = before << 20 | rank
                ok = pair.get(key)
                if ok is None:
                    if len(pair) > 4_000_000:
                        pair.clear()
                    ok = pair[key] = fits(before, rank)
                if not ok:
                    continue
            last[end], size[end], done = rank, length, end
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known = self._pieces
        for p in self._find(text or ""):
            found = known.get(p)
            if found is None:
                found = self.piece(p)
                if len(p) <= CACHE_PIECE_CHARS:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[p] = found
            ids += found
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)


def ship(spark: SparkSession, path: str) -> None:
    """Send the vocabulary file to the executors, once an application; no executor needs a copy of its own."""
    known = (spark.sparkContext.applicationId, path)
    if known not in _SHIPPED:
        spark.sparkContext.addFile(path)
        _SHIPPED.add(known)


def arrived(path: str) -> str:
    """Where a worker finds a file that was shipped to it."""
    return SparkFiles.get(os.path.basename(path))


def encode_texts(docs: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """docs with the token ids of a text column. One pass without a shuffle; columns besides the text go through untouched."""
    path = vocabulary or default_vocabulary()
    ship(docs.sparkSession, path)
    keep = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(arrived(path))
        for b in batches:
            ids = pa.array([enc.encode(t) for t in b.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], ids], names=[*names, out])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """docs without the text but with its number of tokens (0 for null and empty); ids never leave the worker."""
    path = vocabulary or default_vocabulary()
    ship(docs.sparkSession, path)
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(arrived(path))
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], n], names=[*names, out])

    return docs.select(*names, text).mapInArrow(run, schema)
