"""Problem 8: sources mixed to target shares of all tokens.

Method: tokens are summed by source, giving each source a repetition rate; every text is emitted floor(rate) times plus
one more with the probability of the fraction, drawn from a hash of seed and text.

Defined cases: the size of the mixture is the number of tokens of all documents, whatever their source. A text that
several documents share is used as one text (its smallest id), so that no text is used more often than ``max_repeats``;
if several mixed sources hold it, a hash gives it to one of them. Rates are capped at ``max_repeats``; what a capped source
lacks is reported, not given to others: ``cannot_fill`` if all its documents used as often as allowed are too few,
``short_of_texts`` if its different texts are, ``deficit`` in tokens. Null, empty and blank texts without tokens are never emitted, documents of null or
unlisted sources neither. Null shares and caps count as 0. Repeated rows of a document count once for the emission, but
as documents in the sums. Empty tables give an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.llm._common import unit_hash
from examloom.llm.bpe import count_tokens
from examloom.session import materialize

BROADCAST_ROWS = 20_000


def mix_sources(
    docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source",
    share: str = "target_share", repeats: str = "max_repeats", seed: int = 11, vocabulary: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: doc, source, tokens, copies of every text that is used. report: a row of targets.

    Only (text hash, id, tokens) is shuffled, never a text. Sums by source combine on the map side, so a source with a
    third of all documents is no hot task; the rates come back as a broadcast of the target rows.
    """
    t = targets.select(F.col(source).alias("source"), F.coalesce(F.col(share), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col(repeats), F.lit(0)), F.lit(0)).cast("long").alias("cap"))
    t = materialize(t, "mix_targets")
    hint = F.broadcast if t.count() <= BROADCAST_ROWS else (lambda d: d)

    own = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"), F.sha2(F.col(text), 256).alias("same"))
    sized = materialize(count_tokens(own, vocabulary=vocabulary), "sized")
    whole = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    total = whole.first()["total"]

    by_doc = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("n_docs"))
    offered = sized.join(hint(t.filter("cap > 0 and share > 0").select("source")), "source", "left_semi").filter("n_tokens > 0")
    texts = offered.groupBy("same", "source").agg(F.min("doc").alias("doc"), F.min("n_tokens").alias("n_tokens"))
    # one source has the text: the one of the smallest hash among those that hold it
    pick = F.struct(F.xxhash64(F.lit(seed), "same", "source").alias("h"), "source", "doc", "n_tokens")
    texts = texts.groupBy("same").agg(F.min(pick).alias("p")).select("same", "p.source", "p.doc", "p.n_tokens")
    by_text = texts.groupBy("source").agg(F.sum("n_tokens").alias("text_tokens"))

    want = F.col("share") * F.lit(float(total))
    rates = t.join(hint(by_doc), "source", "left").join(hint(by_text), "source", "left").fillna(0, ["source_tokens", "n_docs", "text_tokens"])
    # how often the documents and the different texts of a source must be used to fill its target; null without tokens
    rates = rates.withColumn("want", want).withColumn("doc_rate", F.col("want") / F.nullif("source_tokens", F.lit(0))).withColumn("text_rate", F.col("want") / F.nullif("text_tokens", F.lit(0)))
    rate = F.coalesce(F.least("text_rate", F.col("cap").cast("double")), F.lit(0.0))
    rates = materialize(rates.withColumn("rate", rate), "rates")

    base = F.floor("rate")
    extra = F.when(unit_hash(F.lit(seed), F.lit("copy"), "same") < F.col("rate") - base, 1).otherwise(0)
    used = texts.join(hint(rates.select("source", "rate")), "source").withColumn("copies", (base + extra).cast("int")).filter("copies > 0")
    mixture = used.select(F.col("doc").alias(doc), F.col("source").alias(source), F.col("n_tokens").alias("tokens"), "copies")

    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    report = rates.join(hint(got), "source", "left").fillna(0, ["mixed_tokens", "most_copies"])
    everything = F.sum("mixed_tokens").over(Window.partitionBy())
    report = report.select(
        F.col("source").alias(source), F.col("share").alias(share), F.col("cap").cast("int").alias(repeats), "n_docs", "source_tokens", "text_tokens",
        F.col("want").alias("wanted_tokens"), "doc_rate", "text_rate", "rate", "mixed_tokens", "most_copies",
        (F.col("mixed_tokens") / F.nullif(everything, F.lit(0))).alias("actual_share"),
        F.greatest(F.col("want") - F.col("mixed_tokens"), F.lit(0.0)).alias("deficit"), _short("doc_rate").alias("cannot_fill"), _short("text_rate").alias("short_of_texts"),
    )
    return mixture, report


def _short(rate: str) -> Column:
    """Whether a target asks for more repetitions than are allowed, or for tokens where there are none."""
    return F.when(F.col(rate).isNull(), F.col("want") > 0).otherwise(F.col(rate) > F.col("cap"))


def emit_copies(docs: DataFrame, mixture: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The mixture written out: each used document as many times as it has copies, with its copy number."""
    used = docs.join(mixture.select(doc, "copies"), doc).dropDuplicates([doc])
    return used.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
