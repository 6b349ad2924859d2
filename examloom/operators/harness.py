"""Tables around an annotation service: cache, cost, funnel, numbered prompts and parsed scores. Calling it is injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.prompts import render_options
from examloom.functions.segments import segment_texts


def request_hash(messages: Column, max_tokens: int, temperature: float) -> Column:
    """SHA-256 of the request as JSON with sorted keys and a blank after separators, texts unescaped but for JSON's own."""
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    turns = F.transform(messages, lambda m: F.concat(F.lit('{"content": '), quoted(m["content"]), F.lit(', "role": '), quoted(m["role"]), F.lit("}")))
    return F.sha2(F.concat(F.lit(f'{{"max_tokens": {max_tokens}, "messages": ['), F.array_join(turns, ", "), F.lit(f'], "temperature": {temperature}}}')), 256)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests without an answer in the cache."""
    return requests.join(cache.select(key).distinct(), key, "left_anti")


def cached(requests: DataFrame, cache: DataFrame, key: str, order: str) -> DataFrame:
    """Requests with their cached answer, of several the last written."""
    last = cache.groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c not in (key, order)]), order).alias("answer"))
    return requests.join(last, key, "left")


def request_cost(prompt: Column, hit: Column, completion: Column, prices: dict[str, float]) -> Column:
    """Price per million tokens; a cached prompt token has its own price."""
    full = prices.get("input", 0.0)
    miss = F.greatest(F.lit(0), prompt - hit)
    return (miss * full + hit * prices.get("input_cache_hit", full) + completion * prices.get("output", 0.0)) / 1e6


def funnel(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """One row: selected, requested, and how many each reason, tried in order, turned away. One pass."""
    why = F.lit(None).cast("string")
    for name, hit in reversed(reasons):
        why = F.when(hit, F.lit(name)).otherwise(why)
    d = df.select(why.alias("r"))
    return d.agg(F.count("*").alias("selected"), F.count_if(F.col("r").isNull()).alias("requested"), *[F.count_if(F.col("r") == n).alias(n) for n, _ in reasons])


def numbered_segments(explanation: Column, spans: Column) -> Column:
    """Segments as lines [1] ..., [2] ..."""
    texts = segment_texts(explanation, spans)
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.trim(F.regexp_replace(t, r"^\s+|\s+$", "")))), "\n")


def scoring_request(question: Column, options: Column, gold: Column, explanation: Column, spans: Column, template: str) -> Column:
    """A template with {question}, {options}, {gold}, {sentences} and {count} filled in."""
    out = F.lit(template)
    for name, value in (("question", question), ("options", render_options(options)), ("gold", gold), ("sentences", numbered_segments(explanation, spans)), ("count", F.size(spans).cast("string"))):
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def parsed_scores(reply: Column) -> Column:
    """The numbers of the last bracketed list of a reply, null if there is none."""
    last = F.try_element_at(F.regexp_extract_all(reply, F.lit(r"(\[[\d\s,，]*\])"), 1), F.lit(-1))
    numbers = F.transform(F.regexp_extract_all(last, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))
    return F.when(F.size(numbers) > 0, numbers)


def score_filters(scores: Column, spans: Column) -> Column:
    """struct(count_matches, range_ok, drop_reason)."""
    count, inside = F.size(scores) == F.size(spans), F.forall(scores, lambda s: (s >= 1) & (s <= 5))
    why = F.when(scores.isNull(), "unparsed").when(~count, "count_matches").when(~F.coalesce(inside, F.lit(False)), "range_ok")
    return F.struct(count.alias("count_matches"), inside.alias("range_ok"), why.alias("drop_reason"))


def within_budget(requests: DataFrame, order: str, cost: str, limit: float, slices: int = 4096) -> DataFrame:
    """Requests admitted while the cost of those before them is below the limit; ``order`` is a fraction in [0, 1).

    Costs are summed by slice of the order (a table of that many rows). Slices that end below the limit are admitted whole;
    only the rows of the slice in which the limit lies are put in order.
    """
    d = requests.withColumn("_s", F.least(F.floor(F.col(order) * slices), F.lit(slices - 1)).cast("int"))
    sums = d.groupBy("_s").agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("_c"))
    sums = sums.withColumn("_base", F.sum("_c").over(Window.orderBy("_s")) - F.col("_c")).filter(F.col("_base") < limit)
    d = d.join(F.broadcast(sums.select("_s", "_base", (F.col("_base") + F.col("_c") < limit).alias("_whole"))), "_s")
    before = F.sum(cost).over(Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    edge = d.filter("not _whole").withColumn("_b", F.coalesce(before, F.lit(0.0)) + F.col("_base")).filter(F.col("_b") < limit)
    return d.filter("_whole").select(*requests.columns).union(edge.select(*requests.columns))


def complete(requests: DataFrame, provider: Callable[[list[dict]], str], key: str = "request_hash", messages: str = "messages") -> DataFrame:
    """(key, reply, error) from a provider that is called in the workers; a failing call gives an error, not a failed job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies, errors = [], []
            for m in b.column(messages).to_pylist():
                try:
                    replies.append(provider(m))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever the provider raises belongs to its row
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[key, "reply", "error"])

    return requests.select(key, messages).mapInArrow(run, f"{key} string, reply string, error string")


def refuse_if_any(items: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """items, or an error if one of them is an evaluation item."""
    hit = items.join(evaluation.select(key), key, "left_semi").limit(1).collect()
    if hit:
        raise ValueError(f"an evaluation item was selected: {hit[0][key]}")
    return items


def select_items(items: DataFrame, refused: DataFrame, key: str, fraction: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(selected, skipped counts): refused keys leave first, of repeated ones the first by fraction stays, then the limit."""
    marked = items.join(refused.select(key).distinct().withColumn("_no", F.lit(True)), key, "left")
    kept = marked.filter("_no is null").drop("_no")
    first = kept.groupBy(key).agg(F.min(F.struct(fraction, "sample_id")).alias("_f")).select(key, F.col("_f.sample_id").alias("sample_id"))
    unique = kept.join(first, [key, "sample_id"], "left_semi")
    counts = marked.agg(F.count_if(F.col("_no")).alias("refused"), (F.count_if(F.col("_no").isNull()) - F.count_distinct(F.when(F.col("_no").isNull(), F.col(key)))).alias("duplicate"))
    return unique.orderBy(fraction, "sample_id").limit(limit), counts

