"""Characters and tokens: spans of text as ranges of tokens, and training examples encoded from tokens with offsets.

Tokens come with the place after their last character, so a token is found inside its row; nothing is joined and no
tokenizer is called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from examloom.functions.text import SPACE
from examloom.operators.training import normalized_score


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: a lambda variable is not evaluated anew for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_at(ends: Column, char: Column) -> Column:
    """Index from 0 of the first token that reaches beyond a character, null beyond the text. ends: array, never falling."""
    return F.when((char >= 0) & (char < F.try_element_at(ends, F.lit(-1))), F.size(F.filter(ends, lambda e: e <= char)))


def token_ranges(ends: Column, spans: Column) -> Column:
    """array<struct<first,last>>, both inclusive, of spans (start, end); null for an empty span or one that no token covers."""

    def one(s: Column, ends: Column) -> Column:
        both = F.struct(token_at(ends, s["start"]).alias("first"), token_at(ends, s["end"] - 1).alias("last"))
        return _let(both, lambda b: F.when((s["end"] > s["start"]) & (b["last"] >= b["first"]), b))

    return _let(ends, lambda e: F.transform(spans, lambda s: one(s, e)))


def sentence_ends(content: Column, explanation: Column, sentences: Column) -> Column:
    """array<struct<first,last,score>>: places in content of each sentence's first and last visible character.

    Null if the explanation is not in the content. A sentence of blanks has last before first.
    """
    seen = lambda s: F.length(F.regexp_replace(F.substring(explanation, s["start"] + 1, s["end"] - s["start"]), f"[{SPACE}]+$", ""))
    place = lambda at, s: F.struct((at - 1 + s["start"]).alias("first"), (at - 2 + s["start"] + seen(s)).alias("last"), s["score"].alias("score"))
    return _let(F.instr(content, explanation), lambda at: F.when(at > 0, F.transform(sentences, lambda s: place(at, s))))


def encoded_example(ids: Column, starts: Column, ends: Column, base: Column, content: Column, explanation: Column, sentences: Column, limit: int) -> Column:
    """struct(reason, labels, positions, targets, weights) of a conversation whose assistant turn begins at character ``base``.

    labels are the ids from base on and -100 before; a sentence's score stands, from 0 to 1, at its last token and weighs all
    of its tokens, others weigh 1. reason, if any, is the first of: too_long, not_in_content, empty_segment, misaligned (a
    character without a token), too_fine (two sentences end in one token); everything else is null then.
    """
    def found(places: Column, ends: Column) -> Column:
        return F.transform(places, lambda p: F.struct(token_at(ends, base + p["first"]).alias("first"), token_at(ends, base + p["last"]).alias("last"), p["score"].alias("score"), (p["last"] < p["first"]).alias("empty")))

    def example(found: Column) -> Column:
        stops = F.transform(found, lambda f: f["last"])
        reason = (
            F.when(F.size(ids) > limit, "too_long")
            .when(found.isNull(), "not_in_content")
            .when(F.exists(found, lambda f: f["empty"]), "empty_segment")
            .when(F.exists(found, lambda f: f["first"].isNull() | f["last"].isNull()), "misaligned")
            .when(stops != F.array_sort(F.array_distinct(stops)), "too_fine")
        )
        return _let(F.struct(reason.alias("reason")), lambda r: filled(r["reason"], found, stops))

    def filled(reason: Column, found: Column, stops: Column) -> Column:
        good = reason.isNull()
        # of sentences that share a token the later one's score counts
        weight = lambda i: F.coalesce(F.try_element_at(F.filter(found, lambda f: (f["first"] <= i) & (i <= f["last"])), F.lit(-1))["score"].cast("double"), F.lit(1.0))
        return F.struct(
            reason.alias("reason"), F.when(good, F.zip_with(ids, starts, lambda t, s: F.when(s >= base, t).otherwise(-100))).alias("labels"), F.when(good, stops).alias("positions"),
            F.when(good, F.transform(found, lambda f: normalized_score(f["score"]))).alias("targets"), F.when(good, F.transform(ids, lambda _, i: weight(i))).alias("weights"),
        )

    return _let(ends, lambda e: _let(sentence_ends(content, explanation, sentences), lambda p: _let(found(p, e), example)))


def prompt_and_completion(messages: Column) -> Column:
    """struct(prompt, completion): all turns but the last, and the last one alone."""
    return F.struct(F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0))).alias("prompt"), F.slice(messages, F.lit(-1), F.lit(1)).alias("completion"))
