"""Verifiable rewards of completions as columns over parsed outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from examloom.functions.answers import MODES, characters
from examloom.functions.text import jaccard


@dataclass(frozen=True)
class RewardSettings:
    """Weights and limits; defaults are the published run's (fixed values)."""

    mode: str = "direct"
    answer_weight: float = 0.95
    format_weight: float = 0.05
    warmup_steps: int = 0
    think_cost: float = 0.0
    think_chars: int = 150
    think_most: float = 3.0
    partial_weight: float = 0.5
    partial_steps: int = 100
    overlong_weight: float = 0.2
    max_tokens: int = 32
    cache_tokens: int = 64

    def __post_init__(self) -> None:
        wrong = [k for k, v in vars(self).items() if k != "mode" and v < 0]
        if self.mode not in MODES:
            wrong.append("mode")
        if self.answer_weight == 0:
            wrong.append("answer_weight")
        if self.max_tokens < 1:
            wrong.append("max_tokens")
        if self.mode == "direct" and self.think_cost:
            wrong.append("think_cost")
        if self.mode != "direct" and self.overlong_weight and self.cache_tokens > self.max_tokens:
            wrong.append("cache_tokens")
        if wrong:
            raise ValueError("settings out of range: " + ", ".join(sorted(set(wrong))))


def anneal(step: Column, steps: int) -> Column:
    """1 falling to 0 over so many steps; 1 throughout for none."""
    return F.lit(1.0) if steps <= 0 else F.greatest(F.lit(0.0), 1 - step / steps)


def answer_reward(answer: Column, gold: Column) -> Column:
    return F.when(answer.eqNullSafe(gold), 1.0).otherwise(0.0)


def format_reward(strict: Column) -> Column:
    return F.when(strict, 1.0).otherwise(0.0)


def think_cost(answer: Column, gold: Column, strict: Column, used_cot: Column, chars: Column, s: RewardSettings) -> Column:
    """What a written rationale costs a right answer; longer ones cost more up to a limit."""
    times = F.lit(1.0) if s.think_chars <= 0 else F.least(chars / s.think_chars, F.lit(float(s.think_most)))
    return F.when(answer.eqNullSafe(gold) & strict & used_cot, -s.think_cost * times).otherwise(0.0)


def partial_reward(answer: Column, gold: Column, step: Column, s: RewardSettings) -> Column:
    """Overlap of letters of a multiple choice that is not exactly right, fading with the steps."""
    due = (F.length(gold) >= 2) & answer.isNotNull() & (answer != gold)
    return F.when(due, jaccard(characters(answer), characters(gold)) * anneal(step, s.partial_steps)).otherwise(0.0)


def overlong_penalty(tokens: Column, s: RewardSettings) -> Column:
    """0, then linear to -1 over the last cache_tokens before the limit, -1 beyond; 0 for an unknown length."""
    ramp = F.lit(-1.0) if s.cache_tokens <= 0 else (s.max_tokens - s.cache_tokens - tokens) / F.lit(float(s.cache_tokens))
    return F.when(tokens.isNull() | (tokens <= s.max_tokens - s.cache_tokens), 0.0).when(tokens <= s.max_tokens, ramp).otherwise(-1.0)


def rewards(parsed: Column, gold: Column, step: Column, tokens: Column, s: RewardSettings) -> Column:
    """struct of the single rewards and their weighted sum; a part that the settings leave out is null."""
    parts = {"answer": (answer_reward(parsed["answer"], gold), s.answer_weight), "format": (format_reward(parsed["strict"]), s.format_weight)}
    if s.mode != "direct" and s.think_cost > 0:
        parts["think"] = (think_cost(parsed["answer"], gold, parsed["strict"], parsed["used_cot"], parsed["analysis_chars"], s), s.answer_weight)
    if s.partial_weight > 0:
        parts["partial"] = (partial_reward(parsed["answer"], gold, step, s), s.answer_weight * s.partial_weight)
    if s.mode != "direct" and s.overlong_weight > 0:
        parts["overlong"] = (overlong_penalty(tokens, s), s.overlong_weight)
    total = F.lit(0.0)
    for value, weight in parts.values():
        total = total + value * weight
    names = ("answer", "format", "think", "partial", "overlong")
    return F.struct(*[(parts[n][0] if n in parts else F.lit(None).cast("double")).alias(n) for n in names], total.alias("total"))
