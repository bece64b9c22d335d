"""Costs of assigning text to a unit, as columns and as plain functions of the same numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two cost definitions.
BLANK_COST = 1.5
LOW_SIMILARITY = 0.4


def segment_cost(similarity: Column, coverage: Column, blank: Column, low: float = LOW_SIMILARITY, weight: float = 0.5) -> Column:
    """1 - s, more for too few or too many words and for little similarity; never negative."""
    words = F.when(coverage < 0.7, (0.7 - coverage) * 0.5).when(coverage > 1.3, (coverage - 1.3) * 0.3).otherwise(0.0)
    little = F.when(similarity < low, weight * (low - similarity) / low).otherwise(0.0)
    return F.when(blank, BLANK_COST).otherwise(F.greatest(F.lit(0.0), 1.0 - similarity + words + little))


def segment_cost_of(s: float, coverage: float, blank: bool, low: float = LOW_SIMILARITY, weight: float = 0.5) -> float:
    if blank:
        return BLANK_COST
    cost = 1.0 - s
    cost += (0.7 - coverage) * 0.5 if coverage < 0.7 else (coverage - 1.3) * 0.3 if coverage > 1.3 else 0.0
    return max(0.0, cost + (weight * (low - s) / low if s < low else 0.0))


def blended(similarity: Column, phonetic: Column) -> Column:
    """Some phonetic similarity where the letters agree in part."""
    return F.when(similarity.between(0.4, 0.85), 0.85 * similarity + 0.15 * phonetic).otherwise(similarity)


def span_cost(similarity: Column, coverage: Column, count_ratio: Column, duration: Column, expected: Column, blank: Column) -> Column:
    """The segment cost of a span of words, more for an odd number of words and an odd duration."""
    words = F.when(count_ratio < 0.5, (0.5 - count_ratio) * 0.4).when(count_ratio > 2, (count_ratio - 2) * 0.2).otherwise(0.0)
    odd = F.when((duration > 0) & (expected > 0), 0.15 * F.pow(F.ln(duration / expected) / 0.8, 2)).otherwise(0.0)
    return F.when(blank, BLANK_COST).otherwise(F.greatest(F.lit(0.0), segment_cost(similarity, coverage, F.lit(False)) + words + odd))


def span_cost_of(s: float, phonetic: float, coverage: float, ratio: float, duration: float, expected: float) -> float:
    if 0.4 <= s <= 0.85:
        s = 0.85 * s + 0.15 * phonetic
    cost = segment_cost_of(s, coverage, False)
    cost += (0.5 - ratio) * 0.4 if ratio < 0.5 else (ratio - 2) * 0.2 if ratio > 2 else 0.0
    if duration > 0 and expected > 0:
        cost += 0.15 * (math.log(duration / expected) / 0.8) ** 2
    return max(0.0, cost)
