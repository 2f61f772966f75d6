"""Numeric functions as columns: vectors, decay, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-10))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with norms floored at 1e-10."""
    return dot(a, b) / (norm(a) * norm(b))


def decay_factor(age_days: Column, half_life: float = fixed.HALF_LIFE_DAYS) -> Column:
    """2 ** (-age / half-life), at least 0.05; 1 for no age."""
    if half_life <= 0:
        return F.lit(fixed.LEAST_CONFIDENCE)
    return F.when(age_days <= 0, 1.0).otherwise(F.greatest(F.lit(fixed.LEAST_CONFIDENCE), F.pow(F.lit(2.0), -age_days / half_life)))


def age_days(then: Column, now: Column) -> Column:
    """Days between two timestamps, 0 if unknown or in the future."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / 86400e6), F.lit(0.0))


def staleness(days: Column, half_life: float = fixed.CORPUS_HALF_LIFE_DAYS) -> Column:
    return 1 - F.exp(-F.log(F.lit(2.0)) * days / half_life)


def blend(vector: Column, ppr: Column, weight: float = 0.3) -> Column:
    return weight * vector + (1 - weight) * ppr


def relevance(confidence: Column, salience: Column, stale: Column, corroboration: Column) -> Column:
    return 0.3 * confidence + 0.3 * salience + 0.2 * (1 - stale) + 0.2 * F.least(corroboration / 5, F.lit(1.0))


def boosted(confidence: Column, count: Column) -> Column:
    """Confidence of a fact seen ``count`` times: 10 percent more for each repetition, at most 1, four digits."""
    return F.when(count > 1, F.round(F.least(F.lit(1.0), confidence * (1 + 0.1 * (count - 1))), 4)).otherwise(confidence)
