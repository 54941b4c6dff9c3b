"""Scores, decays and other arithmetic as Column expressions. Times are compared with an explicit as_of, never with a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
Z = 1.96
HALF_LIFE_DAYS, EDGE_HALF_LIFE_DAYS, LN2 = 30.0, 23.0, 0.693
RRF_K = 60
EMA_NEW = 0.3

SECONDS_A_DAY = 86400.0


def seconds(ts: Column) -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def days_between(as_of: Column, then: Column) -> Column:
    return (seconds(as_of) - seconds(then)) / F.lit(SECONDS_A_DAY)


def wilson_lower(successes: Column, total: Column) -> Column:
    """Lower bound of the Wilson interval at 95 %; null without trials. Successes out of range count as the nearest bound."""
    n = total.cast("double")
    p = F.greatest(F.lit(0.0), F.least(successes.cast("double"), n)) / n
    spread = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    bound = (p + Z * Z / (2 * n) - spread) / (1 + Z * Z / n)
    return F.when(total > 0, F.greatest(F.lit(0.0), bound))


def search_decay(score: Column, last_accessed: Column, access_count: Column, as_of: Column) -> Column:
    """Halves every 30 days since the last access (no access: 30 days), and grows with the log of accesses."""
    days = F.coalesce(days_between(as_of, last_accessed), F.lit(HALF_LIFE_DAYS))
    return score * F.exp(-LN2 / HALF_LIFE_DAYS * days) * (1 + 0.1 * F.log1p(access_count.cast("double")))


def decay_and_boost(score: Column, last_accessed: Column, access_count: Column, feedback_boost: Column, as_of: Column) -> Column:
    return search_decay(score, last_accessed, access_count, as_of) + 0.1 * F.coalesce(feedback_boost.cast("double"), F.lit(0.0))


def edge_relevance(weight: Column, last_used: Column, usage_count: Column, created_at: Column, as_of: Column) -> Column:
    use = F.greatest(F.log1p(usage_count.cast("double")), F.lit(0.1))
    age = F.least(1 + days_between(as_of, created_at) / 30, F.lit(2.0))
    return weight * F.exp(-LN2 / EDGE_HALF_LIFE_DAYS * days_between(as_of, last_used)) * use * age


def rrf(weight: Column | float, rank: Column) -> Column:
    """Share of a result in the fusion; rank counts from 0."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w.cast("double") / (RRF_K + rank + 1)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Between 0 and 1; all 0 where all values are equal."""
    return (value - low) / F.when(high > low, high - low).otherwise(1.0)


def ctr_weight(ctr: Column, best: Column) -> Column:
    """Click-through rates read as weights from 0.3 to 2.0; null where no signal was clicked."""
    return F.when(best > 0, 0.3 + 1.7 * ctr / best)


def ema(new: Column, old: Column) -> Column:
    return EMA_NEW * new + (1 - EMA_NEW) * old


def sm2_easiness(quality: Column, easiness: Column) -> Column:
    """Easiness after a review; kept after a failed one."""
    q = quality.cast("double")
    grown = easiness + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
    return F.when(quality < 3, easiness).otherwise(F.greatest(grown, F.lit(1.3)))


def sm2_repetitions(quality: Column, repetitions: Column) -> Column:
    return F.when(quality < 3, F.lit(0)).otherwise(repetitions + 1).cast("int")


def sm2_interval(quality: Column, easiness: Column, repetitions: Column, interval: Column) -> Column:
    """Days to the next review: 1, 6, then the last interval times the new easiness."""
    grown = F.round(interval.cast("double") * sm2_easiness(quality, easiness)).cast("int")
    return F.when((quality < 3) | (repetitions == 0), F.lit(1)).when(repetitions == 1, F.lit(6)).otherwise(grown).cast("int")


def budget_used(text_chars: Column, limit_tokens: int) -> Column:
    """Whole percent of a token budget, at four characters a token."""
    return F.round(F.ceil(text_chars / 4.0) * 100.0 / limit_tokens).cast("bigint")


def budget_band(percent: Column) -> Column:
    """Fixed bands of use; from high on a summary is due."""
    return F.when(percent < 25, "none").when(percent < 50, "low").when(percent < 75, "medium").when(percent < 90, "high").otherwise("critical")


def savings_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((before - after) * 100.0 / before)).otherwise(0.0)
