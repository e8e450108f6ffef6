"""Scoring formulas as column expressions. Each rounds to 4 places, which is part of the semantics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.params import DEFAULT, Params


def rounded(x: Column, places: int = 4) -> Column:
    """Half away from zero on the binary product, as SQL engines in C do; ties then never depend on decimal printing."""
    scale = float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def days_before(ts: Column, now: datetime) -> Column:
    """Fractional days from ts to now, not below 0."""
    return F.greatest((F.lit(now).cast("timestamp").cast("double") - ts.cast("double")) / 86400.0, F.lit(0.0))


def clamp(x: Column, default: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(default))))


def importance_weight(sort_key: Column, importance: Column, p: Params = DEFAULT) -> Column:
    return rounded(sort_key * (1 + (clamp(importance) - 0.5) * p.importance_slope))


def importance_weight_plain(sort_key: Column, importance: Column) -> Column:
    """The documented variant."""
    return rounded(sort_key * (0.5 + clamp(importance)))


def time_decay(sort_key: Column, ts: Column, p: Params = DEFAULT) -> Column:
    """A null ts leaves the key as it is, unrounded."""
    return F.when(ts.isNull(), sort_key).otherwise(rounded(sort_key * (1 - p.decay_depth * F.least(days_before(ts, p.now) / p.decay_days, F.lit(1.0)))))


def time_decay_half_life(sort_key: Column, ts: Column, p: Params = DEFAULT, half_life: float = 180.0) -> Column:
    """The documented variant."""
    return F.when(ts.isNull(), sort_key).otherwise(rounded(sort_key * F.pow(F.lit(0.5), days_before(ts, p.now) / half_life)))


def depth_score(score: Column, depth: Column) -> Column:
    return F.when(score >= 0.99, rounded(1 / (1 + F.greatest(F.lit(0), depth - 1)))).otherwise(score)


def association_score(overlap: Column, hop: Column, importance: Column, ts: Column, p: Params = DEFAULT) -> Column:
    recency = F.when(ts.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.5), 1 - days_before(ts, p.now) / p.decay_days))
    return rounded(0.4 * overlap + 0.25 * F.pow(F.lit(p.assoc_decay), hop - 1) + 0.2 * clamp(importance) + 0.15 * recency)


def activated(overlap: Column, hop: Column, p: Params = DEFAULT) -> Column:
    return ~((overlap < p.assoc_activation) & (hop > 1))


def rank_score(rank: Column) -> Column:
    """1 for the first, 0.2 less for each further rank, 0.1 at least."""
    return F.greatest(F.lit(0.1), 1 - 0.2 * (rank - 1))


def kg_score(sort_key: Column, sim: Column, p: Params = DEFAULT) -> Column:
    return rounded(sort_key * (1 - p.kg_weight) + sim * p.kg_weight)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return rounded(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9))


def overlap_ratio(query: Column, item: Column) -> Column:
    """Share of the query's distinct names (trimmed, lower case, two characters at least) that the item has."""
    norm = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= 2))
    q, i = norm(query), norm(item)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, i)) / F.size(q)).otherwise(0.0)


def dedup_action(state: Column, best: Column, p: Params = DEFAULT) -> Column:
    """Threshold rule on a record's state and its best candidate's similarity (null: no candidate)."""
    return (
        F.when((state == "uncertain") & best.isNull(), "DISCARD")
        .when(state == "uncertain", "INVALIDATE")
        .when(best.isNull(), "CREATE")
        .when(state == "historical", "UPDATE")
        .when(best >= p.dedup_skip, "SKIP")
        .when(best >= p.dedup_update, "UPDATE")
        .otherwise("CREATE")
    )


def dedup_fallback(state: Column, has_candidate: Column) -> Column:
    return F.when((state == "uncertain") & ~has_candidate, "DISCARD").when(state == "uncertain", "INVALIDATE").otherwise("CREATE")


def final_mix(rerank: Column, overlap: Column) -> Column:
    """The documented final score; its floor is 0.55."""
    return rounded(rerank * 0.6 + overlap * 0.4)
