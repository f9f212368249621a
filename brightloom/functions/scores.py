"""Scoring formulae as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of the engagement score by signal.
ENGAGEMENT = {
    "clicks": 5.0, "impressions": 0.5, "dwell_minutes": 1.0, "viewable_seconds": 0.1, "scroll_90": 2.0, "scroll_75": 1.0, "scroll_50": 0.5,
    "search_clicks": 3.0, "deep_sessions": 1.5, "rage_clicks": -2.0, "quick_bounces": -1.0, "coviews": 0.1, "coclicks": 0.3,
}


def wilson(positive: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; 0 without observations; above 1 when positives exceed observations."""
    p = positive / n
    inner = F.greatest((p * (1 - p) + z * z / (4 * n)) / n, F.lit(0.0))
    return F.when(n == 0, F.lit(0.0)).otherwise((p + z * z / (2 * n) - z * F.sqrt(inner)) / (1 + z * z / n))


def log_popularity(value: Column) -> Column:
    """``ln(v + 1) / ln(100)``."""
    return F.log1p(value) / math.log(100)


def ctr(clicks: Column, impressions: Column, section_average: Column) -> Column:
    """Raw rate from 3 impressions on, half of it and half the section's for 1 or 2, 0 for none."""
    raw = clicks / F.nullif(impressions, F.lit(0))
    return F.when(impressions >= 3, raw).when(impressions > 0, 0.5 * raw + 0.5 * section_average).otherwise(F.lit(0.0))


def min_max(value: Column, *by: Column) -> Column:
    """Value scaled to [0, 1] within ``by``; a constant becomes 0.5. For a global scale join the two bounds instead: a window without keys is one task."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return scale(value, low, high)


def scale(value: Column, low: Column, high: Column) -> Column:
    """Value scaled by given bounds; a constant becomes 0.5."""
    return F.when(high == low, F.lit(0.5)).otherwise((value - low) / (high - low))


def model_boost(score: Column, weight: float = 0.4) -> Column:
    """``1 + weight`` times the score clamped to [0, 1]; null is neutral."""
    return F.coalesce(1 + F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * weight, F.lit(1.0))


def citation_boost(score: Column, citations: Column, most: Column, weight: float) -> Column:
    """Score raised by log-scaled citations, at most 1."""
    return F.least(F.lit(1.0), score + F.log1p(F.coalesce(citations, F.lit(0))) / F.log1p(F.greatest(most, F.lit(1))) * weight)


def composite(ctr_: Column, dwell: Column, viewable: Column, popularity: Column, confidence: Column) -> Column:
    """Weighted engagement; without dwell the other weights grow, though not to a sum of 1."""
    return F.when(dwell.isNull(), 0.425 * ctr_ + 0.265 * popularity + 0.16 * confidence).otherwise(0.30 * ctr_ + 0.25 * dwell + 0.20 * viewable + 0.15 * popularity + 0.10 * confidence)


def tier(duration_ms: Column) -> Column:
    """Engagement tier of a session's duration."""
    return F.when(duration_ms < 10_000, "bounce").when(duration_ms < 30_000, "skim").when(duration_ms < 120_000, "read").otherwise("deep")


def abandonment(dwell_ms: Column, scroll: Column) -> Column:
    """How a search was left: good, bad or unknown."""
    return F.when((dwell_ms > 10_000) & (scroll > 30), "good").when(dwell_ms < 2_000, "bad").otherwise("unknown")


#: Media richness and default engagement by content type.
MEDIA = {"talk": 1.0, "resource": 0.5, "book": 0.4, "paper": 0.4, "package": 0.3, "dataset": 0.3, "community": 0.2, "career": 0.1}
PROXY = {"talk": 0.8, "resource": 0.6, "paper": 0.5, "book": 0.5, "package": 0.4, "dataset": 0.3, "community": 0.2, "career": 0.1}


def lookup(table: dict, key: Column, default: float) -> Column:
    """A literal map's value."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def hero_score(kind: Column, citations: Column, stars: Column, year: Column) -> Column:
    """How well an item can stand for its cluster: media, authority, engagement and recency."""
    cited = F.coalesce(citations, F.lit(0))
    authority = F.when((kind == "paper") & (cited > 0), F.least(F.lit(1.0), F.log1p(cited) / math.log1p(1000))).when(kind == "talk", 0.6).when(kind == "book", 0.5).otherwise(0.3)
    starred = F.coalesce(stars, F.lit(0))
    engagement = F.when(starred > 0, F.least(F.lit(1.0), F.log1p(starred) / math.log1p(10000))).otherwise(lookup(PROXY, kind, 0.3))
    recency = F.exp(-0.15 * F.greatest(F.lit(0), 2024 - F.coalesce(year, F.lit(2020))))
    return 0.20 * lookup(MEDIA, kind, 0.4) + 0.25 * authority + 0.30 * engagement + 0.25 * recency


def relevance(citation_share: Column, difficulty: Column, cosine_to_centroid: Column) -> Column:
    """Relevance in a cluster: citations (0.5 where none), difficulty and centrality."""
    hard = F.when(difficulty == "beginner", 0.2).when(difficulty == "advanced", 0.8).otherwise(0.5)
    return 0.3 * F.coalesce(citation_share, F.lit(0.5)) + 0.2 * hard + 0.5 * (cosine_to_centroid + 1) / 2


def question_bonus(questions: Column, query: str) -> Column:
    """Bonus of the first question that matches the query: 0.3 whole, 0.2 for three words, 0.1 for two."""
    q = query.lower().strip()
    words = [w for w in q.split() if len(w) > 2]

    def one(text: Column) -> Column:
        low = F.lower(text)
        hits = F.lit(0)
        for w in words:
            hits = hits + low.contains(w).cast("int")
        return F.when(low.contains(q) | F.lit(q).contains(low), 0.3).when(hits >= 3, 0.2).when(hits >= 2, 0.1).otherwise(0.0)

    scored = F.transform(questions, one)
    return F.coalesce(F.get(F.filter(scored, lambda s: s > 0), F.lit(0)), F.lit(0.0))
