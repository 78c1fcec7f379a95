"""Column functions for scores: block and chunk quality, priors, thresholds, gates, overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_quality(is_ocr: Column, conf: Column, authority: Column, distractor: Column, language: Column, watermark: Column) -> Column:
    """K1: product of factors, clamped to [0, 1]."""
    q = F.when(is_ocr & conf.isNotNull(), 0.5 + 0.5 * (conf / 100.0)).otherwise(1.0)
    q = q * F.when(authority == "authoritative", 1.2).otherwise(1.0) * F.when(distractor, 0.7).otherwise(1.0)
    q = q * F.when(language.isin("ne", "en"), 1.1).otherwise(1.0) * F.when(watermark, 0.9).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))


def chunk_quality(block: Column, lang_conf: Column) -> Column:
    """K2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.2), block * (0.9 + 0.2 * lang_conf)))


def quality_tier(conf: Column, quality: Column, rebuilt: Column, score: Column) -> Column:
    """K3."""
    return F.when((conf >= 0.8) & (quality >= 0.9) & ~rebuilt, "high").when((conf >= 0.5) & (quality >= 0.6), "medium").when(rebuilt & (score >= 0.3), "recovery").otherwise("low")


def confidence_penalty(conf: Column) -> Column:
    """K5."""
    return F.when(conf.isNull(), 0.0).when(conf < 30, 0.08).when(conf < 50, 0.05).when(conf < 70, 0.02).otherwise(0.0)


def prior(query_lang: Column, tabular: Column, c) -> Column:
    """K4: sum of boosts and penalties of a candidate row for a query."""
    lang = c("language")
    same = (query_lang != "mixed") & (lang == query_lang)
    other = (query_lang != "mixed") & (F.coalesce(lang, F.lit("")) != "mixed") & (F.coalesce(lang, F.lit("")) != query_lang)
    p = F.when(same, 0.15 * F.coalesce(c("language_confidence"), F.lit(1.0))).when(other, -0.03).otherwise(0.0)
    p = p + F.when(c("source_authority") == "authoritative", 0.08).otherwise(0.0)
    tier = c("quality_tier")
    p = p + F.when(tier == "high", 0.06).when(tier == "medium", 0.02).when(tier == "low", -0.02).when(tier == "recovery", -0.04).otherwise(0.0)
    p = p - F.when(c("has_watermark"), 0.05).otherwise(0.0) - confidence_penalty(c("conf_mean"))
    p = p + F.when(tabular & (c("chunk_type") == "table"), 0.04).otherwise(0.0)
    p = p - F.when(c("is_reconstructed") & (c("reconstruction_score") < 0.5), 0.02).otherwise(0.0)
    return p - F.when(c("token_count") < 10, 0.02).when(c("token_count") > 800, 0.01).otherwise(0.0)


def severity(ratio: Column, threshold: Column) -> Column:
    """K27."""
    return F.when(ratio > 0.10, "severe").when(ratio > 2 * threshold, "moderate").otherwise("minor")


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals by their hull; 0 where they don't meet or one is empty."""
    inter = F.least(a1, b1) - F.greatest(a0, b0)
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()  # least and greatest pass over nulls
    return F.when(~known | (inter <= 0) | (a1 <= a0) | (b1 <= b0), 0.0).otherwise(inter / (F.greatest(a1, b1) - F.least(a0, b0)))


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes [x0, y0, x1, y1] by their union; 0 on degenerate input."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when((F.size(a) < 4) | (F.size(b) < 4) | (w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(w * h / union)


def reading_seconds(words: Column) -> Column:
    """K17."""
    return F.greatest(F.lit(1), F.floor(words / 200.0 * 60)).cast("long")


def ocr_bin(conf: Column) -> Column:
    """confidence on a scale of 100 in three bins."""
    return F.when(conf.isNull(), "none").when(conf >= 80, "high").when(conf >= 60, "medium").otherwise("low")
