"""Scores of detections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapsieve.functions.geometry import folded_angle

DETECTOR_WEIGHTS = {"craft": 1.0, "textsnake": 0.8, "dbnet": 0.9}


def enhanced(confidence: Column, kind: Column, text: Column) -> Column:
    by_kind = F.when(kind.isin("block_number", "route_price"), 1.3).when(kind == "complex_number", 1.2).when(kind.isin("pure_number", "single_letter"), 1.1).when(kind == "unknown", 0.8).otherwise(1.0)
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.least(F.coalesce(confidence, F.lit(0.5)) * by_kind * F.when(n.between(1, 6), 1.1).when(n > 10, 0.7).otherwise(1.0), F.lit(1.0))


def multi_scale(confidence: Column, kind: Column, engine: Column) -> Column:
    by_kind = F.when(kind.isin("block_number", "route_price", "price_with_unit"), 1.2).when(kind == "unknown", 0.8).otherwise(1.0)
    return F.least(confidence * by_kind * F.when(engine.contains("paddle"), 1.1).otherwise(1.0) * F.when(engine.contains("+"), 1.15).otherwise(1.0), F.lit(1.0))


def spatial_type(text_is_digit: Column, text_has_letter: Column, kind: Column, road: Column, in_region: Column) -> Column:
    """Type after the rules of position; road: distance to the nearest road, infinite without roads."""
    return (
        F.when((kind == "route_price") & (road <= 50), "route_price_confirmed")
        .when((kind == "block_number") & in_region & (road >= 20), "block_number_confirmed")
        .when((road < 30) & (text_is_digit | text_has_letter), "likely_route_price")
        .when((road >= 30) & in_region & (road > 50) & text_is_digit, "likely_block_number")
        .when(kind.isin("pure_number", "unknown") & in_region, "possible_block_number")
        .when(kind.isin("pure_number", "unknown") & (road < 50), "possible_route_price")
        .otherwise(F.concat(F.lit("spatial_"), kind))
    )


def spatial_confidence(base: Column, kind: Column, road: Column, in_region: Column) -> Column:
    bonus = F.when(kind.contains("confirmed"), 0.3).when(kind.contains("likely"), 0.2).when(kind.contains("possible"), 0.1).otherwise(0.0)
    near = F.greatest(F.lit(0.0), 1 - road / 100) * 0.1
    block = F.when(in_region, 0.15).otherwise(0.0) + F.when(road > 30, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.coalesce(base, F.lit(0.5)) + (bonus + F.when(kind.contains("route_price"), near).when(kind.contains("block_number"), block).otherwise(0.0)))


def relationship(distance: Column, angle: Column, w: Column, h: Column, radius: Column, max_distance: float = 100.0, angle_limit: float = 30.0) -> Column:
    """Confidence that a text belongs to a circle; null for circles without size."""
    fold = folded_angle(angle)
    ratio = F.least(w, h) / F.nullif(radius * 2, F.lit(0))
    by_angle = F.when(fold <= angle_limit, 1.0 - fold / angle_limit * 0.3).otherwise(1.0)
    return F.greatest(F.lit(0.0), 1.0 - distance / max_distance) * 0.5 + by_angle * 0.3 + F.when(ratio.isNull(), None).when(ratio.between(0.3, 2.0), 1.0).otherwise(0.7) * 0.2


def relationship_type(distance: Column) -> Column:
    return F.when(distance <= 30, "adjacent").when(distance <= 60, "nearby").otherwise("distant")


def comprehensive(confidence, spatial, kind, merged, fixed, valid) -> Column:
    quality = 0.5 + F.when(merged, 0.2).otherwise(0.0) + F.when(fixed, 0.1).otherwise(0.0) + F.when(F.coalesce(valid, F.lit(True)), 0.2).otherwise(0.0)
    by_kind = F.when(kind.isin("block_number", "route_price"), 0.8).otherwise(0.3)
    return F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5)) * 0.4 + F.coalesce(spatial, F.lit(0.5)) * 0.3 + by_kind * 0.2 + F.least(quality, F.lit(1.0)) * 0.1)


def choice(confidence, spatial, merged, corrected, valid) -> Column:
    """Score by which one of repeated texts is chosen."""
    return confidence * 100 + F.coalesce(spatial, F.lit(0.0)) * 50 + F.when(merged, 30).otherwise(0) + F.when(corrected, 20).otherwise(0) + F.when(valid, 15).otherwise(0)


def weighted(confidence: Column, detector: Column) -> Column:
    by = F.lit(1.0)
    for name, w in DETECTOR_WEIGHTS.items():
        by = F.when(detector == name, w).otherwise(by)
    return confidence * by


def folder_match(prefecture, city, district, wanted: dict[str, str]) -> Column:
    """Hierarchical score: equal 40/35/25, contained 30/25/15, and 5 for each level that begins with what is wanted."""
    out = F.lit(0)
    for column, name, whole, part in ((prefecture, "prefecture", 40, 30), (city, "city", 35, 25), (district, "district", 25, 15)):
        if w := wanted.get(name):
            out = out + F.when(column == w, whole).when(column.contains(w), part).otherwise(0) + F.when(column.startswith(w), 5).otherwise(0)
    return out


def quality_issues(text, confidence, kind, valid, allowed: str = r"^[0-9A-Za-z\-/.,万千円]*$") -> Column:
    """Names of what is wrong with a detection."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(confidence, F.lit(0.0)) < 0.3, "low_confidence"),
            F.when(F.char_length(text) > 15, "text_too_long"),
            F.when(kind == "invalid", "invalid_format"),
            F.when(~F.coalesce(valid, F.lit(True)), "spatial_inconsistency"),
            F.when(~text.rlike(allowed), "invalid_characters"),
        )
    )


def quality_score(issues: Column) -> Column:
    return 1.0 - F.size(issues) * 0.2


def geographic_issues(text, kind, road, in_region, text_is_digit, text_has_digit) -> Column:
    price, block = kind.contains("route_price"), kind.contains("block_number")
    return F.array_compact(
        F.array(
            F.when(price & (road > 50), "route_price_too_far_from_road"),
            F.when(block & ~in_region, "block_number_outside_region"),
            F.when(price & ~text_has_digit, "route_price_no_digits"),
            F.when(~price & block & ~text_is_digit & ~text.contains("-"), "block_number_non_numeric"),
        )
    )
