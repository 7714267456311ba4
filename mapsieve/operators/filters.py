"""Row filters of detections, by size, confidence and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapsieve.functions import text as T


def quality(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confident boxes of at least five pixels a side, with text, no more than ten times as long as wide."""
    ratio = F.col("w") / F.col("h")
    return df.filter((F.col("confidence") >= threshold) & (F.col("w") >= 5) & (F.col("h") >= 5) & (F.trim("text") != "") & ratio.between(0.1, 10))


def number_regions(df: DataFrame) -> DataFrame:
    ratio = F.col("w") / F.col("h")
    return df.filter((F.col("confidence") >= 0.3) & (F.col("w") >= 8) & (F.col("h") >= 8) & ratio.between(0.1, 5) & ((F.col("text") == "") | T.is_potential_number(F.col("text"))))


def noise(df: DataFrame, least: float = 0.1) -> DataFrame:
    """Texts of 1 to 20 characters that are not all punctuation, with some confidence."""
    t = F.trim("text")
    return df.filter(F.char_length(t).between(1, 20) & (F.col("confidence") >= least) & ~t.rlike(r"(?U)^[^\w]+$"))


def known_and_scored(df: DataFrame, least: float = 0.2) -> DataFrame:
    return df.filter((F.char_length("text") >= 1) & (F.col("enhanced_score") >= least) & (F.col("classification") != "unknown"))


def passed_quality(df: DataFrame, issues: str = "issues", least: float = 0.3) -> DataFrame:
    from mapsieve.functions.scores import quality_score

    return df.withColumn("quality_score", quality_score(F.col(issues))).filter(F.col("quality_score") >= least)


def circle_bounds(df: DataFrame, page_w: int, page_h: int, least_r: int = 5, most_r: int = 100, least: float = 0.3) -> DataFrame:
    return df.filter(F.col("cx").between(0, page_w - 1) & F.col("cy").between(0, page_h - 1) & F.col("radius").between(least_r, most_r) & (F.col("confidence") >= least))


def region_shape(df: DataFrame, least_area: int = 100, most_area: int = 50_000, least_ratio: float = 0.1, most_ratio: float = 10.0) -> DataFrame:
    area, ratio = F.col("w") * F.col("h"), F.col("w") / F.col("h")
    return df.filter(area.between(least_area, most_area) & ratio.between(least_ratio, most_ratio))


def engine_cutoff(df: DataFrame, cutoffs: dict[str, float], otherwise: float = 0.0) -> DataFrame:
    """Each engine's rows above its own confidence."""
    cut: Column = F.lit(otherwise)
    for name, c in cutoffs.items():
        cut = F.when(F.col("engine") == name, c).otherwise(cut)
    return df.filter(F.col("confidence") >= cut)


def contour_area(df: DataFrame, least: float = 1000, most: float = 50_000) -> DataFrame:
    return df.filter(F.col("area").between(least, most))


def chosen(df: DataFrame, confidence: float, similarity: float) -> DataFrame:
    return df.filter((F.col("confidence") >= confidence) & (F.col("similarity") >= similarity) & (F.col("similarity") > 0.3))


def has_digit(df: DataFrame) -> DataFrame:
    return df.filter(T.has_digit(F.col("text")))


def advanced(df: DataFrame, pattern: str | None = None, confidence: float | None = None, number: bool | None = None, filename: str | None = None) -> DataFrame:
    """The documented combined search: each condition that is given."""
    if pattern is not None:
        df = df.filter(F.col("text").rlike(pattern))
    if confidence is not None:
        df = df.filter(F.col("confidence") >= confidence)
    if number is not None:
        df = df.filter(T.is_digit(F.col("text")) == number)
    return df.filter(F.col("filename").contains(filename)) if filename is not None else df


def number_range(df: DataFrame, low: int, high: int) -> DataFrame:
    return df.filter(F.expr("try_cast(text as bigint)").between(low, high))


def in_window(df: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    return df.filter(F.col("cx").between(x1, x2) & F.col("cy").between(y1, y2))
