"""Searches over detections and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapsieve.functions import scores, similarity, text


def by_location(df: DataFrame, prefecture: str = "", city: str = "", district: str = "") -> DataFrame:
    """Rows of a place; empty levels are not asked."""
    for name, value in (("prefecture", prefecture), ("city", city), ("district", district)):
        if value:
            df = df.filter(F.col(name) == value)
    return df


def most_specific(df: DataFrame, prefecture: str = "", city: str = "", district: str = "") -> DataFrame:
    """Rows of the most specific level given, within those above it."""
    if district and city and prefecture:
        return by_location(df, prefecture, city, district)
    return by_location(df, prefecture, city) if city and prefecture else by_location(df, prefecture)


def like_search(df: DataFrame, query: str, column: str = "text", limit: int = 100, ties: tuple[str, ...] = ("page_id", "idx")) -> DataFrame:
    """Rows whose text holds the query (% and _ are wildcards), most confident first."""
    return df.filter(F.col(column).ilike(f"%{query}%")).orderBy(F.desc("confidence"), *ties).limit(limit)


def contains_search(df: DataFrame, query: str, column: str = "text") -> DataFrame:
    return df.filter(F.lower(column).contains(query.lower()))


def quota_search(df: DataFrame, query: str, circle_only: bool = False, ties: tuple[str, ...] = ("page_id", "idx")) -> DataFrame:
    """At most four rows: of a numeric query two in strict circles and two others, else strict ones first; df has text, type, confidence."""
    hits = contains_search(df, query).withColumn("strict", text.is_strict_circle(F.col("text"), F.col("type")))
    order = [F.desc("confidence"), *ties]
    if circle_only:
        return hits.filter("strict").orderBy(*order).limit(4)
    numeric = bool(query.strip()) and all(ch.isdecimal() or "①" <= ch <= "⑩" for ch in query.strip())
    if not numeric:
        return hits.orderBy(F.desc("strict"), *order).limit(4)
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("strict").orderBy(*order)))
    top = ranked.filter("n <= 4").withColumn("any_strict", F.max("strict").over(Window.partitionBy()))
    return top.filter("not any_strict or n <= 2").orderBy(F.desc("strict"), *order).limit(4).drop("n", "any_strict")


def hierarchical_search(files: DataFrame, wanted: dict[str, str], k: int = 50) -> DataFrame:
    """Files (prefecture, city, district, path) by hierarchical score."""
    scored = files.withColumn("score", scores.folder_match(F.col("prefecture"), F.col("city"), F.col("district"), wanted))
    return scored.filter("score > 0").orderBy(F.desc("score"), "path").limit(k)


def match_details(files: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Files with what matched at each level: exact, partial or none."""
    for name in ("prefecture", "city", "district"):
        w = wanted.get(name, "")
        kind = F.when(F.col(name) == w, "exact").when(F.col(name).contains(w), "partial").otherwise("none") if w else F.lit("none")
        files = files.withColumn(f"{name}_match", kind)
    return files


def folder_search(folders: DataFrame, query: str, k: int = 5, least: float = 0.3) -> DataFrame:
    """Best folders (prefecture, city, district, display_name, path) for a query."""
    if not query.strip():
        return folders.withColumn("similarity", F.lit(0.0)).limit(0)
    s = similarity.folder_similarity(query, F.col("prefecture"), F.col("city"), F.col("district"), F.col("display_name"))
    return folders.withColumn("similarity", s).filter(F.col("similarity") > least).groupBy("path").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "path").limit(k)


def fuzzy_search(df: DataFrame, query: str, threshold: float = 70.0, k: int | None = None, exclusive: bool = False, ties: tuple[str, ...] = ("page_id", "idx")) -> DataFrame:
    """Rows with a partial ratio of at least (exclusive: above) the threshold, best first; containment counts 100."""
    score = similarity.contained_or(F.lit(query), F.col("text"), similarity.partial_ratio(F.lit(query), F.col("text")))
    out = df.withColumn("similarity", score)
    out = out.filter(F.col("similarity") > threshold if exclusive else F.col("similarity") >= threshold).orderBy(F.desc("similarity"), *ties)
    return out.limit(k) if k else out


def ratio_search(df: DataFrame, query: str, least: float = 0.3, k: int | None = None, limit_first: bool = False, contained: bool = False, ties: tuple[str, ...] = ("page_id", "idx")) -> DataFrame:
    """Rows by sequence ratio; contained: a text that holds the query counts 1; an empty query returns all; limit_first keeps the first k in scan order."""
    if not query:
        return df.withColumn("similarity", F.lit(1.0))
    ratio = similarity.sequence_ratio(F.lit(query), F.col("text"))
    score = F.when(F.col("text").contains(query), 1.0).otherwise(ratio) if contained else ratio
    out = df.withColumn("similarity", score).filter(F.col("similarity") > least)
    if limit_first and k:
        out = out.orderBy(*ties).limit(k)
    out = out.orderBy(F.desc("similarity"), *ties)
    return out.limit(k) if k and not limit_first else out


def cache_probe(cache: DataFrame, query_hash: str, as_of) -> DataFrame:
    """Entries of a query that have not expired."""
    return cache.filter((F.col("query_hash") == query_hash) & (F.col("expires_at") > F.lit(as_of)))
