"""Chains of operators: page pipelines, post-processing and spatial analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapsieve.functions import scores
from mapsieve.functions import text as T
from mapsieve.functions.geometry import distance, iou, overlap_of_smaller
from mapsieve.operators import filters, fold, spatial, statistics


def enhanced(df: DataFrame) -> DataFrame:
    """Class, enhanced score and target flag of detections."""
    out = df.withColumn("classification", T.stage5_type(F.col("text")))
    out = out.withColumn("enhanced_score", scores.enhanced(F.col("confidence"), F.col("classification"), F.col("text")))
    return out.withColumn("is_target", T.is_target(F.col("classification")))


def final_ranking(df: DataFrame, page: str = "page_id", score: str = "score") -> DataFrame:
    """Rows with their ``place`` in their page by a final score, best first (ties by idx); nothing is left out."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(F.desc(score), "idx")))


def same_text_near(limit: float):
    return lambda k, r: (k["text"] == r["text"]) & (distance(k["cx"], k["cy"], r["cx"], r["cy"]) < limit)


def simple_page_pipeline(df: DataFrame, page: str = "page_id") -> DataFrame:
    """Detections (page, idx, text, confidence, cx, cy ..) classified, scored, filtered, and freed of repeats near by."""
    kept = filters.known_and_scored(enhanced(df))
    return fold.greedy_dedupe(kept, [page], [F.col("idx")], same_text_near(50.0), lambda n, k: n["enhanced_score"] > k["enhanced_score"])


def full_statistics(df: DataFrame, page: str = "page_id") -> DataFrame:
    return statistics.page_statistics(simple_page_pipeline(df, page), [page])


def engine_union(page: str, *results: DataFrame) -> DataFrame:
    """All engines' rows, freed of overlapping ones: number-enhanced, then clearly more confident, then longer texts win."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)

    def better(n, k):
        clear = F.abs(n["confidence"] - k["confidence"]) > 0.1
        longer = F.char_length(n["text"]) != F.char_length(k["text"])
        by_rest = F.when(clear, n["confidence"] > k["confidence"]).when(longer, F.char_length(n["text"]) > F.char_length(k["text"])).otherwise(n["confidence"] > k["confidence"])
        return F.when(n["is_number"] & ~k["is_number"], True).when(k["is_number"] & ~n["is_number"], False).otherwise(by_rest)

    return fold.greedy_dedupe(rows, [page], [F.desc("confidence"), F.col("idx")], lambda k, r: overlap_of_smaller(k, r) > 0.6, better)


def post_process(df: DataFrame, page: str = "page_id") -> DataFrame:
    """Noise out, readings corrected, fragments merged, formats named, repeats by text out, scored and controlled."""
    rows = filters.noise(df).withColumn("c", T.corrected(F.trim("text"), F.col("confidence")))
    rows = rows.select(page, "idx", "x1", "y1", "x2", "y2", F.col("c.text").alias("text"), F.col("c.confidence").alias("confidence"), F.col("c.was_corrected").alias("was_corrected"))
    groups = fold.seed_groups(rows, [page], [F.col("idx")], _fragments)
    merged = groups.select(page, "group", _merged("members").alias("m")).select(page, "group", "m.*")
    merged = merged.withColumn("fixed", T.fix_format(F.col("text"))).withColumn("format_fixed", F.col("fixed") != F.col("text")).withColumn("text", F.col("fixed")).drop("fixed")
    merged = merged.withColumn("format_type", T.format_type(F.col("text"))).filter("format_type <> 'invalid'")
    choice = scores.choice(F.col("confidence"), F.lit(None).cast("double"), F.col("merged_from") > 1, F.col("was_corrected"), F.lit(True))
    best = fold.best_per_key(merged.withColumn("choice", choice), [page, "text"], [F.desc("choice"), F.col("group")]).drop("choice")
    best = best.withColumn("score", scores.comprehensive(F.col("confidence"), F.lit(None).cast("double"), F.col("format_type"), F.col("merged_from") > 1, F.col("was_corrected") | F.col("format_fixed"), F.lit(True)))
    best = best.withColumn("issues", scores.quality_issues(F.col("text"), F.col("confidence"), F.col("format_type"), F.lit(True)))
    return filters.passed_quality(best)


def _fragments(seed, row):
    """Whether two pieces of a text belong together: near, and digits beside a letter or short digits side by side."""
    cx = lambda b: (b["x1"] + b["x2"]) / 2
    cy = lambda b: (b["y1"] + b["y2"]) / 2
    near = distance(cx(seed), cy(seed), cx(row), cy(row)) <= 50
    digits = lambda b: b["text"].rlike("^[0-9]+$")
    letter = lambda b: b["text"].rlike("^[A-G]$")
    most = F.greatest(seed["y2"] - seed["y1"], row["y2"] - row["y1"])
    aligned = F.greatest(F.lit(0), F.least(seed["y2"], row["y2"]) - F.greatest(seed["y1"], row["y1"])) > most * 0.5
    gap = F.greatest(F.lit(0), F.greatest(seed["x1"], row["x1"]) - F.least(seed["x2"], row["x2"])) <= 30
    pair = ((digits(seed) & letter(row)) | (letter(seed) & digits(row))) & aligned
    short = digits(seed) & digits(row) & (F.char_length(seed["text"]) + F.char_length(row["text"]) <= 4) & gap & aligned
    return near & (pair | short)


def _merged(members: str):
    by_x = F.array_sort(F.transform(members, lambda m: F.struct(m["x1"].alias("x1"), m["idx"].alias("idx"), m["text"].alias("text"))))
    return F.struct(
        T.merge_texts(F.transform(by_x, lambda m: m["text"]), "A-G").alias("text"),
        (F.aggregate(members, F.lit(0.0), lambda a, m: a + m["confidence"]) / F.size(members)).alias("confidence"),
        F.array_min(F.transform(members, lambda m: m["x1"])).alias("x1"),
        F.array_min(F.transform(members, lambda m: m["y1"])).alias("y1"),
        F.array_max(F.transform(members, lambda m: m["x2"])).alias("x2"),
        F.array_max(F.transform(members, lambda m: m["y2"])).alias("y2"),
        F.exists(members, lambda m: m["was_corrected"]).alias("was_corrected"),
        F.size(members).alias("merged_from"),
    )


def spatial_analysis(df: DataFrame, roads: DataFrame, regions: DataFrame, page: str = "page_id") -> DataFrame:
    """Detections (page, idx, cx, cy, text, type, confidence) with road distance, region, spatial type, issues and confidence."""
    out = spatial.containing_region(spatial.road_distance(df, roads, page, "idx"), regions, page, "idx")
    inside, road = F.col("region_id").isNotNull(), F.col("road_distance")
    digit, letter = T.is_digit(F.col("text")), F.col("text").rlike(r"\p{L}")
    out = out.withColumn("spatial_type", scores.spatial_type(digit, letter, F.col("type"), road, inside))
    out = out.withColumn("spatial_confidence", scores.spatial_confidence(F.col("confidence"), F.col("spatial_type"), road, inside))
    out = out.withColumn("issues", scores.geographic_issues(F.col("text"), F.col("spatial_type"), road, inside, digit, T.has_digit(F.col("text"))))
    fewer = F.greatest(F.lit(0.0), F.col("spatial_confidence") - F.size("issues") * 0.1)
    return out.withColumn("is_valid", F.size("issues") == 0).withColumn("spatial_confidence", F.when(F.col("is_valid"), F.col("spatial_confidence")).otherwise(fewer))


def multi_scale_merge(df: DataFrame, page: str = "page_id") -> DataFrame:
    """Detections of several scales and engines merged where they overlap, or where digits meet a letter."""
    pair = lambda a, b: a["text"].rlike("^[0-9]+$") & b["text"].rlike("^[A-Z]$")
    hit = lambda s, r: (iou(s, r) > 0.7) | ((iou(s, r) > 0.1) & (pair(s, r) | pair(r, s)))
    groups = fold.seed_groups(df, [page], [F.col("idx")], hit)
    m = F.col("members")
    return groups.select(
        page,
        "group",
        F.when(F.size(m) == 1, m[0]["text"]).otherwise(T.merge_texts(F.transform(m, lambda x: x["text"]))).alias("text"),
        (F.aggregate(m, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(m)).alias("confidence"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["engine"]))), "+").alias("engine"),
        F.size(m).alias("merged_count"),
    )
