"""Counts, distributions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 3) -> Column:
    """Half up by floor, which every engine computes alike."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def page_statistics(df: DataFrame, by: list[str], kind: str = "classification", score: str = "enhanced_score", target: str = "is_target") -> DataFrame:
    """A row a page: total, mean score (of whole millionths, so that no order of adding matters), rows above .8, targets, and a map of class counts."""
    counts = df.groupBy(*by, kind).agg(F.count("*").alias("n"), F.sum(F.floor(F.col(score) * 1e6 + 0.5)).alias("s"), F.count_if(F.col(score) > 0.8).alias("high"), F.count_if(target).alias("t"))
    return counts.groupBy(*by).agg(
        F.sum("n").alias("total"),
        (F.sum("s").cast("double") / (F.sum("n") * 1e6)).alias("mean_score"),
        F.sum("high").alias("high_count"),
        F.sum("t").alias("target_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(kind), F.col("n"))))).alias("type_distribution"),
    )


def summary_of_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """A row a document from page rows (success, total, seconds)."""
    ok = F.count_if("success")
    return pages.groupBy(*by).agg(
        F.count("*").alias("total_pages"),
        ok.alias("successful_pages"),
        (F.count("*") - ok).alias("failed_pages"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("total"))), F.lit(0)).alias("total_detections"),
        F.sum("seconds").alias("total_seconds"),
        (F.sum("seconds") / F.count("*")).alias("seconds_per_page"),
        F.when(ok > 0, F.coalesce(F.sum(F.when(F.col("success"), F.col("total"))), F.lit(0)) / ok).otherwise(0.0).alias("detections_per_page"),
    )


def merged_distribution(pages: DataFrame, by: list[str], column: str = "type_distribution") -> DataFrame:
    """(by.., type, n): the pages' distributions added up."""
    return pages.select(*by, F.explode(column).alias("type", "n")).groupBy(*by, "type").agg(F.sum("n").alias("n"))


def batch_summary(files: DataFrame) -> DataFrame:
    """One row from file rows (path, status, texts, circles, seconds)."""
    ok = F.col("status") == "success"
    add = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    return files.agg(
        F.count("*").alias("total_files"),
        F.count_if(ok).alias("successful_files"),
        F.count_if(F.col("status") == "error").alias("failed_files"),
        add("texts").alias("total_text_regions"),
        add("circles").alias("total_circles"),
        add("seconds").alias("total_seconds"),
        F.when(F.count_if(ok) > 0, add("seconds") / F.count_if(ok)).otherwise(0.0).alias("seconds_per_file"),
    )


def failed_paths(files: DataFrame) -> DataFrame:
    return files.filter("status = 'error'").select("path")


def per_group(df: DataFrame, by: list[str], value: str = "confidence") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def recognition_rate(df: DataFrame) -> DataFrame:
    """Count, mean confidence, recognised rows and their share."""
    n = F.count("*")
    return df.agg(n.alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean"), F.count_if(F.trim("text") != "").alias("recognized"), F.when(n > 0, F.count_if(F.trim("text") != "") / n).otherwise(0.0).alias("rate"))


def words_to_lines(words: DataFrame, by: list[str], least: float = 30.0) -> DataFrame:
    """Lines of words (by.., left, top, width, height, conf, text, idx): joined text, box and mean confidence."""
    w = words.filter((F.trim("text") != "") & (F.col("conf") >= least))
    return w.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "idx", F.trim("text").alias("t")))), lambda x: x["t"]), "").alias("text"),
        F.min("left").alias("x1"),
        F.min("top").alias("y1"),
        F.max(F.col("left") + F.col("width")).alias("x2"),
        F.max(F.col("top") + F.col("height")).alias("y2"),
        F.avg("conf").alias("confidence"),
    )


def box_union(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def joined_texts(df: DataFrame, by: list[str], order: list[str], joiner: str = "") -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("__t")))), lambda x: x["__t"])
    return df.groupBy(*by).agg(F.array_join(texts, joiner).alias("text"), F.avg("confidence").alias("confidence"))


def cluster_summary(df: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Size, number of classes and commonest class (the first seen of equal ones) of each cluster; rows hold idx."""
    counts = df.groupBy(*by, kind).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    return counts.groupBy(*by).agg(F.sum("n").alias("size"), F.count("*").alias("types"), F.max_by(kind, F.struct("n", -F.col("first"))).alias("dominant"))


def repeated_texts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "text").agg(F.count("*").alias("n")).filter("n > 1")


def inverted_index(df: DataFrame, places: list[str]) -> DataFrame:
    return df.groupBy("text").agg(F.array_sort(F.collect_list(F.struct(*places))).alias("places"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """(bin, n), bins 1 to ``bins`` of equal width, the last closed."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1, F.lit(bins))
    return df.filter(F.col(value).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def category_rows(df: DataFrame) -> DataFrame:
    """Rows routed to categories; one may land in several."""
    from mapsieve.functions.text import is_price

    kinds = F.array_compact(
        F.array(
            F.when(F.col("shape") == "circle", "circled_numbers"),
            F.when((F.col("shape") != "circle") & (F.col("rotation") == 0), "horizontal_text"),
            F.when((F.col("shape") != "circle") & (F.col("rotation") != 0), "vertical_text"),
            F.when((F.col("shape") != "circle") & is_price(F.col("text")), "route_prices"),
            F.when((F.col("shape") == "small") & (F.char_length("text") <= 5), "small_text"),
        )
    )
    return df.filter(F.col("text") != "").withColumn("category", F.explode(kinds))
