"""Detections from JSON files and recognition payloads, in one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

RAW = StructType(
    [StructField(n, t) for n, t in (("text", StringType()), ("inner_text", StringType()), ("bbox", ArrayType(DoubleType())), ("confidence", DoubleType()), ("ocr_confidence", DoubleType()), ("type", StringType()), ("detection_type", StringType()), ("pdf_path", StringType()), ("method", StringType()))]
)
BOX = StructType([StructField(n, IntegerType()) for n in ("x1", "y1", "x2", "y2")])


def read_json(spark: SparkSession, paths: list[str], default_path: str = "") -> DataFrame:
    """Detections of JSON array files; files that are missing, empty or no list of objects give none."""
    text = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    rows = text.text(paths).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    parsed = rows.filter(F.trim("value").startswith("[")).withColumn("d", F.explode(F.from_json("value", ArrayType(RAW), {"mode": "PERMISSIVE"})))
    return normalized(parsed.select("source_file", "d.*"), default_path)


def normalized(raw: DataFrame, default_path: str = "") -> DataFrame:
    """Raw detections with one name for each value; blank texts go."""
    text = F.coalesce("text", "inner_text")
    out = raw.select(
        text.alias("text"),
        F.coalesce("confidence", "ocr_confidence", F.lit(0.8)).alias("confidence"),
        F.coalesce("type", "detection_type", F.lit("text")).alias("type"),
        F.coalesce("pdf_path", F.lit(default_path)).alias("pdf_path"),
        "bbox",
        "method",
        *[c for c in ("source_file",) if c in raw.columns],
    )
    return out.filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def with_centers(df: DataFrame) -> DataFrame:
    """bbox [x1, y1, x2, y2] as columns with whole centres and an id from path and box."""
    b = [F.col("bbox")[i].cast("int") for i in range(4)]
    out = df.select("*", *(x.alias(n) for x, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)))
    out = out.withColumn("center_x", F.floor((F.col("x1") + F.col("x2")) / 2)).withColumn("center_y", F.floor((F.col("y1") + F.col("y2")) / 2))
    return out.withColumn("id", F.left(F.md5(F.concat_ws("_", "pdf_path", "text", "x1", "y1", "x2", "y2")), F.lit(16)))


def roi_files(files: DataFrame) -> DataFrame:
    """Circle rows from region image names: the number is the second part of ``.._N_.._original.jpg``."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).filter(F.col("name").endswith("_original.jpg")).withColumn("number", F.try_element_at(F.split("name", "_"), F.lit(2)))


def polygons(payload: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows of payloads (rec_texts, rec_scores, rec_polys) of a recognition engine, a detection each."""
    zipped = F.explode(F.arrays_zip("rec_texts", "rec_scores", "rec_polys")).alias("z")
    keep = [c for c in payload.columns if c not in ("rec_texts", "rec_scores", "rec_polys")]
    return payload.select(*keep, zipped).select(*keep, F.col("z.rec_texts").alias("text"), F.col("z.rec_scores").alias("confidence"), F.col("z.rec_polys").alias("polygon")).filter(F.col("confidence") >= least)


def mock_rows(spark: SparkSession, w: int, h: int) -> DataFrame:
    """Four fixed detections on a grid of two by two, for pages that no engine could read."""
    # fixed values: the texts of the rows
    texts = ("六本木１丁目88-7", "川合３丁目120E", "東京都港区", "示例地址123")
    rows = []
    for i, t in enumerate(texts):
        x, y = (i % 2) * (w // 2) + 50, (i // 2) * (h // 2) + 50
        rows.append((t, x, y, x + 200, y + 30, 0.8, "Mock"))
    return spark.createDataFrame(rows, "text string, x1 int, y1 int, x2 int, y2 int, confidence double, method string")
