"""Detections, files and pages derived from the star-schema tables, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_Q = "CAST(CAST(l_quantity AS INT) AS STRING)"
_LETTER = "substr('ABCDEFGH', CAST(l_partkey % 8 AS INT) + 1, 1)"
_INNER = (
    "l_orderkey AS page_id",
    "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS idx",
    "CAST(l_partkey % 200 AS INT) AS x1",
    "CAST((l_partkey * 37 + l_suppkey * 13) % 200 AS INT) AS y1",
    "CAST(10 + l_quantity AS INT) AS w",
    "CAST(8 + floor(l_quantity / 2) AS INT) AS h",
    "1 - l_discount * 8 AS confidence",
    f"CASE CAST((l_partkey + l_suppkey) % 9 AS INT) WHEN 0 THEN {_Q} WHEN 1 THEN {_Q} || {_LETTER} WHEN 2 THEN {_Q} || '-' || CAST(l_linenumber AS STRING) WHEN 3 THEN {_LETTER} || {_Q} WHEN 4 THEN {_LETTER} WHEN 5 THEN '' WHEN 6 THEN {_Q} || '万' WHEN 7 THEN {_Q} || {_Q} || {_Q} ELSE {_Q} || {_LETTER} END AS text",
    "CASE l_returnflag WHEN 'A' THEN 'paddle' WHEN 'N' THEN 'tesseract' ELSE 'easyocr' END AS engine",
    "CASE WHEN l_linestatus = 'O' THEN 'circle' ELSE 'text' END AS kind",
    "l_partkey % 5 = 0 AS is_number",
    "CAST(5 + l_quantity % 40 AS INT) AS radius",
    "l_suppkey AS det_key",
)
_OUTER = ("*", "x1 + w AS x2", "y1 + h AS y2", "x1 + w * 5e-1 AS cx", "y1 + h * 5e-1 AS cy")
_FILES = ("r_name AS prefecture", "n_name AS city", "c_mktsegment AS district", "c_name AS filename", "r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name || '.pdf' AS path", "c_custkey AS file_id", "c_acctbal AS balance")

DETECTIONS_SQL = f"SELECT {', '.join(_OUTER)} FROM (SELECT {', '.join(_INNER)} FROM lineitem)"
FILES_SQL = f"SELECT {', '.join(_FILES)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
PAGES_SQL = "SELECT o_orderkey AS page_id, o_custkey AS pdf_id, CAST(o_orderkey % 7 + 1 AS INT) AS page_number, o_orderdate AS created_at, o_totalprice AS seconds, o_orderstatus <> 'P' AS success FROM orders"
WITH = f"WITH det AS ({DETECTIONS_SQL}), files AS ({FILES_SQL}), pg AS ({PAGES_SQL}) "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_INNER).selectExpr(*_OUTER)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).selectExpr(*_FILES)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page_id", "o_custkey AS pdf_id", "CAST(o_orderkey % 7 + 1 AS INT) AS page_number", "o_orderdate AS created_at", "o_totalprice AS seconds", "o_orderstatus <> 'P' AS success")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a searchable text with the keys of a detection."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(1).alias("idx"), "text")
