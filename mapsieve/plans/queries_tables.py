"""Queries of the store: joins, upserts, logs, caches and table statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mapsieve.operators import tables
from mapsieve.operators.statistics import rounded
from mapsieve.plans.derived import WITH, detections, files, pages, table
from mapsieve.plans.queries_page import R
from mapsieve.sources import detections as D
from mapsieve.sources import hierarchy

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _joined(rows, s, d):
    return tables.with_pages(rows, pages(s, d), files(s, d).select(F.col("file_id").alias("pdf_id"), "filename", "prefecture"))


_JOIN = "JOIN pg USING (page_id) JOIN files ON files.file_id = pg.pdf_id"
add("J01_text_regions", lambda s, d: _joined(detections(s, d), s, d).select("filename", "page_number", "page_id", "idx", "text"), f"{WITH} SELECT filename, page_number, page_id, idx, text FROM det {_JOIN}")
add("J02_circles", lambda s, d: _joined(detections(s, d).filter("kind = 'circle'"), s, d).groupBy("filename").agg(F.count("*").alias("n"), F.sum("radius").alias("radius")), f"{WITH} SELECT filename, count(*) AS n, CAST(sum(radius) AS BIGINT) AS radius FROM det {_JOIN} WHERE kind = 'circle' GROUP BY 1")
add("A01_table_counts", lambda s, d: detections(s, d).agg(F.count("*").alias("regions"), F.count_if(F.col("kind") == "circle").alias("circles"), rounded(F.coalesce(F.avg("confidence"), F.lit(0.0))).alias("mean")), f"{WITH} SELECT count(*) AS regions, count(*) FILTER (kind = 'circle') AS circles, {R('coalesce(avg(confidence), 0)', 3)} AS mean FROM det")
add("A02_by_place", lambda s, d: _joined(detections(s, d), s, d).groupBy("prefecture").agg(F.count("*").alias("n"), F.countDistinct("pdf_id").alias("pdfs")), f"{WITH} SELECT prefecture, count(*) AS n, count(DISTINCT pdf_id) AS pdfs FROM det {_JOIN} GROUP BY 1")
add("A03_log_counts", lambda s, d: pages(s, d).agg(F.countDistinct("pdf_id").alias("pdfs"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("bad")), f"{WITH} SELECT count(DISTINCT pdf_id) AS pdfs, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS bad FROM pg")
add("A04_top_places", lambda s, d: _joined(detections(s, d), s, d).groupBy("prefecture", "page_number").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefecture", "page_number").limit(10), f"{WITH} SELECT prefecture, page_number, count(*) AS n FROM det {_JOIN} GROUP BY 1, 2 ORDER BY n DESC, prefecture, page_number LIMIT 10")
add("A05_by_kind", lambda s, d: detections(s, d).groupBy("kind").agg(F.count("*").alias("n")), f"{WITH} SELECT kind, count(*) AS n FROM det GROUP BY 1")
add("A06_summary", lambda s, d: detections(s, d).agg(F.count("*").alias("total"), F.countDistinct(F.when(F.col("text") != "", F.col("text"))).alias("texts"), rounded(F.avg("confidence")).alias("mean")), f"{WITH} SELECT count(*) AS total, count(DISTINCT nullif(text, '')) AS texts, {R('avg(confidence)', 3)} AS mean FROM det")
add("A16_service_stats", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), rounded(F.avg("value"), 4).alias("mean")), f"SELECT event_type, count(*) AS n, {R('avg(value)', 4)} AS mean FROM events GROUP BY 1")
add("K01_upsert", lambda s, d: tables.upsert(files(s, d).select("path", "file_id", F.lit(1).alias("hits")), files(s, d).filter("file_id % 3 = 0").selectExpr("path", "file_id + 100000 AS file_id"), ["path"], {"hits": F.lit(0)}), f"{WITH} SELECT path, CASE WHEN file_id % 3 = 0 THEN file_id + 100000 ELSE file_id END AS file_id, CASE WHEN file_id % 3 = 0 THEN 0 ELSE 1 END AS hits FROM files")
add("K02_append_ids", lambda s, d: tables.append_with_ids(files(s, d).filter("file_id <= 10").select(F.col("file_id").alias("id"), "path"), files(s, d).filter("file_id > 10").select("path"), "id", ["path"]), f"{WITH}, m AS (SELECT coalesce(max(file_id), 0) AS top FROM files WHERE file_id <= 10) SELECT file_id AS id, path FROM files WHERE file_id <= 10 UNION ALL SELECT top + row_number() OVER (ORDER BY path) AS id, path FROM files, m WHERE file_id > 10")
add("K04_processing_log", lambda s, d: tables.processing_log(files(s, d).select(F.col("path").alias("pdf_path"), (F.col("file_id") % 3).alias("addresses_count"), F.when(F.col("file_id") % 5 == 0, "bad file").alias("error_message"))).groupBy("status").agg(F.count("*").alias("n")), f"{WITH} SELECT CASE WHEN file_id % 5 = 0 THEN 'error' WHEN file_id % 3 > 0 THEN 'success' ELSE 'no_addresses' END AS status, count(*) AS n FROM files GROUP BY 1")
add("K05_json_rows", lambda s, d: tables.as_json(files(s, d), ["prefecture", "file_id"]), f"{WITH} SELECT '{{\"prefecture\":\"' || prefecture || '\",\"file_id\":' || file_id || '}}' AS json FROM files")
_CACHE = "SELECT CAST(user_id AS STRING) AS query_hash, max(ts) + INTERVAL 1 HOUR AS expires_at, count(*) AS hits FROM events GROUP BY 1"


def _cache(s, d):
    return table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("query_hash")).agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"), F.count("*").alias("hits"))


def _middle(s, d):
    return table(s, d, "events").agg(F.max("ts") - F.expr("INTERVAL 2 HOURS")).first()[0]


_AS_OF = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"
add("J16_cache_live", lambda s, d: tables.live(_cache(s, d), _middle(s, d)).select("query_hash", "hits"), f"WITH c AS ({_CACHE}) SELECT query_hash, hits FROM c WHERE expires_at > {_AS_OF}")
add("K09_cache_expired", lambda s, d: tables.expired(_cache(s, d), _middle(s, d)).select("query_hash", "hits"), f"WITH c AS ({_CACHE}) SELECT query_hash, hits FROM c WHERE expires_at <= {_AS_OF}")
add("K10_hit_counts", lambda s, d: tables.hit_counts(table(s, d, "events").select(F.md5(F.col("user_id").cast("string")).alias("query_hash"))), "SELECT md5(CAST(user_id AS STRING)) AS query_hash, count(*) AS hit_count FROM events GROUP BY 1")
add("J17_missing_downloads", lambda s, d: tables.missing_downloads(files(s, d).select("path"), files(s, d).filter("balance > 0").select("path")).select("path"), f"{WITH} SELECT path FROM files WHERE NOT balance > 0")
add("J18_positional_zip", lambda s, d: pages(s, d).select("page_id", "page_number").join(detections(s, d).filter("idx = 1").select("page_id", "text"), "page_id"), f"{WITH} SELECT pg.page_id, page_number, text FROM pg JOIN det USING (page_id) WHERE idx = 1")
add("S11_normalized_detections", lambda s, d: D.normalized(detections(s, d).select(F.when(F.col("is_number"), F.col("text")).alias("text"), F.col("text").alias("inner_text"), F.lit(None).cast("double").alias("confidence"), F.when(F.col("idx") > 1, F.col("confidence")).alias("ocr_confidence"), F.lit(None).cast("string").alias("type"), F.col("kind").alias("detection_type"), F.lit(None).cast("string").alias("pdf_path"), F.array("x1", "y1").alias("bbox"), F.col("engine").alias("method"))).groupBy("type", "method").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == 0.8).alias("defaulted")), f"{WITH} SELECT kind AS type, engine AS method, count(*) AS n, count(*) FILTER (CASE WHEN idx > 1 THEN confidence ELSE 0.8::DOUBLE END = 0.8::DOUBLE) AS defaulted FROM det WHERE trim(text) <> '' GROUP BY 1, 2")
add("S12_centers", lambda s, d: D.with_centers(detections(s, d).select("page_id", "idx", "text", F.col("engine").alias("pdf_path"), F.array("x1", "y1", "x2", "y2").alias("bbox"))).select("page_id", "idx", "center_x", "center_y", "id"), f"{WITH} SELECT page_id, idx, CAST(floor((x1 + x2) / 2) AS BIGINT) AS center_x, CAST(floor((y1 + y2) / 2) AS BIGINT) AS center_y, left(md5(engine || '_' || text || '_' || x1 || '_' || y1 || '_' || x2 || '_' || y2), 16) AS id FROM det")
add("P09_engine_payload", lambda s, d: D.polygons(detections(s, d).groupBy("page_id").agg(F.collect_list("text").alias("rec_texts"), F.collect_list("confidence").alias("rec_scores"), F.collect_list("x1").alias("rec_polys")), 0.5).select("page_id", "text", F.col("polygon").alias("x1")), f"{WITH} SELECT page_id, text, x1 FROM det WHERE confidence >= 0.5")
add("F22_misplaced_wards", lambda s, d: hierarchy.misplaced(files(s, d).select("prefecture", F.col("district").alias("name")).distinct(), files(s, d).select("prefecture", "city", F.col("district").alias("ward"), F.dense_rank().over(Window.partitionBy("prefecture").orderBy("city")).alias("ord")).distinct()).select("prefecture", "name", "city"), f"{WITH} SELECT prefecture, district AS name, min(city) AS city FROM files GROUP BY 1, 2")
add("K12_report", lambda s, d: hierarchy.move_plan_report(files(s, d).select("city", F.col("district").alias("name")).distinct()), f"{WITH} SELECT city, string_agg(district, ', ' ORDER BY district) AS report FROM (SELECT DISTINCT city, district FROM files) GROUP BY 1")
