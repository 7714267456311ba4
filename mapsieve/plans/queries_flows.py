"""Queries of whole flows: streams, engines, batch runs and crawl plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapsieve.functions import geometry as G
from mapsieve.functions import text as T
from mapsieve.operators import filters, fold, search, spatial, statistics, storage, tables, vision
from mapsieve.plans.queries_classify import CLEAN_NUMBER, NUMBER_REGION
from mapsieve.plans.derived import WITH, detections, files, pages, table
from mapsieve.sources import html
from mapsieve.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _folder(spark):
    return storage.shared_path(spark, "q")


def _incremental(s, d):
    """Rows that a stream over the files appends, in as many runs as there is something new."""
    at, schema = _folder(s), table(s, d, "events").schema
    for _ in range(2):
        ingest.run_available(ingest.new_files(s, f"{d}/event*.parquet", schema), f"{at}/out", f"{at}/checkpoint")
    return s.read.schema(schema).parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"))


add("R02_incremental_run", _incremental, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")


def _statuses(s, d):
    """The last counts by day and status of a log stream."""
    at = _folder(s)
    log = ingest.new_files(s, f"{d}/event*.parquet", table(s, d, "events").schema).select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))
    ingest.write_status_counts(log, f"{at}/out", f"{at}/checkpoint", "1 day", "30 days")
    return ingest.latest_status_counts(s, f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


add("R04_status_stream", _statuses, "SELECT date_trunc('day', ts) AS start, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, count(*) AS n FROM events GROUP BY 1, 2")


def _all_sheets(s, d):
    return pages(s, d).select("page_id", F.lit("sheet").cast("binary").alias("image"), F.lit(200).alias("width"), F.lit(100).alias("height"))


def _scaled(sheets):
    return sheets.crossJoin(F.broadcast(sheets.sparkSession.range(1, 3).select(F.col("id").cast("int").alias("scale")))).select("page_id", "image", (F.col("width") * F.col("scale")).alias("width"), (F.col("height") * F.col("scale")).alias("height"))


def _registry():
    out = vision.Registry()
    out.add(vision.GridEngine())
    return out


_CELLS = "(VALUES ('1', 0, 0, 100, 50), ('2', 100, 0, 200, 50), ('3', 0, 50, 100, 100), ('4', 100, 50, 200, 100)) AS c(text, x1, y1, x2, y2)"
add("U01_engine_rows_all", lambda s, d: _registry().detect(_all_sheets(s, d)).select("page_id", "text", "x1", "y1", "x2", "y2", "engine"), f"{WITH} SELECT page_id, text, x1, y1, x2, y2, 'grid' AS engine FROM pg, {_CELLS}")
add("B08_scales_and_engines_all", lambda s, d: _registry().detect(_scaled(_all_sheets(s, d))).groupBy("page_id").agg(F.count("*").alias("n"), F.max("x2").alias("right")), f"{WITH} SELECT page_id, 8::BIGINT AS n, 400 AS \"right\" FROM pg")
add("B09_best_valid_number", lambda s, d: filters.number_regions(detections(s, d)).withColumn("clean", T.clean_number(F.col("text"))).filter("clean is not null").groupBy("page_id").agg(F.max_by("clean", F.struct("confidence", -F.col("idx"))).alias("number")), f"{WITH}, n AS (SELECT page_id, idx, confidence, {CLEAN_NUMBER} AS clean FROM det WHERE {NUMBER_REGION}) SELECT page_id, first(clean ORDER BY confidence DESC, idx) AS number FROM n WHERE clean IS NOT NULL GROUP BY 1")
add("B02_batch_run", lambda s, d: statistics.batch_summary(pages(s, d).join(detections(s, d).groupBy("page_id").agg(F.count("*").alias("texts"), F.count_if(F.col("kind") == "circle").alias("circles")), "page_id").select(F.when(F.col("success"), "success").otherwise("error").alias("status"), "texts", "circles", F.lit(1).alias("seconds"))).select("total_files", "successful_files", "total_text_regions", "total_circles"), f"{WITH}, n AS (SELECT page_id, count(*) AS texts, count(*) FILTER (kind = 'circle') AS circles FROM det GROUP BY 1) SELECT count(*) AS total_files, count(*) FILTER (success) AS successful_files, CAST(coalesce(sum(texts) FILTER (success), 0) AS BIGINT) AS total_text_regions, CAST(coalesce(sum(circles) FILTER (success), 0) AS BIGINT) AS total_circles FROM pg JOIN n USING (page_id)")
add("B03_two_branches", lambda s, d: detections(s, d).filter("kind = 'text'").groupBy("page_id").agg(F.count("*").alias("texts")).join(detections(s, d).filter("kind = 'circle'").groupBy("page_id").agg(F.count("*").alias("circles")), "page_id", "full").select("page_id", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("circles", F.lit(0)).alias("circles")), f"{WITH} SELECT page_id, count(*) FILTER (kind = 'text') AS texts, count(*) FILTER (kind = 'circle') AS circles FROM det GROUP BY 1")
add("B04_place_then_text", lambda s, d: search.like_search(detections(s, d).join(pages(s, d), "page_id").join(search.by_location(files(s, d), "ASIA").select(F.col("file_id").alias("pdf_id"), "path"), "pdf_id"), "1", limit=20).select("page_id", "idx", "path"), f"{WITH} SELECT page_id, idx, path FROM det JOIN pg USING (page_id) JOIN files ON file_id = pdf_id WHERE prefecture = 'ASIA' AND contains(text, '1') ORDER BY confidence DESC, page_id, idx LIMIT 20")
add("B12_graph_nodes", lambda s, d: detections(s, d).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.avg("cx").alias("cx")).select("page_id", "kind", "n", (F.floor(F.col("cx") * 1e4 + 0.5) / 1e4).alias("cx")), f"{WITH} SELECT page_id, kind, count(*) AS n, floor(avg(cx) * 1e4 + 0.5) / 1e4 AS cx FROM det GROUP BY 1, 2")
add("B14_read_regions", lambda s, d: filters.region_shape(detections(s, d)).filter("trim(text) <> ''").select("page_id", "idx"), f"{WITH} SELECT page_id, idx FROM det WHERE w * h BETWEEN 100 AND 50000 AND w / h BETWEEN 0.1 AND 10 AND trim(text) <> ''")
add("B16_address_entries", lambda s, d: tables.processing_log(files(s, d).select(F.col("path").alias("pdf_path"), F.col("file_id").alias("pdf_id")).join(pages(s, d).join(detections(s, d).filter(T.is_valid_address(F.col("text"))), "page_id").groupBy("pdf_id").agg(F.count("*").alias("addresses_count")), "pdf_id", "left").withColumn("error_message", F.lit(None).cast("string"))).select("pdf_path", "status", "addresses_count"), f"{WITH}, n AS (SELECT pdf_id, count(*) AS n FROM det JOIN pg USING (page_id) WHERE length(trim(text)) >= 2 AND regexp_matches(text, '[0-9]|丁目|番|号|町|区|市|府|県|丁|地') GROUP BY 1) SELECT path AS pdf_path, CASE WHEN n.n > 0 THEN 'success' ELSE 'no_addresses' END AS status, coalesce(n.n, 0) AS addresses_count FROM files LEFT JOIN n ON pdf_id = file_id")
add("B17_price_circles", lambda s, d: spatial.text_of_circle(detections(s, d).filter("kind = 'circle'").select("page_id", "idx", "cx", "cy", "radius"), detections(s, d).filter((F.col("kind") == "text") & T.is_price(F.col("text"))).select("page_id", "idx", "cx", "cy", "text"), "page_id", "idx").filter("circle_text is not null").select("page_id", "idx", "circle_text"), f"{WITH}, p AS (SELECT * FROM det WHERE kind = 'text' AND regexp_matches(text, '^[0-9]{{2,3}}[A-G]$')) SELECT a.page_id, a.idx, first(b.text ORDER BY b.idx) AS circle_text FROM det a JOIN p b ON a.page_id = b.page_id AND a.kind = 'circle' AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) < a.radius * 1.5::DOUBLE GROUP BY 1, 2")
add("B18_crawl_tasks", lambda s, d: html.task_list(table(s, d, "pages").select("page_id", "url", F.concat("html", F.lit('<a href="files/'), F.col("page_id").cast("string"), F.lit('.pdf">x</a>')).alias("html"), F.lit("p").alias("prefecture"), F.lit("c").alias("city"), F.lit("").alias("district"))).select("path"), "SELECT 'p/c/' || page_id || '.pdf' AS path FROM pages")
add("B19_normalized_regions", lambda s, d: detections(s, d).select("page_id", "idx", G.normalized_box(F.col("x1"), F.col("y1"), F.col("w"), F.col("h"), F.lit(512), F.lit(512))["ncx"].alias("ncx")), f"{WITH} SELECT page_id, idx, (x1 + w / 2) / 512 AS ncx FROM det")


def _csv(s, d):
    at = _folder(s)
    tables.write_csv(files(s, d).select("path", "file_id"), at)
    return s.read.option("header", True).schema("path string, file_id long").csv(at)


def _json(s, d):
    at = _folder(s)
    tables.write_json(files(s, d).select("path", "file_id"), at)
    return s.read.schema("path string, file_id long").json(at)


add("K07_csv_export", _csv, f"{WITH} SELECT path, file_id FROM files")
add("K05_json_files", _json, f"{WITH} SELECT path, file_id FROM files")
add("K06_progress_rows", lambda s, d: fold.best_per_key(pages(s, d).withColumn("seq", F.col("page_id")), ["pdf_id"], [F.desc("seq")]).select("pdf_id", "page_id"), f"{WITH} SELECT pdf_id, max(page_id) AS page_id FROM pg GROUP BY 1")
