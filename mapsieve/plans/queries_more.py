"""Queries of the remaining operators: geometry scores, orders, sets, logs and plans."""

from __future__ import annotations

import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from mapsieve.functions import geometry as G
from mapsieve.functions import scores
from mapsieve.functions import text as T
from mapsieve.operators import search, spatial, statistics, storage, tables, vision
from mapsieve.operators.statistics import rounded
from mapsieve.plans.derived import WITH, detections, files, pages, table, texts
from mapsieve.plans.queries_page import IOU, MIN_OVERLAP, R
from mapsieve.plans.queries_spatial import REACH
from mapsieve.sources import detections as D
from mapsieve.sources import hierarchy, html, images, sqlite

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _pairs(s, d):
    a, b = detections(s, d).alias("k"), detections(s, d).alias("c")
    return a.join(b, (F.col("k.page_id") == F.col("c.page_id")) & (F.col("k.idx") < F.col("c.idx")))


def _box(t):
    return {x: F.col(f"{t}.{x}") for x in ("x1", "y1", "x2", "y2")}


_PAIR = "det k JOIN det c ON k.page_id = c.page_id AND k.idx < c.idx"
add("Ga_iou", lambda s, d: _pairs(s, d).select(F.col("k.page_id").alias("page_id"), F.col("k.idx").alias("a"), F.col("c.idx").alias("b"), rounded(G.iou(_box("k"), _box("c")), 6).alias("iou")), f"{WITH} SELECT k.page_id, k.idx AS a, c.idx AS b, {R(IOU)} AS iou FROM {_PAIR}")
add("Gb_overlap_of_smaller", lambda s, d: _pairs(s, d).select(F.col("k.page_id").alias("page_id"), F.col("k.idx").alias("a"), F.col("c.idx").alias("b"), rounded(G.overlap_of_smaller(_box("k"), _box("c")), 6).alias("share")), f"{WITH} SELECT k.page_id, k.idx AS a, c.idx AS b, {R(MIN_OVERLAP)} AS share FROM {_PAIR}")
add("J19_overlap_pairs", lambda s, d: _pairs(s, d).filter(G.iou(_box("k"), _box("c")) > 0.5).groupBy(F.col("k.page_id").alias("page_id")).agg(F.count("*").alias("n")), f"{WITH} SELECT k.page_id, count(*) AS n FROM {_PAIR} WHERE {IOU} > 0.5 GROUP BY 1")
add("Gc_center_distance", lambda s, d: _pairs(s, d).select(F.col("k.page_id").alias("page_id"), F.col("k.idx").alias("a"), F.col("c.idx").alias("b"), rounded(G.distance(F.col("k.cx"), F.col("k.cy"), F.col("c.cx"), F.col("c.cy")), 6).alias("far")), f"{WITH} SELECT k.page_id, k.idx AS a, c.idx AS b, {R('sqrt((k.cx - c.cx) * (k.cx - c.cx) + (k.cy - c.cy) * (k.cy - c.cy))')} AS far FROM {_PAIR}")
add("Gd_folded_angle", lambda s, d: detections(s, d).select("page_id", "idx", rounded(G.folded_angle(G.angle_degrees(F.col("x1"), F.col("y1"), F.col("cx"), F.col("cy"))), 6).alias("angle")), f"{WITH} SELECT page_id, idx, {R('least(degrees(atan2(cy - y1, cx - x1)), 90 - degrees(atan2(cy - y1, cx - x1)))')} AS angle FROM det")
add("Gf_vertical_overlap", lambda s, d: _pairs(s, d).select(F.col("k.page_id").alias("page_id"), F.col("k.idx").alias("a"), F.col("c.idx").alias("b"), rounded(G.vertical_overlap(F.col("k.y1"), F.col("k.y2"), F.col("c.y1"), F.col("c.y2")), 6).alias("share")), f"{WITH} SELECT k.page_id, k.idx AS a, c.idx AS b, {R('greatest(0, least(k.y2, c.y2) - greatest(k.y1, c.y1))::DOUBLE / greatest(k.y2 - k.y1, c.y2 - c.y1)')} AS share FROM {_PAIR}")
add("Gg_circularity", lambda s, d: detections(s, d).select("page_id", "idx", rounded(G.circularity(F.col("w") * F.col("h"), 2 * (F.col("w") + F.col("h"))), 6).alias("c")), f"{WITH} SELECT page_id, idx, {R('4 * pi() * (w * h) / ((2 * (w + h)) * (2 * (w + h)))')} AS c FROM det")
add("Gh_relationship_type", lambda s, d: detections(s, d).groupBy(scores.relationship_type(F.col("x1")).alias("kind")).agg(F.count("*").alias("n")), f"{WITH} SELECT CASE WHEN x1 <= 30 THEN 'adjacent' WHEN x1 <= 60 THEN 'nearby' ELSE 'distant' END AS kind, count(*) AS n FROM det GROUP BY 1")
_TYPED = "CASE idx % 3 WHEN 0 THEN 'route_price' WHEN 1 THEN 'block_number' ELSE 'unknown' END"
_SPATIAL = "CASE WHEN typ = 'route_price' AND x1 <= 50 THEN 'route_price_confirmed' WHEN typ = 'block_number' AND is_number AND x1 >= 20 THEN 'block_number_confirmed' WHEN x1 < 30 AND regexp_matches(text, '^[0-9]+$|[A-Za-z万]') THEN 'likely_route_price' WHEN x1 >= 30 AND is_number AND x1 > 50 AND regexp_matches(text, '^[0-9]+$') THEN 'likely_block_number' WHEN typ = 'unknown' AND is_number THEN 'possible_block_number' WHEN typ = 'unknown' AND x1 < 50 THEN 'possible_route_price' ELSE 'spatial_' || typ END"


def _spatial(s, d):
    df = detections(s, d).withColumn("typ", F.expr(_TYPED))
    kind = scores.spatial_type(T.is_digit(F.col("text")), F.col("text").rlike(r"\p{L}"), F.col("typ"), F.col("x1").cast("double"), F.col("is_number"))
    return df.withColumn("st", kind)


_ST = f"{WITH}, t AS (SELECT *, {_TYPED} AS typ FROM det), u AS (SELECT *, {_SPATIAL} AS st FROM t)"
add("Gi_spatial_type", lambda s, d: _spatial(s, d).groupBy("st").agg(F.count("*").alias("n")), f"{_ST} SELECT st, count(*) AS n FROM u GROUP BY 1")
_C03 = "least(1.0::DOUBLE, confidence + (CASE WHEN contains(st, 'confirmed') THEN 0.3::DOUBLE WHEN contains(st, 'likely') THEN 0.2::DOUBLE WHEN contains(st, 'possible') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN contains(st, 'route_price') THEN greatest(0.0::DOUBLE, 1 - x1 / 100) * 0.1::DOUBLE WHEN contains(st, 'block_number') THEN CASE WHEN is_number THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN x1 > 30 THEN 0.1::DOUBLE ELSE 0 END ELSE 0 END))"
add("C03_spatial_confidence", lambda s, d: _spatial(s, d).select("page_id", "idx", rounded(scores.spatial_confidence(F.col("confidence"), F.col("st"), F.col("x1").cast("double"), F.col("is_number")), 6).alias("score")), f"{_ST} SELECT page_id, idx, {R(_C03)} AS score FROM u")
add("F12_geographic_issues", lambda s, d: _spatial(s, d).select("page_id", "idx", F.size(scores.geographic_issues(F.col("text"), F.col("st"), F.col("x1").cast("double"), F.col("is_number"), T.is_digit(F.col("text")), T.has_digit(F.col("text")))).alias("issues")), f"{_ST} SELECT page_id, idx, CAST(CASE WHEN contains(st, 'route_price') AND x1 > 50 THEN 1 ELSE 0 END + CASE WHEN contains(st, 'block_number') AND NOT is_number THEN 1 ELSE 0 END + CASE WHEN contains(st, 'route_price') AND NOT regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN contains(st, 'block_number') AND NOT regexp_matches(text, '^[0-9]+$') AND NOT contains(text, '-') THEN 1 ELSE 0 END AS INT) AS issues FROM u")
add("A12_spatial_statistics", lambda s, d: _spatial(s, d).groupBy("st").agg(F.count("*").alias("total"), F.count_if("is_number").alias("valid"), rounded(F.count_if("is_number") / F.count("*"), 6).alias("rate")), f"{_ST} SELECT st, count(*) AS total, count(*) FILTER (is_number) AS valid, {R('count(*) FILTER (is_number)::DOUBLE / count(*)')} AS rate FROM u GROUP BY 1")
add("A15_running_average", lambda s, d: pages(s, d).select("pdf_id", "page_id", rounded(F.avg("page_number").over(Window.partitionBy("pdf_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("mean")), f"{WITH} SELECT pdf_id, page_id, {R('avg(page_number) OVER (PARTITION BY pdf_id ORDER BY page_id ROWS UNBOUNDED PRECEDING)')} AS mean FROM pg")
add("A21_result_means", lambda s, d: detections(s, d).groupBy("engine").agg(rounded(F.avg("confidence"), 5).alias("mean"), F.max("w").alias("most")), f"{WITH} SELECT engine, {R('avg(confidence)', 5)} AS mean, max(w) AS most FROM det GROUP BY 1")
add("A22_by_type", lambda s, d: detections(s, d).groupBy("kind", "engine").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages")), f"{WITH} SELECT kind, engine, count(*) AS n, count(DISTINCT page_id) AS pages FROM det GROUP BY 1, 2")
add("W05_growth_of_ten", lambda s, d: table(s, d, "events").select("user_id", "event_id", "ts", (F.last("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)) - F.first("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)) > 100).alias("grew")).select("user_id", "event_id", "grew"), "SELECT user_id, event_id, last_value(event_id) OVER w - first_value(event_id) OVER w > 100 AS grew FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
add("W04_enumerated", lambda s, d: detections(s, d).select("page_id", "idx", F.row_number().over(Window.partitionBy("page_id", "engine").orderBy("idx")).alias("n")), f"{WITH} SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id, engine ORDER BY idx) AS INT) AS n FROM det")
add("W01_best_per_engine", lambda s, d: detections(s, d).withColumn("n", F.row_number().over(Window.partitionBy("page_id", "engine").orderBy(F.desc("confidence"), "idx"))).filter("n = 1").select("page_id", "engine", "idx"), f"{WITH} SELECT page_id, engine, idx FROM det QUALIFY row_number() OVER (PARTITION BY page_id, engine ORDER BY confidence DESC, idx) = 1")
_BUCKET = "floor(page_id / 4096)"
add("O01_newest_first_all", lambda s, d: tables.placed(pages(s, d), F.col("created_at"), F.expr(_BUCKET), [F.col("page_id")]).select("page_id", "place"), f"{WITH} SELECT page_id, row_number() OVER (ORDER BY created_at DESC, page_id) AS place FROM pg")
add("O02_reading_order_all", lambda s, d: detections(s, d).select("page_id", "idx", F.row_number().over(Window.partitionBy("page_id").orderBy("y1", "x1", "idx")).alias("place")), f"{WITH} SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, idx) AS place FROM det")
add("O08_by_area_all", lambda s, d: tables.placed(detections(s, d), F.col("w") * F.col("h"), F.expr(_BUCKET), [F.col("page_id"), F.col("idx")]).select("page_id", "idx", "place"), f"{WITH} SELECT page_id, idx, row_number() OVER (ORDER BY w * h DESC, page_id, idx) AS place FROM det")
add("O05_cap_before_work", lambda s, d: detections(s, d).join(files(s, d).orderBy("path").limit(50).join(pages(s, d), F.col("file_id") == F.col("pdf_id")).select("page_id"), "page_id").select("page_id", "idx"), f"{WITH}, f AS (SELECT file_id FROM files ORDER BY path LIMIT 50) SELECT det.page_id, idx FROM det JOIN pg USING (page_id) JOIN f ON f.file_id = pg.pdf_id")
add("O07_score_order_cap", lambda s, d: detections(s, d).orderBy(F.desc(scores.weighted(F.col("confidence"), F.lit("dbnet"))), "page_id", "idx").limit(1000).select("page_id", "idx"), f"{WITH} SELECT page_id, idx FROM det ORDER BY confidence * 0.9::DOUBLE DESC, page_id, idx LIMIT 1000")
add("X02_ordered_distinct", lambda s, d: detections(s, d).groupBy("page_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("idx", "engine"))), lambda x: x["engine"])), "+").alias("engines")), f"{WITH}, g AS (SELECT page_id, engine, min(idx) AS first FROM det GROUP BY 1, 2) SELECT page_id, string_agg(engine, '+' ORDER BY first) AS engines FROM g GROUP BY 1")
add("X03_character_sets", lambda s, d: detections(s, d).filter("text <> ''").select(F.size(F.array_intersect(F.split("text", ""), F.array(*map(F.lit, "12A-")))).alias("both")).groupBy("both").agg(F.count("*").alias("n")), f"{WITH} SELECT CAST(len(list_intersect(string_split(text, ''), ['1', '2', 'A', '-'])) AS INT) AS both, count(*) AS n FROM det WHERE text <> '' GROUP BY 1")
add("P04_tile_offset", lambda s, d: detections(s, d).select("page_id", "idx", (F.col("x1") + F.col("idx") * 512).alias("x"), (F.col("y1") + F.col("idx") * 512).alias("y")), f"{WITH} SELECT page_id, idx, x1 + idx * 512 AS x, y1 + idx * 512 AS y FROM det")
add("J08_regions_at_point", lambda s, d: spatial.regions_at(detections(s, d).select(F.col("engine").alias("pdf_path"), F.lit(1).alias("page_number"), (F.col("x1") / 256).alias("nx1"), (F.col("y1") / 256).alias("ny1"), (F.col("x2") / 256).alias("nx2"), (F.col("y2") / 256).alias("ny2"), "page_id", "idx"), "paddle", 1, 0.25, 0.25).select("page_id", "idx"), f"{WITH} SELECT page_id, idx FROM det WHERE engine = 'paddle' AND 64 BETWEEN x1 AND x2 AND 64 BETWEEN y1 AND y2")
add("J15_ward_of_city", lambda s, d: html.with_ward(files(s, d).select(F.col("file_id").alias("page_id"), "city", F.concat("city", F.lit(" "), "district").alias("navi")), files(s, d).select("city", F.col("district").alias("ward"), F.lit(1).alias("ord")).distinct()).select("page_id", "district"), f"{WITH} SELECT file_id AS page_id, district FROM files")
add("D20_merged_lines", lambda s, d: spatial.merged_lines(detections(s, d)).groupBy("page_id").agg(F.count("*").alias("lines"), F.sum("line_count").alias("members")))
add("K08_download_plan", lambda s, d: tables.missing_downloads(files(s, d).select(F.concat(F.lit("http://x/"), "path").alias("url"), "path"), files(s, d).filter("file_id % 2 = 0").select("path")).select("url", "path"), f"{WITH} SELECT 'http://x/' || path AS url, path FROM files WHERE file_id % 2 <> 0")
_LAID = "CASE WHEN balance < 0 THEN prefecture || '/' || district || '/' || filename || '.pdf' ELSE path END"
add("K11_misplaced_files", lambda s, d: hierarchy.moves(files(s, d).selectExpr(f"{_LAID} AS path"), files(s, d).select("prefecture", "city", F.col("district").alias("ward"), F.dense_rank().over(Window.partitionBy("prefecture").orderBy("city")).alias("ord")).distinct()), f"{WITH}, c AS (SELECT prefecture, district, min(city) AS city FROM files GROUP BY 1, 2), l AS (SELECT {_LAID} AS path, filename FROM files) SELECT path, prefecture || '/' || c.city || '/' || district || '/' || filename || '.pdf' AS target FROM l JOIN c ON split_part(path, '/', 1) = prefecture AND split_part(path, '/', 2) = district")
add("K13_label_geometry", lambda s, d: detections(s, d).select("page_id", "idx", F.concat("text", F.lit(" ("), F.col("w").cast("string"), F.lit(")")).alias("label"), F.when(F.col("kind") == "circle", "red").otherwise("green").alias("colour"), F.greatest(F.lit(0), F.col("y1") - 5).alias("label_y")), f"{WITH} SELECT page_id, idx, text || ' (' || w || ')' AS label, CASE WHEN kind = 'circle' THEN 'red' ELSE 'green' END AS colour, greatest(0, y1 - 5) AS label_y FROM det")
add("R01_expiring_entries", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")).select("user_id", (F.col("last") + F.expr("INTERVAL 3600 SECONDS")).alias("expires_at")), "SELECT user_id, max(ts) + INTERVAL 3600 SECOND AS expires_at FROM events GROUP BY 1")
add("S13_region_files", lambda s, d: D.roi_files(files(s, d).select(F.concat(F.lit("roi/circle_"), F.col("file_id").cast("string"), F.lit("_original.jpg")).alias("path"))).select("path", "number"), f"{WITH} SELECT 'roi/circle_' || file_id || '_original.jpg' AS path, CAST(file_id AS STRING) AS number FROM files")
add("S22_mock_rows", lambda s, d: D.mock_rows(s, 600, 800), "SELECT text, CAST(x AS INT) AS x1, CAST(y AS INT) AS y1, CAST(x + 200 AS INT) AS x2, CAST(y + 30 AS INT) AS y2, 0.8::DOUBLE AS confidence, 'Mock' AS method FROM (VALUES ('六本木１丁目88-7', 50, 50), ('川合３丁目120E', 350, 50), ('東京都港区', 50, 450), ('示例地址123', 350, 450)) AS t(text, x, y)")
add("Y07_patch_search", lambda s, d: search.ratio_search(texts(s, d), "thing", contained=True).select("page_id", "similarity"))
add("Y07_contained", lambda s, d: search.ratio_search(table(s, d, "benchmark").withColumnRenamed("item_id", "page_id").withColumn("idx", F.lit(1)), "thing", contained=True).filter("similarity = 1").select("page_id"), "SELECT item_id AS page_id FROM benchmark WHERE contains(text, 'thing')")
add("Y07_contained_documents", lambda s, d: search.ratio_search(texts(s, d), "thing", contained=True).filter("similarity = 1").select("page_id"), "SELECT doc_id AS page_id FROM documents WHERE contains(text, 'thing')")
add("T07_original_kept", lambda s, d: detections(s, d).select("page_id", "idx", T.corrected(F.col("text"), F.col("confidence")).alias("c")).select("page_id", "idx", "c.original_text"), f"{WITH} SELECT page_id, idx, text AS original_text FROM det")
add("A20_per_place", lambda s, d: statistics.per_group(files(s, d), ["prefecture"], "file_id").select("prefecture", "n", "least", "most"), f"{WITH} SELECT prefecture, count(*) AS n, min(file_id) AS least, max(file_id) AS most FROM files GROUP BY 1")


def _recreated(s, d):
    at = storage.shared_path(s, "k03")
    tables.recreate(files(s, d).filter("prefecture = 'ASIA'").select("path", "prefecture"), at)
    return tables.recreate(files(s, d).select("path", "prefecture"), at)


add("K03_recreated_table", _recreated, f"{WITH} SELECT path, prefecture FROM files")
add("A14_graph_summary", lambda s, d: spatial.graph_summary(detections(s, d), spatial.near_edges(detections(s, d), 60.0)).select("page_id", "nodes", "edges", "components"), f"{REACH}, m AS (SELECT page_id, count(*) // 2 AS edges FROM e GROUP BY 1) SELECT comp.page_id, count(*) AS nodes, coalesce(any_value(m.edges), 0)::BIGINT AS edges, count(DISTINCT component) AS components FROM comp LEFT JOIN m ON m.page_id = comp.page_id GROUP BY 1")
add("R03_bounded_history", lambda s, d: tables.bounded_history(table(s, d, "events"), ["event_type"], [F.col("ts"), F.col("event_id")]).select("event_id"), "SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS spot FROM events) WHERE n <= 1000 OR spot > n - 500")


def _file(s, folder, name, content):
    storage.write_file(s, f"{folder}/{name}", content)


def _scanned_tree(s, d):
    """An empty file in every district's directory, found again by a scan; the districts are few."""
    root = storage.shared_path(s, "s01")
    for r in files(s, d).select("prefecture", "city", "district").distinct().collect():
        _file(s, root, f"{r.prefecture}/{r.city}/{r.district}/index.pdf", b"%PDF-")
        _file(s, root, f"{r.prefecture}/{r.city}/note.txt", b"")
    return hierarchy.scan(s, root).select("prefecture", "city", "district", "filename", "full_address", "file_size")


add("S01_scanned_tree", _scanned_tree, f"{WITH} SELECT DISTINCT prefecture, city, district, 'index.pdf' AS filename, prefecture || city || district AS full_address, 5::BIGINT AS file_size FROM files")


def _scanned_regions(s, d):
    root = storage.shared_path(s, "s13")
    for r in table(s, d, "nation").select("n_nationkey").collect():
        _file(s, root, f"circle_{r.n_nationkey}_original.jpg", b"\xff\xd8")
        _file(s, root, f"circle_{r.n_nationkey}_crop.jpg", b"\xff\xd8")
    return D.roi_files(images.read(s, root).select("path")).select("name", "number")


add("S13_scanned_regions", _scanned_regions, "SELECT 'circle_' || n_nationkey || '_original.jpg' AS name, CAST(n_nationkey AS VARCHAR) AS number FROM nation")


def _image_files(s, d):
    root = storage.shared_path(s, "s10")
    for r in table(s, d, "nation").select("n_nationkey").collect():
        k = int(r.n_nationkey)
        _file(s, root, f"{k}.png", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 10 + k, 20 + k))
        _file(s, root, f"{k}.gif", b"GIF89a" + struct.pack("<HH", 30 + k, 40 + k))
        _file(s, root, f"{k}.jpg", b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 50 + k, 60 + k) + b"\x03" * 9)
        _file(s, root, f"{k}.bmp", b"BM broken")
    return images.sized(images.read(s, root)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "kind", "width", "height")


add("S10_image_files", _image_files, "SELECT n_nationkey || '.' || e AS name, CASE e WHEN 'jpg' THEN 'jpeg' WHEN 'bmp' THEN NULL ELSE e END AS kind, CAST(CASE e WHEN 'png' THEN 10 WHEN 'gif' THEN 30 WHEN 'jpg' THEN 60 END + n_nationkey AS INT) AS width, CAST(CASE e WHEN 'png' THEN 20 WHEN 'gif' THEN 40 WHEN 'jpg' THEN 50 END + n_nationkey AS INT) AS height FROM nation, (VALUES ('png'), ('gif'), ('jpg'), ('bmp')) AS t(e)")


def _sqlite_rows(s, d):
    root = storage.shared_path(s, "s14")
    for key, rows in table(s, d, "nation").select("n_regionkey", "n_nationkey", "n_name").toPandas().groupby("n_regionkey"):
        _file(s, root, f"region_{key}.db", sqlite.dump({"nation": rows}))
    return sqlite.read(s, root, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 3 ORDER BY n_name", "n_nationkey long, n_name string")


add("S14_sqlite_rows", _sqlite_rows, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey > 3")
add("U04_adapted_thresholds", lambda s, d: vision.adapted_thresholds(pages(s, d).selectExpr("page_id", "page_id % 256 AS mean_brightness", "page_id % 200 AS contrast", "CAST(1000 + page_id % 2000 AS INT) AS width", "1000 AS height")).select("page_id", rounded(F.col("confidence_threshold"), 6).alias("confidence"), rounded(F.col("overlap_threshold"), 6).alias("overlap"), "max_detections"), f"{WITH} SELECT page_id, CASE WHEN page_id % 256 < 100 THEN 0.45 WHEN page_id % 256 > 200 THEN 0.55 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN page_id % 200 < 100 THEN 0.27 ELSE 0.3 END::DOUBLE AS overlap, CASE WHEN page_id % 2000 > 1000 THEN 1500 ELSE 1000 END AS max_detections FROM pg")
# names with a last character in one of three encodings; the names themselves are ASCII
_ENCODED = "concat(encode(district, 'UTF-8'), CASE file_id % 3 WHEN 0 THEN X'8BE6' WHEN 1 THEN X'E4B881' ELSE X'B6E8' END)"
_DECODED = f"{WITH} SELECT file_id, district || CASE file_id % 3 WHEN 1 THEN '丁' ELSE '区' END AS name FROM files"
add("S15_decoded_names", lambda s, d: files(s, d).select("file_id", html.decoded(F.expr(_ENCODED)).alias("name")), _DECODED)
add("S16_decoded_index_names", lambda s, d: files(s, d).select("file_id", html.decoded_japanese(F.expr(_ENCODED)).alias("name")), _DECODED)
