"""Queries of spatial joins, matching and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapsieve.operators import pipeline, spatial
from mapsieve.operators.statistics import rounded
from mapsieve.plans.derived import WITH, detections
from mapsieve.plans.queries_page import R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _circles(s, d):
    return detections(s, d).filter("kind = 'circle'").select("page_id", "idx", "cx", "cy", "radius")


def _texts(s, d):
    return detections(s, d).filter("kind = 'text'").select("page_id", "idx", "cx", "cy", "w", "h", "text")


_DIST = "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))"
_FOLD = "least(abs(degrees(atan2(b.cy - a.cy, b.cx - a.cx))) % 90, 90 - abs(degrees(atan2(b.cy - a.cy, b.cx - a.cx))) % 90)"
_CONF = f"(greatest(0.0::DOUBLE, 1 - {_DIST} / 100) * 0.5::DOUBLE + CASE WHEN {_FOLD} <= 30 THEN 1 - {_FOLD} / 30 * 0.3::DOUBLE ELSE 1.0::DOUBLE END * 0.3::DOUBLE + CASE WHEN least(b.w, b.h) / (a.radius * 2) BETWEEN 0.3 AND 2.0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END * 0.2::DOUBLE)"
_REL = f"{WITH}, rel AS (SELECT a.page_id, a.idx AS circle, b.idx AS txt, {_DIST} AS dist, {_CONF} AS conf FROM det a JOIN det b ON a.page_id = b.page_id AND a.kind = 'circle' AND b.kind = 'text' AND {_DIST} <= 100)"


def _relations(s, d):
    return spatial.circle_text_relations(_circles(s, d), _texts(s, d))


add("J03_circle_text", lambda s, d: _relations(s, d).select(F.col("a_page_id").alias("page_id"), F.col("a_idx").alias("circle"), F.col("b_idx").alias("txt"), rounded(F.col("confidence"), 6).alias("conf"), "relationship"), f"{_REL} SELECT page_id, circle, txt, {R('conf')} AS conf, CASE WHEN dist <= 30 THEN 'adjacent' WHEN dist <= 60 THEN 'nearby' ELSE 'distant' END AS relationship FROM rel WHERE conf > 0.3")
add("J04_near_edges", lambda s, d: spatial.near_edges(detections(s, d), 60.0).select("page_id", "a", "b", rounded(F.col("strength"), 6).alias("strength")), f"{WITH} SELECT a.page_id, a.idx AS a, b.idx AS b, {R('1 - ' + _DIST + ' / 60')} AS strength FROM det a JOIN det b ON a.page_id = b.page_id AND a.idx < b.idx AND {_DIST} <= 60")
add("J05_within_radius", lambda s, d: spatial.within_radius(detections(s, d), 100.0, 100.0, 25.0).select("page_id", "idx"), f"{WITH} SELECT page_id, idx FROM det WHERE sqrt((cx - 100) * (cx - 100) + (cy - 100) * (cy - 100)) <= 25")
add("J06_greedy_match", lambda s, d: spatial.match_greedily(_relations(s, d).select(F.col("a_page_id").alias("page_id"), F.col("a_idx").alias("circle"), F.col("b_idx").alias("txt"), rounded(F.col("confidence"), 6).alias("conf")), "page_id", "circle", "txt", "conf"))
add("J07_has_circle", lambda s, d: spatial.with_existence(detections(s, d).select("page_id", "idx", "x1", "y1", "x2", "y2"), _circles(s, d), "page_id", "idx", "has_circle").select("page_id", "idx", "has_circle"), f"{WITH} SELECT page_id, idx, EXISTS (SELECT 1 FROM det c WHERE c.page_id = det.page_id AND c.kind = 'circle' AND c.cx BETWEEN det.x1 AND det.x2 AND c.cy BETWEEN det.y1 AND det.y2) AS has_circle FROM det")
_SQUARE = "array(array(cx - 40, cy - 40), array(cx + 40, cy - 40), array(cx + 40, cy + 40), array(cx - 40, cy + 40))"


def _regions(s, d):
    return detections(s, d).filter("is_number").selectExpr("page_id", "idx AS region_id", f"{_SQUARE} AS contour")


def _roads(s, d):
    return detections(s, d).filter("engine = 'paddle'").selectExpr("page_id", "idx", "x1", "y1", "x2", "y2")


_PSEG = "(SELECT min(sqrt((p.cx - (r.x1 + t * (r.x2 - r.x1))) * (p.cx - (r.x1 + t * (r.x2 - r.x1))) + (p.cy - (r.y1 + t * (r.y2 - r.y1))) * (p.cy - (r.y1 + t * (r.y2 - r.y1))))) FROM (SELECT q.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((p.cx - q.x1) * (q.x2 - q.x1) + (p.cy - q.y1) * (q.y2 - q.y1)) / ((q.x2 - q.x1) * (q.x2 - q.x1) + (q.y2 - q.y1) * (q.y2 - q.y1)))) AS t FROM det q WHERE q.engine = 'paddle' AND q.page_id = p.page_id) r)"
add("J09_containing_region", lambda s, d: spatial.containing_region(detections(s, d).select("page_id", "idx", "cx", "cy"), _regions(s, d), "page_id", "idx").select("page_id", "idx", "region_id"), f"{WITH} SELECT p.page_id, p.idx, (SELECT min(r.idx) FROM det r WHERE r.page_id = p.page_id AND r.is_number AND abs(r.cx - p.cx) <= 40 AND abs(r.cy - p.cy) <= 40) AS region_id FROM det p")
add("J10_road_distance", lambda s, d: spatial.road_distance(detections(s, d).select("page_id", "idx", "cx", "cy"), _roads(s, d), "page_id", "idx").select("page_id", "idx", rounded(F.when(F.col("road_distance") < 1e9, F.col("road_distance")).otherwise(-1.0), 4).alias("road")), f"{WITH} SELECT p.page_id, p.idx, {R('coalesce(' + _PSEG + ', -1)', 4)} AS road FROM det p")
add("J13_text_of_circle", lambda s, d: spatial.text_of_circle(_circles(s, d), _texts(s, d), "page_id", "idx").select("page_id", "idx", "circle_text"), f"{WITH} SELECT a.page_id, a.idx, (SELECT first(b.text ORDER BY b.idx) FROM det b WHERE b.page_id = a.page_id AND b.kind = 'text' AND {_DIST} < a.radius * 1.5::DOUBLE) AS circle_text FROM det a WHERE a.kind = 'circle'")
REACH = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + f", e AS (SELECT a.page_id, a.idx AS x, b.idx AS y FROM det a JOIN det b ON a.page_id = b.page_id AND a.idx <> b.idx AND {_DIST} <= 60), reach AS (SELECT page_id, idx, idx AS seen FROM det UNION SELECT r.page_id, r.idx, e.y FROM reach r JOIN e ON e.page_id = r.page_id AND e.x = r.seen), comp AS (SELECT page_id, idx, min(seen) AS component, count(DISTINCT seen) AS n FROM reach GROUP BY 1, 2)"
add("G02_components", lambda s, d: spatial.components(detections(s, d), spatial.near_edges(detections(s, d), 60.0)), f"{REACH} SELECT page_id, idx, component FROM comp")
add("G01_dbscan", lambda s, d: spatial.dbscan(detections(s, d), 60.0).select("page_id", "idx", "cluster"), f"{REACH}, c AS (SELECT page_id, component, row_number() OVER (PARTITION BY page_id ORDER BY component) - 1 AS cluster FROM (SELECT DISTINCT page_id, component FROM comp WHERE n > 1)) SELECT comp.page_id, comp.idx, CAST(coalesce(c.cluster, -1) AS INT) AS cluster FROM comp LEFT JOIN c ON c.page_id = comp.page_id AND c.component = comp.component")
add("A14_degrees", lambda s, d: spatial.near_edges(detections(s, d), 60.0).select("page_id", F.explode(F.array("a", "b")).alias("idx")).groupBy("page_id", "idx").agg(F.count("*").alias("degree")), f"{WITH} SELECT a.page_id, a.idx, count(*) AS degree FROM det a JOIN det b ON a.page_id = b.page_id AND a.idx <> b.idx AND {_DIST} <= 60 GROUP BY 1, 2")
add("B11_spatial_analysis", lambda s, d: pipeline.spatial_analysis(detections(s, d).select("page_id", "idx", "cx", "cy", "text", "confidence", F.when(F.col("is_number"), "block_number").otherwise("route_price").alias("type")), _roads(s, d), _regions(s, d)).select("page_id", "idx", "spatial_type", "is_valid", rounded(F.col("spatial_confidence"), 6).alias("confidence")))
add("J12_address_price_pairs", lambda s, d: spatial.address_price_pairs(_circles(s, d).select("page_id", "idx", "cx", "cy"), _texts(s, d).select("page_id", "idx", "cx", "cy")).select("page_id", "address", "price", "relation"), f"{WITH} SELECT a.page_id, a.idx AS address, b.idx AS price, CASE WHEN {_DIST} < 100 THEN 'near' ELSE 'far' END AS relation FROM det a JOIN det b ON a.page_id = b.page_id AND a.kind = 'circle' AND b.kind = 'text'")
add("G04_ranked_relations", lambda s, d: spatial.ranked_relations(_relations(s, d).withColumn("confidence", rounded(F.col("confidence"), 6)).withColumn("distance", rounded(F.col("distance"), 6))).select(F.col("a_page_id").alias("page_id"), F.col("a_idx").alias("circle"), F.col("b_idx").alias("txt"), "place"), f"{_REL} SELECT page_id, circle, txt, row_number() OVER (PARTITION BY page_id ORDER BY {R('conf')} DESC, {R('dist')}, circle, txt) AS place FROM rel WHERE conf > 0.3")
_CROSS = "l AS (SELECT page_id, idx, x1, y1, x2, y2 FROM det WHERE engine = 'paddle'), m AS (SELECT a.page_id, a.idx AS a, b.idx AS b, a.x1, a.y1, a.x2, a.y2, nullif(((a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2))::DOUBLE, 0) AS d, (a.x1 - b.x1) * (b.y1 - b.y2) - (a.y1 - b.y1) * (b.x1 - b.x2) AS t, -((a.x1 - a.x2) * (a.y1 - b.y1) - (a.y1 - a.y2) * (a.x1 - b.x1)) AS u FROM l a JOIN l b ON a.page_id = b.page_id AND a.idx < b.idx)"
add("J11_crossings", lambda s, d: spatial.crossings(_roads(s, d), "page_id", "idx"), f"{WITH}, {_CROSS} SELECT page_id, a, b, CAST(trunc(x1 + t / d * (x2 - x1)) AS INT) AS x, CAST(trunc(y1 + t / d * (y2 - y1)) AS INT) AS y FROM m WHERE t / d BETWEEN 0 AND 1 AND u / d BETWEEN 0 AND 1")
