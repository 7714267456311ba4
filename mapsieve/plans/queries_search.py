"""Queries of searches, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapsieve.functions import text as T
from mapsieve.operators import search, vision
from mapsieve.plans.derived import WITH, detections, files, table, texts
from mapsieve.sources import hierarchy, html

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


key = ("page_id", "idx")
add("F01_by_location", lambda s, d: search.by_location(files(s, d), "ASIA", "", "BUILDING").select("path"), f"{WITH} SELECT path FROM files WHERE prefecture = 'ASIA' AND district = 'BUILDING'")
add("F02_like_search", lambda s, d: search.like_search(detections(s, d), "1_a").select(*key, "text"), f"{WITH} SELECT page_id, idx, text FROM det WHERE text ILIKE '%1_a%' ORDER BY confidence DESC, page_id, idx LIMIT 100")
add("F03_contains_search", lambda s, d: search.contains_search(detections(s, d), "5c").select(*key), f"{WITH} SELECT page_id, idx FROM det WHERE contains(lower(text), '5c')")
add("F06_distinct_places", lambda s, d: files(s, d).select("prefecture", "city").distinct(), f"{WITH} SELECT DISTINCT prefecture, city FROM files")
add("S02_folder_index", lambda s, d: hierarchy.folders(files(s, d)), f"{WITH} SELECT DISTINCT prefecture, city, district, prefecture || ' ' || city || ' ' || district AS display_name FROM files")
add("S01_located_paths", lambda s, d: hierarchy.located(files(s, d).select("path")).select("path", "prefecture", "district", "full_address"), f"{WITH} SELECT path, prefecture, district, prefecture || city || district AS full_address FROM files")
add("S03_files_by_district", lambda s, d: hierarchy.files_by_district(files(s, d)).select("prefecture", "city", "district", F.size("paths").alias("n"), F.col("paths")[0].alias("first")), f"{WITH} SELECT prefecture, city, district, CAST(count(*) AS INT) AS n, min(path) AS first FROM files GROUP BY 1, 2, 3")
add("S04_four_way_index", lambda s, d: hierarchy.four_way_index(files(s, d))["cities"].select("prefecture", F.explode("cities").alias("city")), f"{WITH} SELECT DISTINCT prefecture, city FROM files")
add("S05_suffix_location", lambda s, d: files(s, d).select("path", hierarchy.suffix_location(F.col("path")).alias("l")).select("path", "l.*"), f"{WITH} SELECT path, prefecture, city, district FROM files")
_SCORE = "(CASE WHEN prefecture = 'ASIA' THEN 40 WHEN contains(prefecture, 'ASIA') THEN 30 ELSE 0 END + CASE WHEN starts_with(prefecture, 'ASIA') THEN 5 ELSE 0 END + CASE WHEN city = 'IN' THEN 35 WHEN contains(city, 'IN') THEN 25 ELSE 0 END + CASE WHEN starts_with(city, 'IN') THEN 5 ELSE 0 END + CASE WHEN district = 'BUILDING' THEN 25 WHEN contains(district, 'BUILDING') THEN 15 ELSE 0 END + CASE WHEN starts_with(district, 'BUILDING') THEN 5 ELSE 0 END)"
_WANT = {"prefecture": "ASIA", "city": "IN", "district": "BUILDING"}
add("Y06_hierarchical_search", lambda s, d: search.hierarchical_search(files(s, d), _WANT).select("path", "score"), f"{WITH} SELECT path, {_SCORE} AS score FROM files WHERE {_SCORE} > 0 ORDER BY score DESC, path LIMIT 50")
add("Y06_match_details", lambda s, d: search.match_details(files(s, d), _WANT).select("path", "prefecture_match", "city_match", "district_match"), f"{WITH} SELECT path, CASE WHEN prefecture = 'ASIA' THEN 'exact' WHEN contains(prefecture, 'ASIA') THEN 'partial' ELSE 'none' END AS prefecture_match, CASE WHEN city = 'IN' THEN 'exact' WHEN contains(city, 'IN') THEN 'partial' ELSE 'none' END AS city_match, CASE WHEN district = 'BUILDING' THEN 'exact' WHEN contains(district, 'BUILDING') THEN 'partial' ELSE 'none' END AS district_match FROM files")
add("B05_fuzzy_search", lambda s, d: search.fuzzy_search(texts(s, d), "thing and", 70.0).select("page_id", "similarity"))
add("B06_fuzzy_exclusive", lambda s, d: search.fuzzy_search(texts(s, d), "thing and", 50.0, 50, True).select("page_id", "similarity"))
add("B07_ratio_search", lambda s, d: search.ratio_search(texts(s, d), "the thing and the other thing", 0.3, 12).select("page_id", "similarity"))
add("O06_limit_first", lambda s, d: search.ratio_search(texts(s, d), "the thing and the other thing", 0.1, 12, True).select("page_id", "similarity"))
_HITS = f"{WITH}, h AS (SELECT *, kind = 'circle' AND (regexp_matches(trim(text), '^[0-9]{{1,4}}$') OR (length(trim(text)) <= 2 AND regexp_matches(trim(text), '[^\\x00-\\x7f]'))) AS strict FROM det WHERE contains(lower(text), '7'))"
add("O04_quota_numeric", lambda s, d: search.quota_search(detections(s, d).withColumn("type", F.col("kind")), "7").select(*key), f"{_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY strict ORDER BY confidence DESC, page_id, idx) AS n, bool_or(strict) OVER () AS any_s FROM h) SELECT page_id, idx FROM r WHERE NOT any_s OR n <= 2 ORDER BY strict DESC, confidence DESC, page_id, idx LIMIT 4")
add("O04_circle_only", lambda s, d: search.quota_search(detections(s, d).withColumn("type", F.col("kind")), "7", True).select(*key), f"{_HITS} SELECT page_id, idx FROM h WHERE strict ORDER BY confidence DESC, page_id, idx LIMIT 4")
add("O04_plain", lambda s, d: search.quota_search(detections(s, d).withColumn("type", F.col("kind")), "7a").select(*key), f"{WITH}, h AS (SELECT *, kind = 'circle' AND regexp_matches(text, '^[0-9]{{1,4}}$') AS strict FROM det WHERE contains(lower(text), '7a')) SELECT page_id, idx FROM h ORDER BY strict DESC, confidence DESC, page_id, idx LIMIT 4")
add("O03_top_k", lambda s, d: detections(s, d).orderBy(F.desc("confidence"), *key).limit(50).select(*key), f"{WITH} SELECT page_id, idx FROM det ORDER BY confidence DESC, page_id, idx LIMIT 50")
add("X01_union_all", lambda s, d: detections(s, d).filter("engine = 'paddle'").select(*key).unionByName(detections(s, d).filter("is_number").select(*key)), f"{WITH} SELECT page_id, idx FROM det WHERE engine = 'paddle' UNION ALL SELECT page_id, idx FROM det WHERE is_number")
add("X04_fallback_union", lambda s, d: vision.with_fallback(detections(s, d).filter("engine = 'paddle'"), detections(s, d).filter("engine = 'easyocr'"), 2).select(*key), f"{WITH}, f AS (SELECT page_id FROM det WHERE engine = 'paddle' GROUP BY 1 HAVING count(*) >= 2) SELECT page_id, idx FROM det WHERE engine = 'paddle' UNION ALL SELECT page_id, idx FROM det WHERE engine = 'easyocr' AND page_id NOT IN (SELECT page_id FROM f)")
add("X05_first_engine", lambda s, d: vision.first_engine(detections(s, d), ["tesseract", "paddle", "easyocr"]).select(*key), f"{WITH}, r AS (SELECT *, list_position(['tesseract', 'paddle', 'easyocr'], engine) AS p FROM det) SELECT page_id, idx FROM r QUALIFY p = min(p) OVER (PARTITION BY page_id)")
add("J14_city_in_query", lambda s, d: files(s, d).filter(F.lit("all of FRANCE and JAPAN").contains(F.col("city"))).agg(F.min("city").alias("city")), f"{WITH} SELECT min(city) AS city FROM files WHERE contains('all of FRANCE and JAPAN', city)")
add("T04_address_parser", lambda s, d: s.createDataFrame([tuple(T.parse_address("大阪府 吹田市 藤白台1丁目").values()), tuple(T.parse_address("東京都港区芝", ("中央区", "港区")).values())], "prefecture string, city string, district string"), "SELECT * FROM (VALUES ('大阪府', '吹田市', '藤白台1丁目'), ('東京都', '港区', '芝')) AS t(prefecture, city, district)")
_LINK = "<a\\b[^>]*\\bhref\\s*=\\s*\"([^\"]*)\"[^>]*>(.*?)</a>"
add("S17_links", lambda s, d: html.links(table(s, d, "pages")).select("page_id", "pos", "href"), f"WITH t AS (SELECT page_id, regexp_extract_all(html, '(?is){_LINK}', 1) AS h FROM pages) SELECT page_id, CAST(unnest(generate_series(0, len(h) - 1)) AS INT) AS pos, unnest(h) AS href FROM t")
add("S17_base_names", lambda s, d: html.links(table(s, d, "pages")).groupBy(html.base_name(F.col("href")).alias("name")).agg(F.count("*").alias("n")), f"WITH t AS (SELECT unnest(regexp_extract_all(html, '(?is){_LINK}', 1)) AS href FROM pages) SELECT string_split(href, '/')[-1] AS name, count(*) AS n FROM t GROUP BY 1")
add("S19_url_map", lambda s, d: html.url_map(files(s, d).groupBy().agg(F.create_map(F.lit("r07"), F.map_from_entries(F.collect_set(F.struct("prefecture", F.lower("prefecture"))))).alias("mapping"))), f"{WITH} SELECT DISTINCT 'r07' AS year, prefecture, lower(prefecture) AS path FROM files")
add("F05_most_specific_city", lambda s, d: search.most_specific(files(s, d), "AMERICA", "NATION_11").select("path"), f"{WITH} SELECT path FROM files WHERE prefecture = 'AMERICA' AND city = 'NATION_11'")
add("F05_most_specific_district", lambda s, d: search.most_specific(files(s, d), "AMERICA", "NATION_11", "BUILDING").select("path"), f"{WITH} SELECT path FROM files WHERE prefecture = 'AMERICA' AND city = 'NATION_11' AND district = 'BUILDING'")
add("Y05_folder_names", lambda s, d: search.folder_search(hierarchy.folders(files(s, d)).withColumn("path", F.col("display_name")), "nation_11 building"))
_LEVELS = "concat('<html><head>', if(file_id % 3 > 0, concat('<title>map of<b> ', city, '市 and more</b></title>'), ''), '</head><body>', if(file_id % 2 = 0, concat('<div class=\"navi navi__level\"><a>', district, '区</a></div>'), ''), '<h1>', prefecture, '町</h1></body></html>')"
add("S18_place_of_sheet", lambda s, d: files(s, d).select("file_id", F.expr(_LEVELS).alias("html")).select("file_id", F.trim(html.place_of_page(F.col("html"))).alias("place")), f"{WITH} SELECT file_id, CASE WHEN file_id % 2 = 0 THEN district || '区' WHEN file_id % 3 > 0 THEN 'map of ' || city || '市' ELSE prefecture || '町' END AS place FROM files")
