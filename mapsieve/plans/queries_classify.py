"""Queries of text classes, text transforms, filters and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapsieve.functions import geometry, scores, similarity
from mapsieve.functions import text as T
from mapsieve.operators import filters, pipeline
from mapsieve.operators.statistics import rounded
from mapsieve.plans.derived import WITH, detections, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def classes(name, kind, sql_case):
    add(name, lambda s, d: detections(s, d).groupBy(kind().alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.5).alias("sure")), f"{WITH} SELECT {sql_case} AS kind, count(*) AS n, count(*) FILTER (confidence > 0.5) AS sure FROM det GROUP BY 1")


def _cases(rules, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE {otherwise} END"


_STAGE5 = (("block_number", "^[0-9]{1,3}$"), ("route_price", "^[0-9]{1,4}[A-G]$"), ("complex_number", "^[0-9]{1,3}-[0-9]{1,3}[A-G]?$"), ("price_with_unit", "^[0-9]{1,4}万?[A-G]?$"), ("reference_code", "^[A-Z][0-9]{1,3}$"), ("pure_number", "^[0-9]+$"))
STAGE5_CASE = _cases((*_STAGE5, ("single_letter", "^[A-Za-z]$"), ("complex_identifier", "[-/]")), "'unknown'")
FORMAT_CASE = _cases((("block_number", "^[0-9]{1,3}$"), ("route_price", "^[0-9]{1,4}[A-G]$"), ("complex_address", "^[0-9]{1,3}-[0-9]{1,3}[A-G]?$"), ("reference", "^[A-Z][0-9]{1,3}$"), ("partial_number", "^[0-9]+$"), ("partial_letter", "^[A-G]$")), "'invalid'")
_NUMBER = "regexp_replace(text, '[^0-9A-Za-z_万千,.]', '', 'g')"
_POTENTIAL = f"(regexp_matches({_NUMBER}, '[0-9]') AND (regexp_matches({_NUMBER}, '^[0-9]+[A-Z]?$|^[0-9]+万$|^[0-9]+千$|^[0-9]+[.][0-9]+$|^[0-9]+,[0-9]+$|^[0-9]+[.,][0-9]+万$') OR length(regexp_replace({_NUMBER}, '[^0-9]', '', 'g')) * 2 > length({_NUMBER})))"
CLEAN_NUMBER = f"CASE WHEN regexp_matches({_NUMBER}, '^[0-9]+[A-Z]?$|^[0-9]+万$|^[0-9]+千$|^[0-9]+[.][0-9]+$|^[0-9]+,[0-9]+$|^[0-9]+[.,][0-9]+万$') THEN {_NUMBER} WHEN regexp_matches({_NUMBER}, '[0-9]') THEN regexp_extract({_NUMBER}, '[0-9]+') || regexp_extract({_NUMBER}, '[万千A-Z]') END"

classes("M01_stage5_type", lambda: T.stage5_type(F.col("text")), STAGE5_CASE)
classes("M01_multi_scale_type", lambda: T.stage5_type(F.col("text"), True), _cases((*_STAGE5, ("pure_letter", "^[A-Za-z]+$"), ("complex_identifier", "[-/]")), "'unknown'"))
classes("M02_format_type", lambda: T.format_type(F.col("text")), FORMAT_CASE)
classes("M03_price_text", lambda: T.is_price(F.col("text")), "regexp_matches(text, '^[0-9]{2,3}[A-G]$')")
classes("M04_vector_class", lambda: T.vector_class(F.col("text")), "CASE WHEN regexp_matches(text, '丁目|番地|号|条|町') THEN 'address' WHEN length(text) > 3 AND NOT regexp_matches(text, '[0-9]') THEN 'district' WHEN regexp_matches(text, '^[0-9]{2,3}[A-G]$') THEN 'price' ELSE 'other' END")
classes("M05_boxed_class", lambda: T.boxed_class(F.col("text"), F.col("w"), F.col("h")), "CASE WHEN regexp_matches(text, '^[0-9]+[A-Z]$|^[0-9]{2,3}$') THEN 'price' WHEN regexp_matches(text, '市|区|町|丁目') THEN 'address' WHEN w > h * 3 THEN 'street' ELSE 'other' END")
classes("M06_potential_number", lambda: T.is_potential_number(F.col("text")), _POTENTIAL)
classes("M07_clean_number", lambda: T.clean_number(F.col("text")), CLEAN_NUMBER)
classes("M08_ocr_price", lambda: T.ocr_price(F.col("text")), "CASE WHEN regexp_matches(translate(regexp_replace(text, '\\s', '', 'g'), 'OoIlSGB', '0011568'), '^[0-9]+[A-Z]?$|^[0-9]+万$|^[0-9]+千$') THEN translate(regexp_replace(text, '\\s', '', 'g'), 'OoIlSGB', '0011568') END")
classes("M09_fallback_price", lambda: T.is_fallback_price(F.col("text")), "regexp_matches(text, '^[0-9]+[A-Z]?$|^[0-9]+万$|^[0-9]+千$|^[0-9]+[.][0-9]+$')")
classes("M10_geometry_class", lambda: T.geometry_class(F.col("w"), F.col("h")), "CASE WHEN w / h < 1.5 THEN 'japanese' WHEN w / h < 3 THEN 'numbers' ELSE 'mixed' END")
classes("M11_target_flag", lambda: T.is_target(T.stage5_type(F.col("text"))), f"({STAGE5_CASE}) IN ('block_number', 'route_price', 'complex_number')")
classes("M12_documented_type", lambda: T.documented_type(F.col("text")), _cases((("route_price", "^[0-9]{1,4}[A-G]$"), ("route_price_unit", "^[0-9]{1,4}万[A-G]?$"), ("block_number", "^[0-9]{1,3}$"), ("complex_address", "^[0-9]{1,3}-[0-9]{1,3}$"), ("reference_mark", "^[A-Z][0-9]{1,3}$")), "'unknown'"))
classes("F13_strict_circle", lambda: T.is_strict_circle(F.col("text"), F.col("kind")), "kind = 'circle' AND (regexp_matches(trim(text), '^[0-9]{1,4}$') OR (length(trim(text)) <= 2 AND regexp_matches(trim(text), '[^\\x00-\\x7f]')))")
classes("F14_numeric_query", lambda: T.is_numeric_query(F.col("text")), "regexp_matches(trim(text), '^[0-9]+$')")
classes("F15_valid_address", lambda: T.is_valid_address(F.col("text")), "length(trim(text)) >= 2 AND regexp_matches(text, '[0-9]|丁目|番|号|町|区|市|府|県|丁|地')")
classes("F16_meaningful", lambda: T.is_meaningful(F.col("text")), "length(trim(text)) >= 2 AND (regexp_matches(trim(text), '[0-9]+[-ー][0-9]+|[町丁目番地号]|[0-9]+[A-Z]|[東西南北].*[0-9]|[0-9]{2,}'))")
classes("Y_band", lambda: T.similarity_band(F.col("confidence") * 100), "CASE WHEN confidence * 100 >= 80 THEN 'high' WHEN confidence * 100 >= 60 THEN 'medium' ELSE 'low' END")

_MADE = "'x' || CAST(page_id AS STRING) || '丁目' || CAST(idx AS STRING) || '番' || text"


def _made():
    return F.concat(F.lit("x"), F.col("page_id").cast("string"), F.lit("丁目"), F.col("idx").cast("string"), F.lit("番"), F.col("text"))


add("T01_normalize_address", lambda s, d: detections(s, d).select("page_id", "idx", T.normalize_digits(F.concat(F.lit("１２－"), F.col("text"), F.lit("  二十 "))).alias("normal")), f"{WITH} SELECT page_id, idx, trim(regexp_replace('12-' || translate(text, '０', '0') || '  210 ', '\\s+', ' ', 'g')) AS normal FROM det")
add("T02_address_parts", lambda s, d: detections(s, d).select("page_id", "idx", T.address_parts(_made()).alias("p")).select("page_id", "idx", "p.chome", "p.banchi", "p.go"), f"{WITH} SELECT page_id, idx, CAST(page_id AS STRING) AS chome, CAST(idx AS STRING) AS banchi, CAST(NULL AS STRING) AS go FROM det")
add("T03_sub_district", lambda s, d: detections(s, d).select("page_id", "idx", T.sub_district(_made()).alias("sub")), f"{WITH} SELECT page_id, idx, CAST(page_id AS STRING) || '丁目' || CAST(idx AS STRING) || '番' AS sub FROM det")
add("T05_split_address", lambda s, d: detections(s, d).select("page_id", "idx", T.split_address(F.concat(F.lit("吹田市"), F.col("text"))).alias("a")).select("page_id", "idx", "a.city", "a.district"), f"{WITH} SELECT page_id, idx, '吹田市' AS city, text AS district FROM det")
add("T06_corrected", lambda s, d: detections(s, d).select("page_id", "idx", T.corrected(F.concat(F.lit("O"), F.col("text")), F.col("confidence")).alias("c")).groupBy("c.was_corrected").agg(F.count("*").alias("n")), f"{WITH} SELECT (regexp_matches(left(t, -1), '[0-9]') AND regexp_matches(t, '^[0-9OoIlSZBG]+[0-9A-Z]?$')) AS was_corrected, count(*) AS n FROM (SELECT 'O' || text AS t FROM det) GROUP BY 1")
add("T08_fix_format", lambda s, d: detections(s, d).select("page_id", "idx", T.fix_format(F.concat(F.col("text"), F.lit("!! aaab"))).alias("fixed")), f"{WITH} SELECT page_id, idx, text || 'aB' AS fixed FROM det")
add("T09_strip_digits", lambda s, d: detections(s, d).groupBy(T.strip_digits(F.col("text")).alias("bare")).agg(F.count("*").alias("n")), f"{WITH} SELECT regexp_replace(text, '[0-9]', '', 'g') AS bare, count(*) AS n FROM det GROUP BY 1")
add("T10_merge_texts", lambda s, d: detections(s, d).select("page_id", "idx", T.merge_texts(F.array(F.lit("7"), F.col("w").cast("string"), F.substring(F.col("engine"), 1, 1), F.lit("E"))).alias("merged")), f"{WITH} SELECT page_id, idx, CAST(w AS STRING) || 'E' AS merged FROM det")
add("T11_row_id", lambda s, d: detections(s, d).select("page_id", "idx", T.row_id(F.col("page_id"), F.col("idx"), F.col("text")).alias("id")), f"{WITH} SELECT page_id, idx, md5(CAST(page_id AS STRING) || '_' || CAST(idx AS STRING) || '_' || text) AS id FROM det")
add("T14_json", lambda s, d: detections(s, d).select("page_id", "idx", F.to_json(F.struct("x1", "y1", "text")).alias("json")), f"{WITH} SELECT page_id, idx, '{{\"x1\":' || x1 || ',\"y1\":' || y1 || ',\"text\":\"' || text || '\"}}' AS json FROM det")
add("T01_nfkc_documents", lambda s, d: table(s, d, "documents").select("doc_id", T.normalize_address(F.col("text")).alias("normal")))
add("Y01_sequence_ratio", lambda s, d: table(s, d, "documents").select("doc_id", similarity.sequence_ratio(F.lit("the thing and the other"), F.col("text")).alias("ratio")))
add("Y02_partial_ratio", lambda s, d: table(s, d, "documents").select("doc_id", similarity.partial_ratio(F.lit("thing and"), F.col("text")).alias("ratio")))
add("Y03_contained_or", lambda s, d: detections(s, d).select("page_id", "idx", similarity.contained_or(F.lit("1"), F.col("text"), F.lit(0.0)).alias("score")), f"{WITH} SELECT page_id, idx, CASE WHEN contains(text, '1') OR contains('1', text) THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM det")
add("Y04_char_jaccard", lambda s, d: detections(s, d).select("page_id", "idx", rounded(similarity.char_jaccard(F.col("text"), F.lit("12-3A")), 6).alias("j")), f"{WITH}, c AS (SELECT page_id, idx, text, list_distinct(string_split(text, '')) AS a, list_distinct(string_split('12-3A', '')) AS b FROM det) SELECT page_id, idx, CASE WHEN text = '' THEN 0.0 ELSE floor(CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) * 1000000 + 0.5) / 1000000 END AS j FROM c")

kept = ("page_id", "idx", "text")
add("F07_quality", lambda s, d: filters.quality(detections(s, d)).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE confidence >= 0.5 AND w >= 5 AND h >= 5 AND trim(text) <> '' AND w / h BETWEEN 0.1 AND 10")
NUMBER_REGION = f"confidence >= 0.3 AND w >= 8 AND h >= 8 AND w / h BETWEEN 0.1 AND 5 AND (text = '' OR {_POTENTIAL})"
add("F08_number_regions", lambda s, d: filters.number_regions(detections(s, d)).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE {NUMBER_REGION}")
add("F09_noise", lambda s, d: filters.noise(detections(s, d)).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE length(trim(text)) BETWEEN 1 AND 20 AND confidence >= 0.1")
add("F17_circle_bounds", lambda s, d: filters.circle_bounds(detections(s, d), 220, 210).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE cx BETWEEN 0 AND 219 AND cy BETWEEN 0 AND 209 AND radius BETWEEN 5 AND 100 AND confidence >= 0.3")
add("F18_region_shape", lambda s, d: filters.region_shape(detections(s, d), 500, 1500).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE w * h BETWEEN 500 AND 1500 AND w / h BETWEEN 0.1 AND 10")
add("F19_engine_cutoff", lambda s, d: filters.engine_cutoff(detections(s, d), {"paddle": 0.5, "tesseract": 0.3}, 0.1).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE confidence >= CASE engine WHEN 'paddle' THEN 0.5 WHEN 'tesseract' THEN 0.3 ELSE 0.1 END")
add("F20_contour_area", lambda s, d: filters.contour_area(detections(s, d).withColumn("area", F.col("w") * F.col("h")), 1000).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE w * h BETWEEN 1000 AND 50000")
add("F21_chosen", lambda s, d: filters.chosen(detections(s, d).withColumn("similarity", F.col("confidence")), 0.4, 0.5).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE confidence >= 0.5")
add("F04_number_range", lambda s, d: filters.number_range(detections(s, d), 10, 20).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE try_cast(text AS BIGINT) BETWEEN 10 AND 20")
add("F04_advanced_search", lambda s, d: filters.advanced(detections(s, d).withColumn("filename", F.col("engine")), "^[0-9]", 0.5, False, "paddle").select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE regexp_matches(text, '^[0-9]') AND confidence >= 0.5 AND NOT regexp_matches(text, '^[0-9]+$') AND contains(engine, 'paddle')")
add("F04_in_window", lambda s, d: filters.in_window(detections(s, d), 50, 50, 120, 120).select(*kept), f"{WITH} SELECT page_id, idx, text FROM det WHERE cx BETWEEN 50 AND 120 AND cy BETWEEN 50 AND 120")


def scored(name, column, sql):
    add(name, lambda s, d: detections(s, d).select("page_id", "idx", rounded(column(), 6).alias("score")), f"{WITH}, t AS (SELECT *, {STAGE5_CASE} AS cls FROM det) SELECT page_id, idx, floor(({sql}) * 1000000 + 0.5) / 1000000 AS score FROM t")


_CLS = lambda: T.stage5_type(F.col("text"))
scored("C01_enhanced_score", lambda: scores.enhanced(F.col("confidence"), _CLS(), F.col("text")), "least(confidence * CASE WHEN cls IN ('block_number','route_price') THEN 1.3::DOUBLE WHEN cls = 'complex_number' THEN 1.2::DOUBLE WHEN cls IN ('pure_number','single_letter') THEN 1.1::DOUBLE WHEN cls = 'unknown' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN length(text) BETWEEN 1 AND 6 THEN 1.1::DOUBLE WHEN length(text) > 10 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE)")
scored("C02_multi_scale_score", lambda: scores.multi_scale(F.col("confidence"), _CLS(), F.col("engine")), "least(confidence * CASE WHEN cls IN ('block_number','route_price','price_with_unit') THEN 1.2::DOUBLE WHEN cls = 'unknown' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN contains(engine, 'paddle') THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE)")
scored("C05_comprehensive_score", lambda: scores.comprehensive(F.col("confidence"), F.lit(0.7), _CLS(), F.col("is_number"), F.col("kind") == "circle", F.col("radius") > 20), "least(1.0::DOUBLE, confidence * 0.4::DOUBLE + 0.7::DOUBLE * 0.3::DOUBLE + CASE WHEN cls IN ('block_number','route_price') THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END * 0.2::DOUBLE + least(0.5::DOUBLE + CASE WHEN is_number THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN kind = 'circle' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN radius > 20 THEN 0.2::DOUBLE ELSE 0 END, 1.0::DOUBLE) * 0.1::DOUBLE)")
scored("C06_choice_score", lambda: scores.choice(F.col("confidence"), F.lit(0.5), F.col("is_number"), F.col("kind") == "circle", F.col("radius") > 20), "confidence * 100 + 25 + CASE WHEN is_number THEN 30 ELSE 0 END + CASE WHEN kind = 'circle' THEN 20 ELSE 0 END + CASE WHEN radius > 20 THEN 15 ELSE 0 END")
scored("C07_weighted_confidence", lambda: scores.weighted(F.col("confidence"), F.when(F.col("engine") == "paddle", "textsnake").when(F.col("engine") == "tesseract", "dbnet").otherwise("craft")), "confidence * CASE engine WHEN 'paddle' THEN 0.8::DOUBLE WHEN 'tesseract' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END")

_ISSUES = "(CASE WHEN confidence < 0.3 THEN 1 ELSE 0 END + CASE WHEN length(text) > 15 THEN 1 ELSE 0 END + CASE WHEN fmt = 'invalid' THEN 1 ELSE 0 END + CASE WHEN is_number THEN 1 ELSE 0 END)"
add("F11_quality_control", lambda s, d: filters.passed_quality(detections(s, d).withColumn("issues", scores.quality_issues(F.col("text"), F.col("confidence"), T.format_type(F.col("text")), ~F.col("is_number")))).select("page_id", "idx", F.size("issues").alias("n_issues"), rounded(F.col("quality_score"), 6).alias("q")), f"{WITH}, t AS (SELECT *, {FORMAT_CASE} AS fmt FROM det), u AS (SELECT page_id, idx, {_ISSUES} AS n_issues FROM t) SELECT page_id, idx, n_issues, floor((1.0::DOUBLE - n_issues * 0.2::DOUBLE) * 1000000 + 0.5) / 1000000 AS q FROM u WHERE 1.0::DOUBLE - n_issues * 0.2::DOUBLE >= 0.3")

add("P01_normalized_box", lambda s, d: detections(s, d).select("page_id", "idx", geometry.normalized_box(F.col("x1"), F.col("y1"), F.col("w"), F.col("h"), F.lit(256), F.lit(128)).alias("b")).select("page_id", "idx", "b.*"), f"{WITH} SELECT page_id, idx, x1 / 256 AS nx, y1 / 128 AS ny, w / 256 AS nw, h / 128 AS nh, (x1 + w / 2) / 256 AS ncx, (y1 + h / 2) / 128 AS ncy FROM det")
add("P02_scaled_back", lambda s, d: detections(s, d).select("page_id", "idx", geometry.scaled_back(F.array(F.array(F.col("x1").cast("double"), F.col("y1").cast("double"))), F.lit(2.0)).alias("p")).select("page_id", "idx", F.col("p")[0][0].alias("x"), F.col("p")[0][1].alias("y")), f"{WITH} SELECT page_id, idx, x1 / 2 AS x, y1 / 2 AS y FROM det")
add("P03_rotated_back", lambda s, d: detections(s, d).select("page_id", "idx", geometry.rotated_back(F.col("x1"), F.col("y1"), (F.col("idx") % 4) * 90, F.lit(300), F.lit(400)).alias("p")).select("page_id", "idx", "p.x", "p.y"), f"{WITH} SELECT page_id, idx, CASE idx % 4 WHEN 1 THEN y1 WHEN 2 THEN 300 - x1 WHEN 3 THEN 300 - y1 ELSE x1 END AS x, CASE idx % 4 WHEN 1 THEN 400 - x1 WHEN 2 THEN 400 - y1 WHEN 3 THEN x1 ELSE y1 END AS y FROM det")
add("P05_polygon_to_box", lambda s, d: detections(s, d).select("page_id", "idx", geometry.polygon_box(F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"))).alias("b"), geometry.polygon_area(F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"))).alias("area")).select("page_id", "idx", "b.*", "area"), f"{WITH} SELECT page_id, idx, x1, y1, x2, y2, CAST(w * h AS DOUBLE) AS area FROM det")
add("P06_context_window", lambda s, d: detections(s, d).select("page_id", "idx", geometry.context_window(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(250), F.lit(250), 2.0, 60).alias("b")).select("page_id", "idx", "b.*"), f"{WITH}, t AS (SELECT *, CAST(floor((x1 + x2) / 2) AS BIGINT) AS mx, CAST(floor((y1 + y2) / 2) AS BIGINT) AS my, greatest(60, 2 * w) // 2 AS hw, greatest(60, 2 * h) // 2 AS hh FROM det) SELECT page_id, idx, greatest(0, mx - hw) AS x1, greatest(0, my - hh) AS y1, least(250, mx + hw) AS x2, least(250, my + hh) AS y2 FROM t")
add("P07_padding", lambda s, d: detections(s, d).select("page_id", "idx", geometry.padded(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(230), F.lit(230), F.lit(5)).alias("b")).select("page_id", "idx", "b.*"), f"{WITH} SELECT page_id, idx, greatest(0, x1 - 5) AS x1, greatest(0, y1 - 5) AS y1, least(230, x2 + 5) AS x2, least(230, y2 + 5) AS y2 FROM det")
add("P08_header_height", lambda s, d: detections(s, d).select("page_id", "idx", geometry.header_height(F.col("h") * 10).alias("header")), f"{WITH} SELECT page_id, idx, CAST(trunc(h * 10 * 0.15::DOUBLE) AS INT) AS header FROM det")
add("Gj_tiles", lambda s, d: detections(s, d).select("page_id", "idx", F.explode(geometry.tiles(F.col("w") * 4, F.col("h") * 4, 64, 48, 0.5)).alias("t")).select("page_id", "idx", "t.*"), f"{WITH}, t AS (SELECT page_id, idx, w * 4 AS pw, h * 4 AS ph, unnest(generate_series(0, greatest(0, h * 4 - 1), 48)) AS y FROM det), u AS (SELECT *, unnest(generate_series(0, greatest(0, pw - 1), 48)) AS x FROM t) SELECT page_id, idx, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(least(64, pw - x) AS INT) AS w, CAST(least(64, ph - y) AS INT) AS h FROM u WHERE least(64, pw - x) >= 32 AND least(64, ph - y) >= 32")
add("O09_final_ranking", lambda s, d: pipeline.final_ranking(QUERIES["C05_comprehensive_score"](s, d)).select("page_id", "idx", "place"), f"SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, idx) AS place FROM ({ORACLE_SQL['C05_comprehensive_score']})")
