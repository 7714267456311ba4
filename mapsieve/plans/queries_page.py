"""Queries of page statistics, duplicate suppression, grouping and pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapsieve.functions import geometry as G
from mapsieve.operators import fold, pipeline, statistics
from mapsieve.operators.statistics import rounded
from mapsieve.plans.derived import WITH, detections, pages
from mapsieve.plans.queries_classify import STAGE5_CASE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


R = lambda x, n=6: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
_ENH = "least(confidence * CASE WHEN cls IN ('block_number','route_price') THEN 1.3::DOUBLE WHEN cls = 'complex_number' THEN 1.2::DOUBLE WHEN cls IN ('pure_number','single_letter') THEN 1.1::DOUBLE WHEN cls = 'unknown' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN length(text) BETWEEN 1 AND 6 THEN 1.1::DOUBLE WHEN length(text) > 10 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE)"
_IOU_W = "greatest(0, least(k.x2, c.x2) - greatest(k.x1, c.x1)) * greatest(0, least(k.y2, c.y2) - greatest(k.y1, c.y1))"
_AREA = lambda t: f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
IOU = f"(({_IOU_W})::DOUBLE / ({_AREA('k')} + {_AREA('c')} - {_IOU_W}))"
MIN_OVERLAP = f"(({_IOU_W})::DOUBLE / least({_AREA('k')}, {_AREA('c')}))"
FAR = "sqrt((k.cx - c.cx) * (k.cx - c.cx) + (k.cy - c.cy) * (k.cy - c.cy))"


def fold_sql(hit: str, order: str, where: str = "true", better: str | None = None, source: str = "det", fields: str = "") -> str:
    """A recursive query that holds each row of a page against the list of kept ones, in order."""
    cols = "idx, x1, y1, x2, y2, cx, cy, radius, confidence, text, engine, is_number" + fields
    pack = "struct_pack(" + ", ".join(f"{x.strip()} := r.{x.strip()}" for x in cols.split(",")) + ")"
    first = f"list_position(list_transform(f.kept, lambda k: coalesce({hit.replace('c.', 'r.')}, false)), true)"
    grown = f"list_append(f.kept, {pack})"
    if better is None:
        step = f"CASE WHEN coalesce({first}, 0) = 0 THEN {grown} ELSE f.kept END"
    else:
        swap = f"list_transform(f.kept, lambda k, i: CASE WHEN i = {first} AND ({better.replace('c.', 'r.')}) THEN {pack} ELSE k END)"
        step = f"CASE WHEN coalesce({first}, 0) = 0 THEN {grown} ELSE {swap} END"
    return (
        WITH.replace("WITH ", "WITH RECURSIVE ", 1)
        + f", r0 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS rn FROM {source} WHERE {where}), "
        f"f AS (SELECT page_id, 1::BIGINT AS rn, [{pack}] AS kept FROM r0 AS r WHERE rn = 1 UNION ALL SELECT f.page_id, r.rn, {step} FROM f JOIN r0 AS r ON r.page_id = f.page_id AND r.rn = f.rn + 1), "
        "ends AS (SELECT page_id, arg_max(kept, rn) AS kept FROM f GROUP BY page_id) SELECT page_id, unnest(list_transform(kept, lambda k: k.idx)) AS idx FROM ends"
    )


def dedupe(name, order, order_sql, hit, hit_sql, better=None, better_sql=None, where="true"):
    add(name, lambda s, d: fold.greedy_dedupe(detections(s, d).filter(where), ["page_id"], order(), hit, better).select("page_id", "idx"), fold_sql(hit_sql, order_sql, where, better_sql))


_BY_CONF, _BY_IDX, _BY_AREA = (lambda: [F.desc("confidence"), F.col("idx")]), (lambda: [F.col("idx")]), (lambda: [F.desc(F.col("w") * F.col("h")), F.col("idx")])
_FAR = lambda k, r: G.distance(k["cx"], k["cy"], r["cx"], r["cy"])
_MORE = lambda n, k: n["confidence"] > k["confidence"]

dedupe("D02_iou_by_confidence", _BY_CONF, "confidence DESC, idx", lambda k, r: G.iou(k, r) > 0.5, f"{IOU} > 0.5", _MORE, "c.confidence > k.confidence")
dedupe("D04_iou_replace", _BY_IDX, "idx", lambda k, r: G.iou(k, r) > 0.5, f"{IOU} > 0.5", _MORE, "c.confidence > k.confidence", "confidence >= 0.3")
dedupe("D05_iou_strict_replace", _BY_IDX, "idx", lambda k, r: G.iou(k, r) > 0.7, f"{IOU} > 0.7", _MORE, "c.confidence > k.confidence")
dedupe("D06_same_text_near", _BY_IDX, "idx", pipeline.same_text_near(50.0), f"k.text = c.text AND {FAR} < 50", _MORE, "c.confidence > k.confidence")
dedupe("D07_box_nms", _BY_CONF, "confidence DESC, idx", lambda k, r: G.iou(k, r) > 0.3, f"{IOU} > 0.3", where="confidence > 0.5")
dedupe("D08_area_nms", _BY_AREA, "w * h DESC, idx", lambda k, r: G.iou(k, r) > 0.3, f"{IOU} > 0.3")
dedupe("D09_circles_half_radii", _BY_CONF, "confidence DESC, idx", lambda k, r: _FAR(k, r) < (k["radius"] + r["radius"]) / 2, f"{FAR} < (k.radius + c.radius) / 2")
dedupe("D10_circles_near", _BY_CONF, "confidence DESC, idx", lambda k, r: (_FAR(k, r) < 20) | (_FAR(k, r) < (k["radius"] + r["radius"]) * 0.8), f"({FAR} < 20 OR {FAR} < (k.radius + c.radius) * 0.8::DOUBLE)")
dedupe("D11_circles_wide", _BY_CONF, "confidence DESC, idx", lambda k, r: _FAR(k, r) < (k["radius"] + r["radius"]) * 0.7, f"{FAR} < (k.radius + c.radius) * 0.7::DOUBLE")
dedupe("D12_circles_replace", _BY_IDX, "idx", lambda k, r: _FAR(k, r) < (k["radius"] + r["radius"]) / 2, f"{FAR} < (k.radius + c.radius) / 2", _MORE, "c.confidence > k.confidence")
_J = "CASE WHEN k.text = c.text THEN 1.0 WHEN k.text = '' OR c.text = '' THEN 0.0 ELSE len(list_intersect(string_split(k.text, ''), string_split(c.text, '')))::DOUBLE / (len(list_distinct(string_split(k.text, ''))) + len(list_distinct(string_split(c.text, ''))) - len(list_intersect(string_split(k.text, ''), string_split(c.text, '')))) END"


def _jaccard(k, r):
    from mapsieve.functions.similarity import char_jaccard

    return char_jaccard(k["text"], r["text"])


dedupe("D03_iou_and_characters", _BY_CONF, "confidence DESC, idx", lambda k, r: (G.iou(k, r) > 0.3) & (_jaccard(k, r) > 0.8), f"{IOU} > 0.3 AND {_J} > 0.8")
_CLEAR = "CASE WHEN c.is_number AND NOT k.is_number THEN true WHEN k.is_number AND NOT c.is_number THEN false WHEN abs(c.confidence - k.confidence) > 0.1 THEN c.confidence > k.confidence WHEN length(c.text) <> length(k.text) THEN length(c.text) > length(k.text) ELSE c.confidence > k.confidence END"
add("D01_engine_union", lambda s, d: pipeline.engine_union("page_id", detections(s, d).filter("engine = 'paddle'"), detections(s, d).filter("engine <> 'paddle'")).select("page_id", "idx"), fold_sql(f"{MIN_OVERLAP} > 0.6", "confidence DESC, idx", better=_CLEAR))


def group_sql(hit: str, select: str) -> str:
    """Seed groups by a recursive query over a list of (seed, members)."""
    return fold_sql(hit, "idx").replace("SELECT page_id, unnest(list_transform(kept, lambda k: k.idx)) AS idx FROM ends", f"SELECT page_id, {select} FROM ends")


def seeds(name, hit, hit_sql):
    add(name, lambda s, d: fold.seed_groups(detections(s, d), ["page_id"], [F.col("idx")], hit).groupBy("page_id").agg(F.count("*").alias("groups"), F.sum(F.size("members")).alias("members")), group_sql(hit_sql, "len(kept) AS groups, (SELECT count(*) FROM det WHERE det.page_id = ends.page_id) AS members"))


seeds("D13_seed_groups_iou", lambda k, r: G.iou(k, r) > 0.5, f"{IOU} > 0.5")
seeds("D16_seed_groups_text", pipeline.same_text_near(100.0), f"k.text = c.text AND {FAR} < 100")
seeds("D18_seed_circles", lambda k, r: _FAR(k, r) < 30, f"{FAR} < 30")
seeds("D19_seed_boxes", lambda k, r: G.iou(k, r) > 0.5, f"{IOU} > 0.5")
add("D13_best_of_groups", lambda s, d: fold.best_of_groups(fold.seed_groups(detections(s, d), ["page_id"], [F.col("idx")], lambda k, r: G.iou(k, r) > 0.5), ["page_id"], lambda m: F.struct(F.char_length(m["text"]), m["confidence"])).select("page_id", "group", "idx", "text"))
add("D14_multi_scale_merge", lambda s, d: pipeline.multi_scale_merge(detections(s, d)))
add("D15_post_process", lambda s, d: pipeline.post_process(detections(s, d)).select("page_id", "text", "format_type", "merged_from", rounded(F.col("score"), 6).alias("score")))
add("D17_best_by_text", lambda s, d: fold.best_per_key(detections(s, d), ["page_id", "text"], [F.desc("confidence"), F.col("idx")]).select("page_id", "text", "idx"), f"{WITH} SELECT page_id, text, idx FROM det QUALIFY row_number() OVER (PARTITION BY page_id, text ORDER BY confidence DESC, idx) = 1")
add("D21_islands", lambda s, d: fold.islands(detections(s, d), ["page_id"], [F.col("y1"), F.col("x1"), F.col("idx")], lambda a, b: _FAR(a, b) >= 60).groupBy("page_id", "island").agg(F.count("*").alias("n"), F.min("idx").alias("first")), f"{WITH}, t AS (SELECT *, CASE WHEN lag(cx) OVER w IS NULL THEN 0 WHEN sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) >= 60 THEN 1 ELSE 0 END AS new FROM det WINDOW w AS (PARTITION BY page_id ORDER BY y1, x1, idx)), u AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY y1, x1, idx ROWS UNBOUNDED PRECEDING) AS island FROM t) SELECT page_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(idx) AS first FROM u GROUP BY 1, 2")
add("W03_first_nine", lambda s, d: fold.best_per_key(detections(s, d), ["det_key"], [F.desc("confidence"), F.col("page_id"), F.col("idx")], 9).select("det_key", "page_id", "idx"), f"{WITH} SELECT det_key, page_id, idx FROM det QUALIFY row_number() OVER (PARTITION BY det_key ORDER BY confidence DESC, page_id, idx) <= 9")

_T = f"{WITH}, t AS (SELECT *, {STAGE5_CASE} AS cls FROM det), e AS (SELECT *, {_ENH} AS es FROM t)"
add("A07_page_statistics", lambda s, d: statistics.page_statistics(pipeline.enhanced(detections(s, d)), ["page_id"]).select("page_id", "total", rounded(F.col("mean_score"), 4).alias("mean_score"), "high_count", "target_count", F.to_json("type_distribution").alias("types")), f"{_T}, g AS (SELECT page_id, cls, count(*) AS n, sum(CAST(floor(es * 1e6 + 0.5) AS BIGINT)) AS s, count(*) FILTER (es > 0.8) AS hi, count(*) FILTER (cls IN ('block_number','route_price','complex_number')) AS tg FROM e GROUP BY 1, 2) SELECT page_id, CAST(sum(n) AS BIGINT) AS total, {R('CAST(sum(s) AS DOUBLE) / (sum(n) * 1e6)', 4)} AS mean_score, CAST(sum(hi) AS BIGINT) AS high_count, CAST(sum(tg) AS BIGINT) AS target_count, '{{' || string_agg('\"' || cls || '\":' || n, ',' ORDER BY cls) || '}}' AS types FROM g GROUP BY 1")
add("B01_simple_pipeline", lambda s, d: pipeline.full_statistics(detections(s, d)).select("page_id", "total", "high_count", "target_count"))
add("F10_known_and_scored", lambda s, d: pipeline.filters.known_and_scored(pipeline.enhanced(detections(s, d))).select("page_id", "idx"), f"{_T} SELECT page_id, idx FROM e WHERE length(text) >= 1 AND es >= 0.2 AND cls <> 'unknown'")
add("A08_document_summary", lambda s, d: statistics.summary_of_pages(pages(s, d).join(detections(s, d).groupBy("page_id").agg(F.count("*").alias("total")), "page_id"), ["pdf_id"]).select("pdf_id", "total_pages", "successful_pages", "failed_pages", "total_detections", rounded(F.col("detections_per_page"), 6).alias("per_page")), f"{WITH}, n AS (SELECT page_id, count(*) AS total FROM det GROUP BY 1), p AS (SELECT * FROM pg JOIN n USING (page_id)) SELECT pdf_id, count(*) AS total_pages, count(*) FILTER (success) AS successful_pages, count(*) FILTER (NOT success) AS failed_pages, CAST(coalesce(sum(total) FILTER (success), 0) AS BIGINT) AS total_detections, CASE WHEN count(*) FILTER (success) > 0 THEN {R('coalesce(sum(total) FILTER (success), 0)::DOUBLE / count(*) FILTER (success)')} ELSE 0 END AS per_page FROM p GROUP BY 1")
add("A08_merged_distribution", lambda s, d: statistics.merged_distribution(statistics.page_statistics(pipeline.enhanced(detections(s, d)), ["page_id"]).join(pages(s, d).select("page_id", "pdf_id"), "page_id"), ["pdf_id"]), f"{_T} SELECT pdf_id, cls AS type, count(*) AS n FROM e JOIN pg USING (page_id) GROUP BY 1, 2")
add("A09_batch_summary", lambda s, d: statistics.batch_summary(pages(s, d).select(F.when(F.col("success"), "success").otherwise("error").alias("status"), F.lit(2).alias("texts"), F.lit(1).alias("circles"), F.lit(3).alias("seconds"))).select("total_files", "successful_files", "failed_files", "total_text_regions", "total_circles", "total_seconds"), f"{WITH} SELECT count(*) AS total_files, count(*) FILTER (success) AS successful_files, count(*) FILTER (NOT success) AS failed_files, 2 * count(*) FILTER (success) AS total_text_regions, count(*) FILTER (success) AS total_circles, 3 * count(*) FILTER (success) AS total_seconds FROM pg")
add("A10_per_detector", lambda s, d: statistics.per_group(detections(s, d), ["engine"]).select("engine", "n", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("least"), 6).alias("least"), rounded(F.col("most"), 6).alias("most")), f"{WITH} SELECT engine, count(*) AS n, {R('avg(confidence)')} AS mean, {R('min(confidence)')} AS least, {R('max(confidence)')} AS most FROM det GROUP BY 1")
_READ = "count(*) FILTER (trim(text) <> '')"
add("A11_recognition_rate", lambda s, d: statistics.recognition_rate(detections(s, d)).select("n", rounded(F.col("mean"), 6).alias("mean"), "recognized", rounded(F.col("rate"), 6).alias("rate")), f"{WITH} SELECT count(*) AS n, {R('avg(confidence)')} AS mean, {_READ} AS recognized, {R(_READ + '::DOUBLE / count(*)')} AS rate FROM det")
add("A13_cluster_summary", lambda s, d: statistics.cluster_summary(detections(s, d), ["page_id"], "engine"), f"{WITH}, g AS (SELECT page_id, engine, count(*) AS n, min(idx) AS first FROM det GROUP BY 1, 2) SELECT page_id, CAST(sum(n) AS BIGINT) AS size, count(*) AS types, first(engine ORDER BY n DESC, first) AS dominant FROM g GROUP BY 1")
add("A13_repeated_texts", lambda s, d: statistics.repeated_texts(detections(s, d), ["page_id"]), f"{WITH} SELECT page_id, text, count(*) AS n FROM det GROUP BY 1, 2 HAVING count(*) > 1")
add("A17_words_to_lines", lambda s, d: statistics.words_to_lines(detections(s, d).select("page_id", F.floor(F.col("y1") / 50).alias("line"), F.col("x1").alias("left"), F.col("y1").alias("top"), F.col("w").alias("width"), F.col("h").alias("height"), (F.col("confidence") * 100).alias("conf"), "text", "idx"), ["page_id", "line"]).select("page_id", "line", "text", "x1", "y1", "x2", "y2"), f"{WITH} SELECT page_id, CAST(floor(y1 / 50) AS BIGINT) AS line, string_agg(trim(text), '' ORDER BY x1, idx) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM det WHERE trim(text) <> '' AND confidence * 100 >= 30 GROUP BY 1, 2")
add("A18_box_union", lambda s, d: statistics.box_union(detections(s, d), ["page_id", "engine"]), f"{WITH} SELECT page_id, engine, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM det GROUP BY 1, 2")
add("A19_joined_texts", lambda s, d: statistics.joined_texts(detections(s, d), ["page_id"], ["x1", "idx"], " ").select("page_id", "text", rounded(F.col("confidence"), 6).alias("confidence")), f"{WITH} SELECT page_id, string_agg(text, ' ' ORDER BY x1, idx) AS text, {R('avg(confidence)')} AS confidence FROM det GROUP BY 1")
add("A20_histogram", lambda s, d: statistics.histogram(detections(s, d), "w", 10, 60), f"{WITH} SELECT CAST(least(floor((w - 10) / 2.5) + 1, 20) AS INT) AS bin, count(*) AS n FROM det WHERE w BETWEEN 10 AND 60 GROUP BY 1")
add("A23_inverted_index", lambda s, d: statistics.inverted_index(detections(s, d), ["page_id", "idx"]).select("text", F.size("places").alias("n"), F.col("places")[0]["page_id"].alias("first_page")), f"{WITH} SELECT text, CAST(count(*) AS INT) AS n, min(page_id) AS first_page FROM det GROUP BY 1")
_FLAGGED = "count(*) FILTER (kind = 'circle')"
add("A24_strict_share", lambda s, d: detections(s, d).groupBy("engine").agg(F.count_if(F.col("kind") == "circle").alias("flagged"), rounded(F.count_if((F.col("kind") == "circle") & F.col("is_number")) / F.nullif(F.count_if(F.col("kind") == "circle"), F.lit(0)), 6).alias("share")), f"{WITH} SELECT engine, {_FLAGGED} AS flagged, {R(_FLAGGED.replace(')', ' AND is_number)', 2).replace('(* AND is_number)', '(*)') + '::DOUBLE / nullif(' + _FLAGGED + ', 0)')} AS share FROM det GROUP BY 1")
add("B13_category_rows", lambda s, d: statistics.category_rows(detections(s, d).withColumn("shape", F.when(F.col("kind") == "circle", "circle").when(F.col("w") < 30, "small").otherwise("text")).withColumn("rotation", F.col("idx") % 2 * 90)).groupBy("category").agg(F.count("*").alias("n")), f"{WITH}, t AS (SELECT *, CASE WHEN kind = 'circle' THEN 'circle' WHEN w < 30 THEN 'small' ELSE 'text' END AS shape, idx % 2 * 90 AS rotation FROM det WHERE text <> ''), c AS (SELECT 'circled_numbers' AS category FROM t WHERE shape = 'circle' UNION ALL SELECT 'horizontal_text' FROM t WHERE shape <> 'circle' AND rotation = 0 UNION ALL SELECT 'vertical_text' FROM t WHERE shape <> 'circle' AND rotation <> 0 UNION ALL SELECT 'route_prices' FROM t WHERE shape <> 'circle' AND regexp_matches(text, '^[0-9]{{2,3}}[A-G]$') UNION ALL SELECT 'small_text' FROM t WHERE shape = 'small' AND length(text) <= 5) SELECT category, count(*) AS n FROM c GROUP BY 1")
add("B15_best_text", lambda s, d: detections(s, d).groupBy("page_id").agg(F.max_by("text", F.struct("confidence", -F.col("idx"))).alias("text")), f"{WITH} SELECT page_id, first(text ORDER BY confidence DESC, idx) AS text FROM det GROUP BY 1")
