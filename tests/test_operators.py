"""Operators against plain versions and worked examples."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mapsieve.functions import geometry as G
from mapsieve.functions import scores, similarity
from mapsieve.functions import text as T
from mapsieve.operators import filters, fold, pipeline, search, spatial, statistics, storage, tables, vision
from mapsieve.sources import detections as D
from mapsieve.sources import hierarchy, html, images
from mapsieve.sources.config import ServiceLimits
from mapsieve.streaming import ingest


def column(spark, values, ddl="text string"):
    return spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], ddl)


def mapped(spark, values, f):
    return [r[0] for r in column(spark, values).select(f(F.col("text"))).collect()]


def test_documented_pairs(spark):
    texts = ["115E", "95A", "1200万", "15", "12-5", "R07"]
    assert mapped(spark, texts, T.documented_type) == ["route_price", "route_price", "route_price_unit", "block_number", "complex_address", "reference_mark"]
    assert mapped(spark, texts, T.stage5_type) == ["route_price", "route_price", "price_with_unit", "block_number", "complex_number", "reference_code"]


def test_unicode_digits(spark):
    assert mapped(spark, ["１２", "①", "²", "⑩", "一", "12a"], T.is_digit) == [True, True, True, False, False, False]
    assert mapped(spark, ["12345", "x", "ab", "a/b", "", "!"], T.stage5_type) == ["pure_number", "single_letter", "unknown", "complex_identifier", "unknown", "unknown"]


def test_address_normalisation(spark):
    assert mapped(spark, ["藤白台１丁目　２－３", "二十番", None], T.normalize_address) == ["藤白台1丁目 2-3", "210番", ""]
    assert mapped(spark, ["12丁目3番4号", "1-2-3", "plain"], T.sub_district) == ["12丁目3番4号", "1-2-3", "plain"]
    assert T.parse_address("大阪府吹田市藤白台一丁目", ("吹田市",)) == {"prefecture": "大阪府", "city": "吹田市", "district": "大阪府吹田市藤白台一丁目"}
    assert T.parse_address("東京都港区芝", ("中央区", "港区")) == {"prefecture": "東京都", "city": "港区", "district": "芝"}


def test_corrections(spark):
    assert mapped(spark, ["1l5E", "O5A", "115E", "R07", "12-5", "abc"], T.correct_reading) == ["115E", "05A", "115E", "R07", "12-5", "abc"]
    assert mapped(spark, ["1000", "a b!!cccc"], T.fix_format) == ["1000", "abC"]
    assert mapped(spark, ["1000", "1115E"], T.fix_format_literal) == ["10", "15E"]


def test_partial_ratio_is_best_of_windows(spark):
    assert similarity.best_window_ratio("abc", "xxabcxx") == 100.0
    assert similarity.best_window_ratio("", "") == 100.0 and similarity.best_window_ratio("", "a") == 0.0

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(2))
        assert similarity.indel_ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


def test_partial_ratio_of_long_texts(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 30, 63, 64, 70):
        for size in (63, 64, 65, 200):
            a, b = ("".join(rng.choice("ab é日😀") for _ in range(k)) for k in (n, size))
            short, long = sorted((a, b), key=len)
            windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
            assert similarity.best_window_ratio(a, b) == max(similarity.indel_ratio(short, w) for w in windows)


def boxes(rng, n, pages=3):
    out = []
    for p in range(pages):
        for i in range(n):
            x, y, w, h = rng.randint(0, 60), rng.randint(0, 60), rng.randint(5, 40), rng.randint(5, 40)
            out.append((p, i, x, y, x + w, y + h, x + w / 2, y + h / 2, rng.random(), rng.choice(["1", "22", "A", "B7", ""]), rng.choice(["paddle", "other"])))
    return out


BOX = "page_id int, idx int, x1 int, y1 int, x2 int, y2 int, cx double, cy double, confidence double, text string, engine string"


def plain_iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    common = w * h if w > 0 and h > 0 else 0
    return common / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - common)


@pytest.mark.parametrize("replace", [False, True])
def test_greedy_dedupe(spark, replace):
    rows = boxes(random.Random(2), 25)
    want = set()
    for p in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: r[1] if replace else (-r[8], r[1])):
            hit = next((k for k, x in enumerate(kept) if plain_iou(x, r) > 0.3), None)
            if hit is None:
                kept.append(r)
            elif replace and r[8] > kept[hit][8]:
                kept[hit] = r
        want |= {(r[0], r[1]) for r in kept}
    df = spark.createDataFrame(rows, BOX)
    order = [F.col("idx")] if replace else [F.desc("confidence"), F.col("idx")]
    got = fold.greedy_dedupe(df, ["page_id"], order, lambda k, r: G.iou(k, r) > 0.3, (lambda n, k: n["confidence"] > k["confidence"]) if replace else None)
    assert {(r.page_id, r.idx) for r in got.collect()} == want and got.columns == df.columns


def test_seed_groups(spark):
    rows = boxes(random.Random(3), 25)
    want = {}
    for p in range(3):
        groups = []
        for r in sorted(r for r in rows if r[0] == p):
            own = next((g for g in groups if plain_iou(g[0], r) > 0.3), None)
            own.append(r) if own else groups.append([r])
        for k, g in enumerate(groups):
            want[p, k] = [r[1] for r in g]
    df = spark.createDataFrame(rows, BOX)
    groups = fold.seed_groups(df, ["page_id"], [F.col("idx")], lambda k, r: G.iou(k, r) > 0.3)
    assert {(r.page_id, r.group): [m.idx for m in r.members] for r in groups.collect()} == want
    best = fold.best_of_groups(groups, ["page_id"], lambda m: F.struct(F.char_length(m["text"]), m["confidence"]))
    by = {(r[0], r[1]): r for r in rows}
    assert {(r.page_id, r.group): r.idx for r in best.collect()} == {(p, k): max((by[p, i] for i in g), key=lambda r: (len(r[9]), r[8], -r[1]))[1] for (p, k), g in want.items()}


def test_post_processing_fixture(spark):
    rows = [(1, 0, 100, 100, 120, 115, "115", 0.9), (1, 1, 125, 100, 135, 115, "E", 0.8), (1, 2, 200, 200, 220, 215, "42", 0.85)]
    df = spark.createDataFrame(rows, "page_id int, idx int, x1 int, y1 int, x2 int, y2 int, text string, confidence double")
    got = {r.text: r for r in pipeline.post_process(df).collect()}
    assert set(got) == {"115E", "42"}
    e = got["115E"]
    assert (e.format_type, e.merged_from, e.x1, e.y1, e.x2, e.y2) == ("route_price", 2, 100, 100, 135, 115)
    assert e.confidence == pytest.approx(0.85) and e.score == pytest.approx(0.74) and got["42"].score == pytest.approx(0.72)
    assert all(r.quality_score == 1.0 for r in got.values())


def test_spatial_fixture(spark):
    rows = [(1, 0, 115.0, 110.0, "115E", "route_price", 0.9), (1, 1, 210.0, 210.0, "42", "block_number", 0.8)]
    df = spark.createDataFrame(rows, "page_id int, idx int, cx double, cy double, text string, type string, confidence double")
    roads = spark.createDataFrame([], "page_id int, x1 int, y1 int, x2 int, y2 int")
    regions = spark.createDataFrame([], "page_id int, region_id int, contour array<array<double>>")
    got = {r.idx: r for r in pipeline.spatial_analysis(df, roads, regions).collect()}
    assert [got[i].spatial_type for i in (0, 1)] == ["spatial_route_price", "spatial_block_number"]
    assert [round(got[i].spatial_confidence, 6) for i in (0, 1)] == [0.8, 0.8]
    assert [list(got[i].issues) for i in (0, 1)] == [["route_price_too_far_from_road"], ["block_number_outside_region"]]
    assert {r.cluster for r in spatial.dbscan(df, 150.0).collect()} == {0}


def test_geometry(spark):
    df = column(spark, [1], "x int")
    one = lambda c: df.select(c.alias("v")).first().v
    square = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))))
    assert one(G.polygon_area(square)) == 16
    assert [one(G.in_polygon(F.lit(x), F.lit(y), square)) for x, y in ((2.0, 2.0), (4.0, 1.0), (0.0, 0.0), (5.0, 1.0), (-1.0, 0.0))] == [True, True, True, False, False]
    assert one(G.point_segment_distance(F.lit(3), F.lit(4), F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 5
    seg = lambda *v: dict(zip(("x1", "y1", "x2", "y2"), map(F.lit, v), strict=True))
    assert tuple(one(G.segment_crossing(seg(0, 0, 10, 10), seg(0, 10, 10, 0)))) == (5, 5)
    assert one(G.segment_crossing(seg(0, 0, 10, 0), seg(0, 5, 10, 5))) is None
    assert one(G.parallel_difference(F.lit(350.0), F.lit(10.0))) == 20 and one(G.parallel_difference(F.lit(270.0), F.lit(0.0))) == 90
    for angle, (x, y) in {0: (3, 7), 90: (13, 3), 180: (7, 13), 270: (7, 7)}.items():
        assert tuple(one(G.rotated_back(F.lit(x), F.lit(y), F.lit(angle), F.lit(10), F.lit(20)))) == ((3, 7) if angle in (0, 180) else {90: (3, 7), 270: (3, 7)}[angle])
    assert [tuple(t) for t in one(G.exact_tiles(F.lit(20), F.lit(10), 10, 5))] == [(0, 0), (5, 0), (10, 0)]


def test_greedy_matching(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.3), (2, 1, 1, 0.5)], "page_id int, a int, b int, s double")
    assert {tuple(r) for r in spatial.match_greedily(pairs, "page_id", "a", "b", "s").collect()} == {(1, 1, 1, 0.9), (1, 2, 2, 0.3), (2, 1, 1, 0.5)}


def test_searches(spark):
    rows = [(1, 1, "1", "circle", 0.5), (1, 2, "12", "circle", 0.9), (1, 3, "1 a long one", "text", 0.95), (1, 4, "1x", "text", 0.2), (1, 5, "21", "text", 0.99), (2, 1, None, "text", 0.3)]
    df = spark.createDataFrame(rows, "page_id int, idx int, text string, type string, confidence double")
    assert [r.idx for r in search.quota_search(df, "1").collect()] == [2, 1, 5, 3]
    assert [r.idx for r in search.quota_search(df, "1", True).collect()] == [2, 1]
    assert [r.idx for r in search.quota_search(df, "x").collect()] == [4]
    assert [r.idx for r in search.fuzzy_search(df, "long one", 90).collect()] == [3]
    folders = spark.createDataFrame([("大阪府", "吹田市", "藤白台１", "大阪府 吹田市 藤白台１", "p1"), ("大阪府", "吹田市", "青山台", "大阪府 吹田市 青山台", "p2")], "prefecture string, city string, district string, display_name string, path string")
    got = search.folder_search(folders, "藤白台").collect()
    assert got[0].path == "p1" and got[0].similarity == pytest.approx(0.85)
    assert search.folder_search(folders, " ").count() == 0


def test_upsert_and_ids(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, key string, hits int")
    new = spark.createDataFrame([(9, "b", 0), (10, "b", 1), (11, "c", 2)], "id int, key string, seq int")
    got = tables.upsert(old, new.select("id", "key", "seq"), ["key"], {"hits": F.lit(0)}, [F.col("seq")])
    assert {tuple(r) for r in got.collect()} == {(1, "a", 5), (10, "b", 0), (11, "c", 0)}
    ids = tables.append_with_ids(spark.createDataFrame([(4, "x")], "id long, path string"), spark.createDataFrame([(f"p{i:03d}",) for i in range(50)], "path string"), "id", ["path"])
    assert {(r.id, r.path) for r in ids.collect()} == {(4, "x")} | {(5 + i, f"p{i:03d}") for i in range(50)}


def test_detection_files(spark, tmp_path):
    cases = {"a.json": '[{"text":"x","bbox":[1,2,4,8],"confidence":0.5},{"inner_text":"y","ocr_confidence":0.7,"detection_type":"circle"},{"text":"  "}]', "b.json": "", "c.json": "[", "d.json": '{"text":"z"}', "e.json": "nonsense"}
    for name, body in cases.items():
        (tmp_path / name).write_text(body)
    got = D.read_json(spark, [str(tmp_path)], "p.pdf").collect()
    assert {(r.text, r.confidence, r.type, r.pdf_path, r.source_file) for r in got} == {("x", 0.5, "text", "p.pdf", "a.json"), ("y", 0.7, "circle", "p.pdf", "a.json")}


def test_hierarchy_scan(spark, tmp_path):
    for p in ("大阪府/吹田市/藤白台１/43012.pdf", "大阪府/x.pdf", "大阪府/吹田市/藤白台１/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"%PDF")
    got = hierarchy.scan(spark, str(tmp_path)).collect()
    assert [(r.prefecture, r.city, r.district, r.filename, r.full_address, r.file_size) for r in got] == [("大阪府", "吹田市", "藤白台１", "43012.pdf", "大阪府吹田市藤白台１", 4)]


def test_decoding_and_places(spark):
    raw = spark.createDataFrame([("<html>大阪市</html>".encode("shift_jis"),), ("日本".encode("euc-jp"),), (b"\xff\xfe",), (None,)], "b binary")
    assert [r[0] for r in raw.select(html.decoded("b")).collect()][0] == "<html>大阪市</html>"
    assert raw.select(html.decoded_japanese("b")).first()[0] == "<html>大阪市</html>"
    pages = spark.createDataFrame([(1, "http://a/b/c.htm", '<div class="navi__level">大阪市 北区</div><a href="d/1.pdf">One <b>x</b></a><a href="../e.htm">E</a>', "大阪府", "大阪市", "")], "page_id int, url string, html string, prefecture string, city string, district string")
    assert [tuple(r) for r in html.task_list(pages).collect()] == [("http://a/b/d/1.pdf", "大阪府/大阪市/1.pdf")]
    assert pages.select(html.place_of_page(F.col("html"))).first()[0] == "大阪市"
    wards = spark.createDataFrame([("大阪市", "中央区", 1), ("大阪市", "北区", 2)], "city string, ward string, ord int")
    assert html.with_ward(pages.select("page_id", "city", F.lit("大阪市 北区").alias("navi")), wards).first().district == "北区"
    assert [r[0] for r in column(spark, ["x/01fr.htm", "r07/x/fr.htm", "a_fr.html"]).select(html.is_page_link(F.col("text"))).collect()] == [True, False, False]


def test_lines_of_words(spark):
    words = [(1, 1, 30, 10, 5, 5, 80.0, "b", 1), (1, 1, 10, 12, 5, 5, 60.0, " a ", 2), (1, 1, 50, 1, 9, 5, 20.0, "low", 3), (1, 2, 5, 5, 5, 5, 90.0, "c", 4)]
    df = spark.createDataFrame(words, "page int, line int, left int, top int, width int, height int, conf double, text string, idx int")
    got = {r.line: r for r in statistics.words_to_lines(df, ["page", "line"]).collect()}
    assert (got[1].text, got[1].x1, got[1].y1, got[1].x2, got[1].y2, got[1].confidence) == ("ab", 10, 10, 35, 17, 70.0)


def test_engines(spark):
    registry = vision.Registry()
    registry.add(vision.GridEngine())
    pages = spark.createDataFrame([(1, bytearray(b"x"), 100, 80)], "page_id long, image binary, width int, height int")
    assert registry.available() == ["grid"] and registry.detect(pages).count() == 4
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "page_id int, engine string")
    assert {tuple(r) for r in vision.first_engine(rows, ["a", "b"]).collect()} == {(1, "a"), (2, "b")}
    assert D.mock_rows(spark, 600, 800).count() == 4


def test_filters_and_scores(spark):
    df = spark.createDataFrame([(1, "12", 10, 10, 0.9), (2, "", 10, 10, 0.9), (3, "--", 10, 10, 0.9), (4, "7", 100, 9, 0.9), (5, "x" * 21, 10, 10, 0.9)], "idx int, text string, w int, h int, confidence double")
    assert {r.idx for r in filters.quality(df).collect()} == {1, 3, 5}
    assert {r.idx for r in filters.noise(df).collect()} == {1, 4}
    one = df.filter("idx = 1")
    assert one.select(scores.relationship(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h"), F.lit(0))).first()[0] is None
    assert one.select(scores.relationship(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h"), F.lit(5))).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        ServiceLimits(similarity=101)


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "id long, query_hash string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(str(source))
    for extra in (None, [(3, "c")]):
        if extra:
            spark.createDataFrame(extra, schema).write.mode("append").parquet(str(source))
        ingest.run_available(ingest.new_files(spark, str(source), schema), str(out), str(tmp_path / "ck"))
    assert {r.id for r in spark.read.parquet(str(out)).collect()} == {1, 2, 3}


def test_service(spark):
    import datetime as dt

    from mapsieve.service import SearchService

    files = spark.createDataFrame([("大阪府", "吹田市", "藤白台１", "p1"), ("大阪府", "吹田市", "青山台", "p2"), ("東京都", "港区", "芝", "p3")], "prefecture string, city string, district string, path string")
    found = spark.createDataFrame([("p1", 1, 1, "115E", 0.9), ("p1", 1, 2, "藤白台１丁目", 0.8), ("p3", 2, 1, "115E", 0.7)], "path string, page_id long, idx int, text string, confidence double")
    service = SearchService(spark, files, found)
    assert [r[0] for r in service.cities("大阪府").collect()] == ["吹田市"] and service.prefectures().count() == 2
    assert service.by_address("大阪府 吹田市 藤白台１").first().path == "p1"
    now = dt.datetime(2024, 1, 1)
    first = service.by_text("115E", now, prefecture="大阪府").collect()
    assert [r.path for r in first] == ["p1"] and first[0].similarity == 100.0
    assert service.by_text("115E", now + dt.timedelta(minutes=5), prefecture="大阪府").collect() == first
    assert {r.path for r in service.by_text("115E", now).collect()} == {"p1", "p3"}
    assert service.stats()["cache_hits"] == 1 and service.stats()["searches"] == 3
    service.sweep(now + dt.timedelta(hours=2))
    assert service.cache.count() == 0


def test_merged_lines(spark):
    lines = spark.createDataFrame([(1, 0, 0, 0, 50, 0), (1, 1, 20, 3, 60, 4), (1, 2, 0, 100, 3, 200), (1, 3, 25, -30, 25, 30)], "page_id int, idx int, x1 int, y1 int, x2 int, y2 int")
    got = {tuple(r)[2:] for r in spatial.merged_lines(lines).collect()}
    assert got == {(0, 0, 60, 4, 2), (0, 100, 3, 200, 1), (25, -30, 25, 30, 1)}


def test_components_by_page(spark):
    rng = random.Random(7)
    points = [(p, i, rng.uniform(0, 300), rng.uniform(0, 300)) for p in range(3) for i in range(40)]
    df = spark.createDataFrame(points, "page_id int, idx int, cx double, cy double")
    edges = spatial.near_edges(df, 40.0)
    plain = {(p, a[1], b[1]) for p in range(3) for a in points for b in points if a[0] == b[0] == p and a[1] < b[1] and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 40}
    assert {(r.page_id, r.a, r.b) for r in edges.collect()} == plain
    up = {(p, i): i for p, i, _, _ in points}
    for _ in range(60):
        for p, a, b in plain:
            up[p, a] = up[p, b] = min(up[p, a], up[p, b])
    for f in (spatial.components, spatial.components_by_rounds):
        assert {(r.page_id, r.idx): r.component for r in f(df, edges).collect()} == up


def test_appended_ids_are_unique_and_gapless(spark):
    """Wide rows, ties and more than one sort of the same plan: ids must belong to one of them."""
    old = spark.createDataFrame([(7, "x", "y")], "id long, name string, note string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        new = spark.range(300_000).selectExpr("md5(cast(id % 250000 as string)) as name", "repeat(md5(cast(id as string)), 6) as note").repartition(64)
        got = tables.append_with_ids(old, new, "id", ["name"])
        n, distinct, low, high = got.selectExpr("count(*)", "count(distinct id)", "min(id)", "max(id)").first()
        assert (n, distinct, low, high) == (300_001, 300_001, 7, 300_007)
        wrong = got.filter("id > 7").withColumn("next", F.lead("name").over(Window.partitionBy(F.expr("id div 1000")).orderBy("id"))).filter("next < name").count()
        assert wrong == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tables.append_with_ids(old, new.limit(0), "id", ["name"]).count() == 1


def test_bounded_history(spark):
    rows = spark.createDataFrame([("a", i) for i in range(12)] + [("b", i) for i in range(10)], "k string, t int")
    got = tables.bounded_history(rows, ["k"], [F.col("t")], 10, 5).collect()
    assert sorted((r.k, r.t) for r in got) == [("a", i) for i in range(7, 12)] + [("b", i) for i in range(10)]


def test_registry_weights_times_and_availability(spark):
    class Slow(vision.GridEngine):
        name = "slow"

        def detect(self, image, width, height):
            import time

            time.sleep(60)

    class Broken(vision.GridEngine):
        name = "broken"

        def detect(self, image, width, height):
            raise ValueError("no")

    registry = vision.Registry()
    registry.add(vision.GridEngine(), weight=0.5)
    registry.add(Slow(), timeout=0.2)
    registry.add(Broken())
    assert not registry.add_if_available(("no_such_module_here",), Broken) and registry.add_if_available(("json",), vision.GridEngine, 0.5)
    assert registry.available() == ["broken", "grid", "slow"] and [x["weight"] for x in registry.info()] == [1.0, 0.5, 1.0]
    pages = spark.createDataFrame([(1, b"x", 200, 100)], "page_id long, image binary, width int, height int")
    got = registry.detect(pages).collect()
    assert {(r.engine, r.confidence) for r in got} == {("grid", 0.45)} and len(got) == 4


def test_broken_images_have_no_size():
    for data in (b"", b"\x89PNG\r\n\x1a\n", b"GIF89a", b"\xff\xd8\xff", b"\xff\xd8\xff\xe0\xff", b"BM", b"%PDF-1.4"):
        assert images.size_of(data) == (None, None, None)


def test_storage_is_released(spark):
    held = list(storage._held)
    storage._held.clear()
    df = storage.written(spark.range(3).toDF("x"))
    assert df.count() == 3
    storage.release(spark)
    with pytest.raises(Exception):
        spark.read.schema("x long").parquet(df.inputFiles()[0]).collect()
    storage._held.extend(held)
