"""Every registered query of the library runs, and gives the rows of its SQL on the smallest tables."""

import math
from decimal import Decimal
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest

from mapsieve.functions import similarity
from mapsieve.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, 0 if x is None else x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in registry.ORACLE_SQL:
        found = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert ordered(got) == ordered(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_names_fit():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_flows_meet_all_pages_and_files(spark):
    pages = spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert registry.QUERIES["U01_engine_rows_all"](spark, str(DATA)).select("page_id").distinct().count() == pages
    assert registry.QUERIES["B08_scales_and_engines_all"](spark, str(DATA)).count() == pages
    moves = registry.QUERIES["K11_misplaced_files"](spark, str(DATA)).collect()
    assert len(moves) == spark.read.parquet(f"{DATA}/customer.parquet").filter("c_acctbal < 0").count() > 0
    assert all(r.path.count("/") == 2 and r.target.count("/") == 3 for r in moves)


def test_orders_keep_every_row(spark):
    pages, detections = (spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("orders", "lineitem"))
    for name, n in (("O01_newest_first_all", pages), ("O08_by_area_all", detections)):
        assert sorted(r.place for r in registry.QUERIES[name](spark, str(DATA)).collect()) == list(range(1, n + 1))
    assert registry.QUERIES["O02_reading_order_all"](spark, str(DATA)).count() == detections


def test_string_searches_meet_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]

    def rows(name):
        return [tuple(r) for r in registry.QUERIES[name](spark, str(DATA)).collect()]

    def sequence(query):
        return {i: SequenceMatcher(None, query, t).ratio() for i, t in docs if t is not None}

    def partial(query):
        return {i: similarity.best_window_ratio(query, t) for i, t in docs if t is not None}

    assert len(docs) > 40
    assert len(rows("Y01_sequence_ratio")) == len(rows("Y02_partial_ratio")) == len(docs)
    assert dict(r for r in rows("Y01_sequence_ratio") if r[1] is not None) == sequence("the thing and the other")
    assert dict(r for r in rows("Y02_partial_ratio") if r[1] is not None) == partial("thing and")

    def best(scores, keep):
        return sorted(((i, x) for i, x in scores.items() if keep(x)), key=lambda r: (-r[1], r[0]))

    ratios = partial("thing and")
    near = {i: 100.0 if "thing and" in t or t in "thing and" else ratios[i] for i, t in docs if t is not None}
    assert rows("B05_fuzzy_search") == best(near, lambda x: x >= 70)
    assert rows("B06_fuzzy_exclusive") == best(near, lambda x: x > 50)[:50]
    whole = sequence("the thing and the other thing")
    assert rows("B07_ratio_search") == best(whole, lambda x: x > 0.3)[:12]
    first = sorted((i, x) for i, x in whole.items() if x > 0.1)[:12]
    assert rows("O06_limit_first") == best(dict(first), lambda x: True)
    held = {i: 1.0 if "thing" in t else SequenceMatcher(None, "thing", t).ratio() for i, t in docs if t is not None}
    assert rows("Y07_patch_search") == best(held, lambda x: x > 0.3)


def test_greedy_match_against_a_plain_one(spark, duck):
    relations = duck.sql(registry.ORACLE_SQL["J03_circle_text"]).fetchall()
    want, pages = set(), {}
    for page, circle, txt, conf, _ in relations:
        pages.setdefault(page, []).append((-conf, circle, txt))
    for page, rows in pages.items():
        circles, texts = set(), set()
        for conf, circle, txt in sorted(rows):
            if circle not in circles and txt not in texts:
                circles.add(circle)
                texts.add(txt)
                want.add((page, circle, txt))
    got = {(r.page_id, r.circle, r.txt) for r in registry.QUERIES["J06_greedy_match"](spark, str(DATA)).collect()}
    assert got == want and want


def test_folder_search_finds_names(spark):
    rows = registry.QUERIES["Y05_folder_names"](spark, str(DATA)).collect()
    assert len(rows) == 5 and rows[0].path == "AMERICA NATION_11 BUILDING"
    assert [r.similarity for r in rows] == sorted((r.similarity for r in rows), reverse=True)


@pytest.mark.parametrize("flags", [["A04_top_places"], ["--search", "1", "--prefecture", "ASIA", "--max-results", "7"], ["--address", "東京都港区"], ["--stats"]])
def test_flags(spark, flags):
    from mapsieve.__main__ import answer, parser

    df = answer(spark, parser().parse_args([*flags, "--tables", str(DATA)]))
    if "--search" in flags:
        rows = df.collect()
        assert len(rows) == 7 and all(r.path.startswith("ASIA/") and ("1" in r.text or r.text in "1") for r in rows)
    elif "--stats" in flags:
        assert df.first().files == spark.read.parquet(f"{DATA}/customer.parquet").count()
    else:
        df.collect()
    assert answer(spark, parser().parse_args([])) is None
