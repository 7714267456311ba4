"""Operators over pages, vectors and labels, decontamination, components and the pipeline."""

import collections
import hashlib
import itertools
import random
import struct
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapsieve.llm import components, html_mincut, ordinal_quality, permutation_index, queries, template_decontam, warc_zst
from mapsieve.llm.common import stored
from tests.llm.corpus import docs, empty, frame, word

PAGES = "page_id long, url string, html string, digest string, first_id long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 9) for i, u, h in rows], PAGES).repartition(3)


class TestWarc:
    rows = [(i, f"http://a/{i}", f"<p>{'text ' * 40}{i % 5}</p>") for i in range(40)] + [(100, None, None), (101, "u", ""), (102, "u", "tiny"), (103, "u", "tiny"), (104, "a\r\nb: c", "x" * 99), (105, "u", "x" * 99), (106, "u", "x" * 100), (107, "u", "x" * 100), (None, "u", "x" * 100), (108, "u", "é日本😀" * 60), (109, "u", "w" * 300_000), (3, "again", "<p>own</p>" * 20)]

    def want(self):
        first = {}
        for i, _, h in self.rows:
            d = (h or "").encode()
            if len(d) >= 100 and i is not None:
                first[d] = min(i, first.get(d, i))
        out = []
        for i, _, h in self.rows:
            d = (h or "").encode()
            refers = first.get(d)
            revisit = refers is not None and refers != i
            out.append((-1 if i is None else i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if revisit else "response", refers if revisit else None))
        return sorted(out, key=str)

    @pytest.mark.parametrize("size", [1 << 24, 4000])
    def test_round_trip(self, spark, size):
        archives = stored(warc_zst.write(pages(spark, self.rows), size))
        got = warc_zst.read(archives, True).collect()
        assert sorted(((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == self.want()
        payloads = collections.Counter((h or "").encode() for _, _, h in self.rows)
        assert all(payloads[r.payload] for r in got if r.record_type == "response")

    def test_one_response_for_rows_of_one_id_and_payload(self, spark):
        rows = [(1, "b", "x" * 200), (1, "a", "x" * 200), (1, "a", "x" * 200), (2, "u", "x" * 200), (1, "c", "short"), (1, "c", "short"), (None, "u", "x" * 200), (None, "u", "y" * 200), (None, "v", "y" * 200)]
        got = warc_zst.read(stored(warc_zst.write(pages(spark, rows))), True).collect()
        assert len(got) == len(rows)
        assert [(r.page_id, r.url, bytes(r.payload)) for r in got if r.record_type == "response" and r.payload_digest == hashlib.sha256(b"x" * 200).hexdigest()] == [(1, "a", b"x" * 200)]
        assert sorted(r.url for r in got if r.record_type == "revisit" and r.refers_to == 1) == ["a", "b", "u", "u"]
        assert {r.payload_bytes for r in got if r.record_type == "revisit"} == {200}
        assert sum(r.record_type == "response" for r in got) == 1 + 2 + 2

    @pytest.mark.parametrize("threshold", ["10485760", "-1"])
    def test_one_payload_of_very_many_pages(self, spark, threshold):
        rows = spark.range(300_000).selectExpr("id as page_id", "'u' as url", "if(id % 3 > 0, repeat('same ', 50), concat('page ', id div 6, repeat(' own', 30))) as html")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = stored(warc_zst.read(stored(warc_zst.write(rows))))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert {(r.record_type, r["count"]) for r in got.groupBy("record_type").count().collect()} == {("response", 50_001), ("revisit", 249_999)}
        assert got.filter("record_type = 'revisit' and refers_to = 1 and payload_bytes = 250").count() == 199_999

    def test_a_lost_response_is_an_error(self, spark):
        digest = hashlib.sha256(b"x" * 200).hexdigest()
        content = warc_zst.archive([warc_zst.information("a"), warc_zst.record(2, "u", b"x" * 200, digest, 1)])
        with pytest.raises(Exception, match="no response for the revisit of page 1"):
            warc_zst.read(spark.createDataFrame([(bytearray(content),)], "content binary")).collect()

    def test_large_records_get_a_dictionary(self):
        rng = random.Random(2)
        records = [warc_zst.record(i, "u", (" ".join(word(rng) for _ in range(120_000))).encode(), "0" * 64, None) for i in range(10)]
        assert sum(map(len, records)) > 2 * warc_zst.TRAIN_BYTES
        content = warc_zst.archive(records)
        assert struct.unpack_from("<I", content)[0] == warc_zst.DICT_FRAME and list(warc_zst.frames(content)) == records

    def test_dictionary_stands_in_front_and_frames_stand_alone(self):
        records = [warc_zst.record(i, "u", f"some payload {i} with much in common".encode() * 5, "0" * 64, None) for i in range(300)]
        content = warc_zst.archive(records)
        magic, n = struct.unpack_from("<II", content)
        assert magic == warc_zst.DICT_FRAME and 0 < n < len(content)
        assert list(warc_zst.frames(content)) == records

    def test_few_records_need_no_dictionary(self):
        records = [warc_zst.record(1, "u", b"payload", "0" * 64, None)]
        assert list(warc_zst.frames(warc_zst.archive(records))) == records

    def test_cut_archive_is_an_error(self):
        content = warc_zst.archive([warc_zst.record(1, "u", b"payload" * 500, "0" * 64, None)])
        with pytest.raises(ValueError):
            list(warc_zst.frames(content[:-5]))

    def test_files(self, spark, tmp_path):
        archives = stored(warc_zst.write(pages(spark, self.rows)))
        warc_zst.save(archives, f"file://{tmp_path}/out")
        again = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(f"file://{tmp_path}/out")
        assert warc_zst.read(again).count() == len(self.rows)

    def test_empty(self, spark):
        assert warc_zst.read(warc_zst.write(pages(spark, []))).count() == 0


class TestHtml:
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar"><header class=top>Site <a href=x>home</a></header>
    <div class="cookie-notice">We use cookies here, accept them please.</div><article><header><h1>Title &amp; more</h1></header><p>First   par&nbsp;&lt;b&gt; <i>it</i>alic.<br>second line
    <p>Second para is long enough, isn't it?<div class="ad">Buy now cheap things here!</div><section class="comments"><p>I like this comment of mine, a lot.</p></section></article>
    <aside>Related stuff that is long enough to look like a text.</aside><form>Login<input></form><!-- <p>hidden</p> --><footer>c 2020</footer></body></html>"""

    def test_article_is_kept_and_the_rest_is_not(self):
        assert html_mincut.main_text(self.page, html_mincut.PRIOR) == "Title & more\n\nFirst par <b> italic. second line\n\nSecond para is long enough, isn't it?"

    def test_marks_on_all_kinds_of_elements(self):
        page = """<body><div class="page-header">Big site name here</div><div id="main-content"><article class="post"><div class="post-header"><h1 class="title">Head line</h1></div>
        <p class="lead">First words of the text.</p><p class="ad-slot ad">Buy it now.</p><p hidden>Not shown at all.</p><ul><li>One item of a list</li><li>Two items of a list</li></ul><button>Share</button>
        <div class="usercomments"><p>Reader says so.</p></div><p>Last words.</p></article></div><div class="sidebar-left"><p>A long text in the sidebar, which goes on and on, with commas.</p></div><div role="navigation">Menu</div></body>"""
        assert html_mincut.main_text(page, html_mincut.PRIOR).split("\n\n") == ["Head line", "First words of the text.", "One item of a list", "Two items of a list", "Last words."]

    def test_page_without_marks(self):
        page = "<body><div><a href=1>Home</a> <a href=2>About</a></div><div><p>This is the first paragraph of the story, with many words in it, and commas.</p><p>Another paragraph of a similar length, which says things, more or less.</p></div><div><a href=3>Terms</a> | <a href=4>Privacy</a></div></body>"
        assert html_mincut.main_text(page, html_mincut.PRIOR).count("\n\n") == 1

    @given(st.lists(st.floats(-3, 3), min_size=1, max_size=9), st.data())
    @settings(max_examples=150, deadline=None)
    def test_cut_is_minimal(self, odds, data):
        n = len(odds)
        links = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.floats(0, 2)), max_size=12))
        links = [x for x in links if x[0] != x[1]]
        cost = lambda side: sum(-o if s is False and o > 0 else 0 for o, s in zip(odds, side, strict=True)) * -1 + sum(-o for o, s in zip(odds, side, strict=True) if s and o < 0) + sum(w for a, b, w in links if side[a] != side[b])
        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert cost(html_mincut.min_cut(odds, links)) == pytest.approx(best, abs=1e-6)

    def test_rows(self, spark):
        rows = [(1, "u", self.page), (2, None, None), (3, "u", ""), (4, "u", "plain"), (None, "u", "<p>"), (5, "u", "<p>" + "long text. " * 20_000), (1, "u", self.page), (6, "u", "<" * 2000 + "a href='"), (7, "u", "<div>" * 3000 + "x")]
        got = html_mincut.extract(pages(spark, rows)).collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert {r.text for r in got if r.page_id in (2, 3)} == {""}
        assert html_mincut.extract(pages(spark, [])).count() == 0

    @pytest.mark.parametrize("page", ["<a " * 300_000, "<a " * 300_000 + ">", '<b">"' * 200_000, "<title>" * 150_000, "</title " * 120_000 + ">", "<div>" * 100_000 + "</section>" * 100_000, "<p class='" * 100_000 + ">", "&#" + "9" * 100_000 + ";", "<![CDATA[" * 100_000 + ">", "<" * 1_000_000])
    def test_scanning_is_linear(self, page):
        began = time.perf_counter()
        html_mincut.main_text(page, html_mincut.PRIOR)
        assert time.perf_counter() - began < 5

    def test_quotes_hold_tag_ends_unless_they_stay_open(self):
        text = lambda html: [b.text for b in html_mincut.blocks(html)]
        assert text("<p title='a > b' id=\"c > d\">x</p>y") == ["x", "y"]
        assert text("<p title='a>x</p><p title=\"b\">y</p>") == ["x", "y"]
        assert text("a < b <p>c</p> d <e") == ["a < b", "c", "d <e"]
        assert text("&#0000000065;&#x41;&#99999999999;&lt;p&gt;") == ["AA\ufffd<p>"]

    def test_names_are_read_as_words(self):
        keep = "<p>Body text of the matter, long enough to stand.</p>"
        for name in ("commentary", "commentary-body", "incident-report"):
            assert "Body text" in html_mincut.main_text(f"<article><div class='{name}'>{keep}</div></article>", html_mincut.PRIOR)
        for name in ("comment", "comments", "commentList", "user-comments", "userComment", "comment_form"):
            assert html_mincut.main_text(f"<article><p>Words of the writer, enough of them.</p><div class='{name}'>{keep}</div></article>", html_mincut.PRIOR) == "Words of the writer, enough of them."

    def test_what_is_learned_from_marks_holds_without_them(self):
        rng = random.Random(11)
        line = lambda n: " ".join(word(rng) for _ in range(n))

        def page(marked):
            part = lambda tag, inside: f"<{tag if marked else 'div'}>{inside}</{tag if marked else 'div'}>"
            body = [f"{line(rng.randint(15, 60))}." for _ in range(rng.randint(3, 8))]
            menu = "".join(f"<li><a href=x>{line(1)}</a></li>" for _ in range(6))
            return part("nav", f"<ul>{menu}</ul>") + part("article", "".join(f"<p>{x}</p>" for x in body)) + part("footer", f"<p><a href=y>{line(2)}</a> {line(2)}</p>"), "\n\n".join(body)

        learned = [html_mincut.blocks(page(True)[0]) for _ in range(100)]
        rows, labels = np.concatenate([html_mincut.features(p) for p in learned]), np.array([html_mincut.own_label(b) for p in learned for b in p])
        weights = html_mincut.train(rows, labels)
        assert len(html_mincut.FEATURES) == rows.shape[1] and not set(html_mincut.FEATURES) & set(html_mincut.MARKS)
        plain = [page(False) for _ in range(100)]
        assert sum(html_mincut.main_text(html, weights) == text for html, text in plain) >= 95

    def test_an_id_that_very_many_rows_share(self, spark):
        rows = spark.range(20_000).selectExpr("1L as page_id", "'u' as url", "concat('<article><p>Some text, number ', id % 3, ', that is long enough.</p></article><nav><a>x</a></nav>') as html")
        assert html_mincut.fitted(rows).shape == html_mincut.PRIOR.shape

    def test_classifier_learns_from_marks(self):
        rng = random.Random(4)
        good = [html_mincut.blocks(f"<article><p>{' '.join(word(rng) for _ in range(30))}.</p></article><nav><a href=x>{word(rng)}</a></nav>") for _ in range(50)]
        x = np.concatenate([html_mincut.features(p) for p in good])
        y = np.array([html_mincut.own_label(b) for p in good for b in p])
        w = html_mincut.train(x, y)
        assert (((x @ w) > 0) == (y == 1)).all()


class TestQuality:
    def corpus(self, spark, n=1500):
        rng = random.Random(6)
        vocabulary = [word(rng) for _ in range(300)]
        rows, labels = [], []
        for i in range(n):
            words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
            kind = rng.choice([0, 1, 2, 2, 2])
            if kind == 0:
                words = [w.upper() + "!!" for w in words]
            elif kind == 1:
                words[rng.randrange(len(words))] = rng.choice(["nastyword", "foulword"])
            rows.append((i, " ".join(words)))
            labels.append((i, int(kind > 0), int(kind == 1)))
        return rows, labels

    def test_held_out_accuracy(self, spark):
        rows, labels = self.corpus(spark)
        table = stored(frame(spark, rows))
        known = spark.createDataFrame(labels[:1200], "doc_id long, quality int, toxic int")
        model = ordinal_quality.fit(*ordinal_quality.sampled(table, known))
        assert (np.diff(model.thresholds) > 0).all()
        got = {r.doc_id: r for r in ordinal_quality.score(table, model).collect()}
        want = {i: q + (q and not t) for i, q, t in labels[1200:]}
        assert np.mean([got[i].kept == (g == 2) for i, g in want.items()]) > 0.93
        assert all(0 <= r.expected_grade <= 2 and abs(r.kept - (r.top_tail >= 0.5)) == 0 for r in got.values())
        kept = ordinal_quality.select(table, model)
        assert kept.schema == table.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}

    def test_slopes_against_differences(self):
        rng = np.random.default_rng(3)
        position, cuts, g = rng.normal(size=60), np.array([-0.7, 0.9]), rng.integers(0, 3, 60)

        def log_chance(position, cuts):
            up = 1 / (1 + np.exp(-(position[:, None] - cuts[None, :])))
            bounds = np.concatenate([np.ones((60, 1)), up, np.zeros((60, 1))], 1)
            return np.log(bounds[np.arange(60), g] - bounds[np.arange(60), g + 1])

        by_position, by_cut = ordinal_quality.slopes(position, cuts, g)
        e = 1e-6
        assert np.allclose(by_position, (log_chance(position + e, cuts) - log_chance(position - e, cuts)) / (2 * e), atol=1e-5)
        for j in range(2):
            d = e * np.eye(2)[j]
            assert np.allclose(by_cut[:, j], (log_chance(position, cuts + d) - log_chance(position, cuts - d)) / (2 * e), atol=1e-5)

    def test_odd_rows_and_labels(self, spark):
        table = frame(spark, docs(20))
        none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        model = ordinal_quality.fit(*ordinal_quality.sampled(table, none))
        got = ordinal_quality.score(table, model).collect()
        assert len(got) == table.count() and all(r.kept for r in got)
        odd = spark.createDataFrame([(None, 1, 0), (1, None, 1), (2, 1, None), (2, 0, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
        model = ordinal_quality.fit(*ordinal_quality.sampled(table, odd))
        assert len(ordinal_quality.score(table, model).collect()) == table.count()
        assert ordinal_quality.score(empty(spark), model).count() == 0 and ordinal_quality.select(empty(spark), model).count() == 0


class TestNeighbours:
    def table(self, spark, rows):
        return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, n int").repartition(3)

    def brute(self, rows, every, k):
        out = {}
        for q, a in rows:
            if q % every == 0:
                far = sorted((float(np.sqrt(((np.float32(a).astype(float) - np.float32(b).astype(float)) ** 2).sum())), i) for i, b in rows if i != q)[:k]
                out[q] = [i for _, i in far]
        return out

    def test_recall(self, spark):
        rng = np.random.default_rng(8)
        rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(3000)]
        got = collections.defaultdict(list)
        for r in permutation_index.search(self.table(spark, rows)).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        want = self.brute(rows, 100, 10)
        assert set(got) == set(want)
        hit = sum(len({i for _, i, _ in got[q]} & set(w)) for q, w in want.items())
        assert hit >= 0.9 * sum(map(len, want.values()))
        for q, found in got.items():
            found.sort()
            assert [r for r, _, _ in found] == list(range(1, 11))
            for _, i, s in found:
                assert s == pytest.approx(np.linalg.norm(np.float32(rows[q][1]).astype(float) - np.float32(rows[i][1]).astype(float)), rel=1e-12)

    def recall(self, spark, rows, every=100):
        got = collections.defaultdict(set)
        for r in permutation_index.search(self.table(spark, rows), every).collect():
            got[r.query_id].add((r.vec_id, round(r.score, 9)))
        hits = total = 0
        for q, a in rows:
            if q % every == 0:
                far = sorted((round(float(np.sqrt(((np.float32(a).astype(float) - np.float32(b).astype(float)) ** 2).sum())), 9), i) for i, b in rows if i != q)[:10]
                hits += sum((i, d) in got[q] for d, i in far)
                total += len(far)
        return hits / total

    @pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables here")
    @pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
    def test_recall_on_the_tables(self, spark, sf):
        rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
        assert self.recall(spark, rows) >= 0.9

    def test_recall_on_clusters_and_copies(self, spark):
        rng = np.random.default_rng(21)
        centers, rows = rng.normal(size=(12, 24)), []
        for i in range(3000):
            rows.append((i, [float(x) for x in centers[i % 12] + 0.05 * rng.normal(size=24)]))
        assert self.recall(spark, rows) >= 0.9
        rows = [(i, rows[1][1] if i % 3 == 0 else v) for i, v in rows]
        assert self.recall(spark, rows) >= 0.9

    def test_hot_files_are_split(self, spark, monkeypatch):
        rng = np.random.default_rng(22)
        rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(1500)]
        ask = lambda: sorted(map(tuple, permutation_index.search(self.table(spark, rows), 20).collect()))
        whole = ask()
        monkeypatch.setattr(permutation_index, "FILE_ROWS", 7)
        monkeypatch.setattr(permutation_index, "FILE_QUERIES", 3)
        split = ask()
        assert len(split) == len(whole) and np.mean([a == b for a, b in zip(whole, split, strict=True)]) > 0.97

    def test_odd_vectors_and_ties(self, spark):
        good = [(0, [1.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 0.0])]
        bad = [(200, None), (300, [0.0, 0.0, 0.0]), (400, [float("nan"), 1.0, 0.0]), (500, [float("inf"), 1.0, 0.0]), (600, [None, 1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (700, [1.0, 2.0]), (800, [])]
        got = collections.defaultdict(list)
        for r in sorted(permutation_index.search(self.table(spark, good + bad)).collect(), key=lambda r: r["rank"]):
            got[r.query_id].append(r.vec_id)
        assert got == {0: [5, 100, 3, 7], 100: [0, 5, 3, 7]}
        assert permutation_index.search(self.table(spark, bad)).count() == 0
        assert permutation_index.search(self.table(spark, [])).count() == 0
        assert permutation_index.search(self.table(spark, good[:1])).count() == 0

    def test_footrule(self):
        assert permutation_index.footrule(np.array([0, 1, 2], dtype=np.uint8), np.array([[0, 1, 2], [2, 1, 0], [1, 0, 2]], dtype=np.uint8)).tolist() == [0, 4, 2]


class TestDecontamination:
    items = [(1, "If Mary has 7 apples and gives 5 miles to Tom then Mary walks home"), (2, "zap qux wob lim tor pin dag fex mul rod sip tan vot wex yaz"), (3, "short one"), (4, None), (2, "zap qux wob lim tor pin dag fex mul rod sip tan vot wex yaz"), (5, "a b c d e"), (6, "")]

    def tables(self, spark, rows):
        return frame(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in self.items], "item_id long, text string, rank string")

    def matches(self, items, texts):
        """The operator's steps without tables: (text number, item number, covered words)."""
        packed = lambda all_texts: (np.frombuffer(b"".join(x.encode() for x in all_texts), dtype=np.uint8), np.append(0, np.cumsum([len(x.encode()) for x in all_texts])))
        mine, theirs = template_decontam.Tokens(*packed([t for _, t in items])), template_decontam.Tokens(*packed(texts))
        size, known, hits = np.diff(mine.first), collections.defaultdict(list), collections.defaultdict(list)
        body, kinds = template_decontam.body, list(template_decontam.READINGS)
        for kind, width, keys, item, at in template_decontam.item_windows(mine):
            for key, k, i in zip(keys.tolist(), item.tolist(), at.tolist(), strict=True):
                known[key, kind, width].append((k, i))
        for kind, width, keys, doc, at in template_decontam.text_windows(theirs, sorted({x[1:] for x in known}), np.full(1 << 13, 255, dtype=np.uint8)):
            for key, d, j in zip(keys.tolist(), doc.tolist(), at.tolist(), strict=True):
                for k, i in known.get((key, kind, width), ()):
                    spot = i - int(mine.readings[kinds[kind]].first[k])
                    hits[d].append((k, items[k][0], int(size[k]), kind, j - int(theirs.readings[kinds[kind]].first[d]) - spot, spot, width, body(mine, kind, width, i), body(theirs, kind, width, j)))
        return [(d, k, n) for d, own in hits.items() for k, _, n, _ in template_decontam.aligned(own)]

    @pytest.mark.parametrize("threshold", ["10485760", "-1"])
    def test_cases(self, spark, threshold):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            self.check_cases(spark)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    def check_cases(self, spark):
        long = " ".join(word(random.Random(3)) for _ in range(30_000))
        cases = {
            10: ("Intro. If Mary has 7 apples and gives 5 miles to Tom then Mary walks home", 1),
            11: ("Intro. If Anna has 12 apples and gives 3 km to Bob then Anna walks home. End", 1),
            12: ("Intro. If Anna has 12 apples and gives 3 km to Bob then Bob walks home. End", None),
            13: ("x zap QUX wob lim tor pin dag fex mul y", 2),
            14: ("zap qux wob lim tor pin dag", None),
            15: ("AA BB CC DD EE FF GG HH II JJ KK LL", None),
            16: (None, None),
            17: ("", None),
            18: ("well a b C, d f.", None),
            21: ("well a b c, d e.", 5),
            19: (long + " zap qux wob lim tor pin dag fex mul rod sip tan vot wex yaz " + long, 2),
            20: ("Short, one!", 3),
            22: ("a short one", None),
            23: ("((((((((((((zap)))))))))))) qux wob lim tor pin dag fex mul", 2),
        }
        rows = [(i, t) for i, (t, _) in cases.items()] + [(13, cases[13][0]), (None, cases[10][0])]
        documents, benchmark = self.tables(spark, rows)
        got = template_decontam.scan(documents, benchmark).collect()
        assert len(got) == len(rows)
        for r in got:
            want = 1 if r.doc_id is None else cases[r.doc_id][1]
            assert (r.contaminated, r.item_id) == (want is not None, want), r
        stays = template_decontam.clean(documents, benchmark)
        assert stays.schema == documents.schema and {r.doc_id for r in stays.collect()} == {i for i, (_, w) in cases.items() if w is None}

    def test_empty(self, spark):
        documents, benchmark = self.tables(spark, [(1, "x")])
        assert template_decontam.scan(empty(spark), benchmark).count() == 0
        assert not template_decontam.scan(documents, benchmark.limit(0)).first().contaminated

    def found(self, item, text):
        return [n for _, _, n in self.matches([(1, item)], [text])]

    def test_names_that_open_sentences(self):
        item = "Tom has 3 apples. Ann has 5 pears. Who has more?"
        assert self.found(item, "Sam has 4 apples. Eva has 9 pears. Who has more?") == [11]
        assert self.found(item, "Sam has 4 apples. Eva has 9 pears. Who is cold?") == [9]
        assert self.found(item + " Tom or Ann?", "Sam has 4 apples. Eva has 9 pears. Who has more? Sam or Eva?") == [14]
        assert not self.found(item + " Tom or Ann?", "Sam has 4 apples. Eva has 9 pears. Who has more? Eva or Sam?")

    def test_opening_function_words_are_no_names(self):
        assert self.found("Who was the king of France?", "Who was the king of Spain?") == [6]
        assert not self.found("Who was the king of France?", "Louis was the king of Spain?")

    def test_names_of_several_words(self):
        item = "Near the old mill Tom has red apples and buys 5 more while Ann looks at pears"
        assert self.found(item, "Near the old mill Mary Ann has red apples and buys 7 more while Eva looks at pears") == [17]
        assert self.found("Tom has 3 apples. Ann has 5 pears. Who has more?", "Mary Ann has 4 apples. Eva Lou Lee has 9 pears. Who has more?") == [11]
        again = item + " so Tom goes home"
        assert self.found(again, "Near the old mill Mary Ann has red apples and buys 7 more while Eva looks at pears so Mary Ann goes home") == [21]
        assert 21 not in self.found(again, "Near the old mill Mary Ann has red apples and buys 7 more while Eva looks at pears so Eva goes home")

    def test_new_fillings_may_coincide(self):
        item = "Tom has 3 apples and buys 5 apples more on the way home"
        assert self.found(item, "Sam has 4 apples and buys 4 apples more on the way home") == [13]
        assert self.found(item.replace("5", "3"), "Sam has 4 apples and buys 4 apples more on the way home") == [13]
        assert not self.found(item.replace("5", "3"), "Sam has 4 apples and buys 6 apples more on the way home")

    def test_fillings(self):
        assert template_decontam.fillings([1, 2], [3, 4]) == {((1,), (3,)), ((2,), (4,))}
        assert template_decontam.fillings([9, 1], [9, 3, 4]) == {((9,), (9,)), ((1,), (3, 4))}
        assert template_decontam.fillings([1], [1, 4]) == {((1,), (1,))}

    def test_long_windows_against_plain_search(self, spark):
        rng = random.Random(11)
        vocabulary = ["x" + word(rng) for _ in range(40)]
        items = [(i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(20)]
        texts = []
        for i in range(200):
            words = [rng.choice(vocabulary) for _ in range(50)]
            if i % 3 == 0:
                own = rng.choice(items)[1].split()
                a = rng.randint(0, 10)
                words[10:10] = own[a : a + rng.choice([5, 9, 10, 20])]
            texts.append(" ".join(words))
        found = collections.defaultdict(set)
        for d, k, n in self.matches(items, texts):
            found[d].add((k, n))
        for d, text in enumerate(texts):
            assert found[d] == set(self.plain(items, text.split()))
        got = template_decontam.scan(frame(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {r.doc_id: r.n_items for r in got} == {d: len(found[d]) for d in range(len(texts))}

    def test_templates_against_plain_search(self, spark):
        """Items with numbers and one-word names inside a sentence, refilled: what the rules say, checked place by place."""
        rng = random.Random(13)
        vocabulary = ["x" + word(rng) for _ in range(30)]
        names = ["Ann", "Bob", "Eva", "Tom"]

        def sentence():
            return [rng.choice(vocabulary) if rng.random() < 0.75 else rng.choice(names) if rng.random() < 0.5 else str(rng.randint(1, 9)) for _ in range(18)]

        items = [(i, " ".join(["start", *sentence()])) for i in range(15)]
        texts = []
        for i in range(150):
            words = ["begin", *sentence(), *sentence()]
            if i % 2:
                own = rng.choice(items)[1].split()
                swap = {w: rng.choice(names) if w in names else str(rng.randint(1, 99)) for w in own if w in names or w.isdigit()}
                if i % 3 == 0:
                    swap = {w: w for w in swap}
                own = [swap.get(w, w) for w in own]
                if i % 5 == 0:
                    at = rng.randrange(len(own))
                    own[at] = rng.choice(names)
                words[10:10] = own[rng.randint(0, 6) :]
            texts.append(" ".join(words))
        got = collections.defaultdict(set)
        for d, k, n in self.matches(items, texts):
            got[d].add((k, n))
        kind = lambda w: "#" if w.isdigit() else "@" if w in names else w
        for d, text in enumerate(texts):
            theirs, want = text.split(), set()
            for k, (_, t) in enumerate(items):
                mine, best = t.split(), 0
                for shift in range(-len(mine), len(theirs)):
                    covered = set()
                    for p in range(max(0, -shift), min(len(mine), len(theirs) - shift) - 7):
                        a, b = mine[p : p + 8], theirs[p + shift : p + shift + 8]
                        if a == b or (list(map(kind, a)) == list(map(kind, b)) and sum(map(str.islower, a)) >= 4):
                            covered |= set(range(p, p + 8))
                    pairs = {(mine[p], theirs[p + shift]) for p in covered if kind(mine[p]) in "#@"}
                    if len(covered) >= 9.5 and len({a for a, _ in pairs}) == len(pairs):
                        best = max(best, len(covered))
                if best:
                    want.add((k, best))
            runs = {(k, n) for k, n in got[d] if (k, n) not in want}
            assert want <= got[d] | {(k, n) for k, n in want for m, more in got[d] if m == k and more >= n}
            # readings that join runs of names may find more, never in a text that holds no item
            assert d % 2 or not runs, (d, runs)

    def plain(self, items, words):
        for k, (_, t) in enumerate(items):
            own, best = t.split(), 0
            for shift in range(-len(own), len(words)):
                covered = set()
                for p in range(len(own) - 7):
                    if 0 <= p + shift and p + shift + 8 <= len(words) and own[p : p + 8] == words[p + shift : p + shift + 8]:
                        covered |= set(range(p, p + 8))
                if len(covered) >= 10:
                    best = max(best, len(covered))
            if best:
                yield k, best


def test_components(spark):
    rng = random.Random(12)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    edges = chain + [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(7, 7), (5000, 5001), (5001, 5000)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage against its operator's plain form, on what the stage before kept."""
    import corpus_pipeline
    from mapsieve.llm import sentencepiece_sa, suffix_dedup
    from tests.llm.test_texts import TestJaccardJoin

    rows = [(i, t) for i, t in docs(50) if len(t or "") < 20_000]
    leak = TestDecontamination.items[1][1]
    rows += [(900, "begin of text " + leak + " end of text"), (901, "quite another text " + leak)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(2, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in now.collect()]
        out = stored(stage(spark, now, str(tmp_path)))
        after = out.collect()
        if k < 4:
            assert out.schema == now.schema
        if k == 0:
            assert {(r.doc_id, r.text) for r in after} <= set(before)
        elif k == 1:
            want = TestJaccardJoin().brute(before)
            assert {r.doc_id for r in after} == {d for d, n, comp in want if not n or comp == d}
        elif k == 2:
            digests = {(r.doc_id, r.kept_sha256) for r in suffix_dedup.dedup(now).collect()}
            assert all((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) in digests for r in after)
        elif k == 3:
            assert {r.doc_id for r in after} == {d for d, t in before if leak not in (t or "")}
        else:
            assert sentencepiece_sa.decode(out).count() == len(before) and all(r.round_trip for r in after)
        now = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


TABLES = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(TABLES))
    assert sorted(found.columns) == sorted(got.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in got.select(*found.columns).collect())
