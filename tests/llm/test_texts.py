"""Operators over documents, against plain versions on a small corpus with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from mapsieve.llm import bitmap_join, common, hash_ring, lm_bloom, sentencepiece_sa, suffix_dedup
from tests.llm.corpus import docs, empty, frame, word

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return docs()


@pytest.fixture(scope="module")
def table(spark, rows):
    return common.stored(frame(spark, rows))


def raw(text):
    return (text or "").encode()


def lower(data):
    return data.lower()


def test_words_are_split_as_the_pattern_says(rows):
    for _, text in rows:
        data = raw(text)
        start, end, _ = common.words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
        assert [data[a:b] for a, b in zip(start, end, strict=True)] == WORD.findall(data)


class TestLanguageModel:
    def brute(self, rows):
        counts = collections.Counter()
        for i, text in rows:
            if i is None or zlib.crc32(str(i).encode()) % 10:
                counts.update([*WORD.findall(lower(raw(text))), None])
        total, types = sum(counts.values()), len(counts)
        out = []
        for i, text in rows:
            tokens = [*WORD.findall(lower(raw(text))), None]
            out.append((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (types + 1))) for t in tokens), 6)))
        return sorted(out)

    @pytest.mark.parametrize("limit", [lm_bloom.MAX_FILTER_BYTES, 0])
    def test_counts_and_base(self, table, rows, limit):
        got = lm_bloom.score(table, limit).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == self.brute(rows)
        assert all(r.score >= r.base_score - math.log10(len(lm_bloom.WEIGHTS)) - 1e-9 and r.score < 0 for r in got)

    def test_both_ways_give_the_same_scores(self, table):
        a, b = (sorted(((r.doc_id, r.score) for r in lm_bloom.score(table, limit).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])) for limit in (lm_bloom.MAX_FILTER_BYTES, 0))
        assert a == b

    def test_filter_returns_levels(self):
        rng = np.random.default_rng(3)
        names = np.unique(rng.integers(0, 2**32, 20_000, dtype=np.uint32))
        counts = rng.integers(1, 500, len(names)).astype(float)
        page = lm_bloom.page_of(names, counts)
        held = lm_bloom.probe(page, np.zeros(len(names), dtype=np.int64), np.full(len(names), 8 * len(page)), names)
        level = 1 + np.floor(np.log(counts) / math.log(lm_bloom.LEVEL_BASE) + 1e-9)
        assert (held >= level).all() and (held == level).mean() > 0.97
        others = np.setdiff1d(rng.integers(0, 2**32, 20_000, dtype=np.uint32), names)
        absent = lm_bloom.probe(page, np.zeros(len(others), dtype=np.int64), np.full(len(others), 8 * len(page)), others)
        assert (absent > 0).mean() < 0.02

    def exact(self, rows):
        """Scores with exact bigram counts in place of the filter's (each read as the middle of its level)."""
        n, pairs, texts = collections.Counter(), collections.Counter(), []
        for i, text in rows:
            tokens = [*WORD.findall(lower(raw(text))), None]
            texts.append(tokens)
            if i is None or zlib.crc32(str(i).encode()) % 10:
                n.update(tokens)
                n["start"] += 1
                pairs.update(zip(["start", *tokens[:-1]], tokens, strict=True))
        total, types = sum(n.values()) - n["start"], len(n) - 1
        out = []
        for tokens in texts:
            sums = []
            for weight in lm_bloom.WEIGHTS:
                sums.append(0.0)
                for v, w in zip(["start", *tokens[:-1]], tokens, strict=True):
                    p = (n[w] + 0.1) / (total + 0.1 * (types + 1))
                    k = pairs[v, w]
                    level = 1 + math.floor(math.log(k) / math.log(lm_bloom.LEVEL_BASE) + 1e-9) if k else 0
                    k = min(lm_bloom._LEVEL_COUNT[level], n[v], n[w])
                    sums[-1] += math.log10(weight * k / n[v] + (1 - weight) * p) if n[v] else math.log10(p)
            top = max(sums)
            out.append(top + math.log10(sum(10 ** (x - top) for x in sums) / len(sums)))
        return out

    def test_scores_against_exact_counts(self, table, rows):
        short = [r for r in rows if len(r[1] or "") < 5000]
        got = lm_bloom.score(table.filter("text is null or length(text) < 5000")).collect()
        scores = {(r.doc_id, r.n_tokens): r.score for r in got}
        off = [abs(scores[i, len(WORD.findall(raw(t))) + 1] - want) for (i, t), want in zip(short, self.exact(short), strict=True)]
        # a false positive of the filter (one probe in some 300) raises one token of a text
        assert np.mean(np.array(off) < 1e-9) > 0.6 and max(off) < 20

    def test_scores_do_not_depend_on_the_settings(self, spark, table):
        before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
        for parts in ("4", "64", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm_bloom.score(table).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert found[0] == found[1] == found[2]

    def test_held_out_copies_score_better_than_base(self, table):
        r = lm_bloom.score(table).collect()
        assert sum(x.score for x in r) > sum(x.base_score for x in r)

    def by_hand(self, rows, size, bits=4):
        """Messages and scores without Spark, in chunks of so many rows."""
        chunks = []
        for at in range(0, len(rows), size):
            data = [raw(t) for _, t in rows[at : at + size]]
            ids, known = np.array([i or 0 for i, _ in rows[at : at + size]]), np.array([i is not None for i, _ in rows[at : at + size]])
            chunks.append(common.table(common.PACKED, chunk=[at], size=[sum(map(len, data))], ids=[ids.tobytes()], known=[known.tobytes()], offsets=[np.cumsum([0, *map(len, data)]).tobytes()], data=[b"".join(data)], rest_offsets=[b""], rest=[b""]))
        asked = pa.Table.from_batches(lm_bloom._request(bits)(iter(chunks)))
        of = np.array(asked["bucket"])
        answers = pa.concat_tables(lm_bloom._reduce(False)((pa.scalar(int(b)),), asked.filter(pa.array(of == b))) for b in np.unique(of)).to_pylist()
        rows_ = [pa.record_batch([*x.columns, pa.array([[a["reply"] for a in answers if a["chunk"] == x["chunk"][0].as_py()]], pa.list_(pa.binary()))], [*x.schema.names, "replies"]) for x in chunks]
        train_docs = sum(i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows)
        out = pa.Table.from_batches(lm_bloom._score(bits, sum(a["tokens"] for a in answers), sum(a["types"] for a in answers), train_docs, None)(iter(rows_)))
        return asked, out["score"].to_pylist()

    def test_a_bigram_is_probed_once_whatever_the_number_of_chunks(self, rows, monkeypatch):
        probed, probe = [], lm_bloom.probe
        monkeypatch.setattr(lm_bloom, "probe", lambda *x: probed.append(len(x[-1])) or probe(*x))
        asked, _ = self.by_hand(rows, 5)
        bigrams = {x for _, t in rows for w in [[*WORD.findall(lower(raw(t))), None]] for x in zip(["start", *w[:-1]], w, strict=True)}
        assert sum(probed) == len(bigrams)
        sent = list(zip(asked["chunk"].to_pylist(), asked["bucket"].to_pylist(), strict=True))
        assert len(sent) == len(set(sent))

    def test_bigrams_that_share_a_name_keep_their_own_words(self, rows, monkeypatch):
        names = lm_bloom._names
        monkeypatch.setattr(lm_bloom, "_names", lambda pairs, bits: names(pairs, bits) >> np.uint64(25) << np.uint64(25))
        (_, one), (_, many) = self.by_hand(rows, len(rows)), self.by_hand(rows, 3)
        assert one == many

    def test_scores_by_hand_are_those_of_the_query(self, table, rows):
        assert sorted(self.by_hand(rows, 7)[1]) == sorted(r.score for r in lm_bloom.score(table).collect())

    def test_empty(self, spark):
        assert lm_bloom.score(empty(spark)).count() == 0


class TestSuffixDedup:
    def brute(self, rows):
        n = suffix_dedup.LENGTH
        seen = collections.Counter(d[i : i + n] for _, t in rows for d in [raw(t)] for i in range(len(d) - n + 1))
        out = []
        for i, t in rows:
            d = raw(t)
            gone = bytearray(len(d))
            for k in range(len(d) - n + 1):
                if seen[d[k : k + n]] > 1:
                    gone[k : k + n] = b"\1" * n
            kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
            out.append((-1 if i is None else i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
        return sorted(out)

    @pytest.mark.parametrize("crowd", [20_000, 0])
    def test_against_all_substrings(self, table, rows, crowd):
        small = [(i, t) for i, t in rows if len(t or "") < 5000]
        t = table.filter("text is null or length(text) < 5000")
        got = suffix_dedup.dedup(t, crowd=crowd).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == self.brute(small)

    def test_refinement_against_all_strings(self):
        rng, n = np.random.default_rng(5), suffix_dedup.LENGTH
        own = rng.integers(0, 3, 900, dtype=np.uint8)
        texts = [own, np.concatenate([own[300:620], rng.integers(0, 3, 300, dtype=np.uint8)]), np.zeros(500, dtype=np.uint8)]
        starts = [np.arange(0, len(t) - n + 1) for t in texts]
        starts[0] = starts[0][starts[0] != 350]
        seen = collections.Counter(t[i : i + n].tobytes() for t, s in zip(texts, starts, strict=True) for i in s)
        for t, s, hit in zip(texts, starts, suffix_dedup.refine(texts, starts), strict=True):
            assert [seen[t[i : i + n].tobytes()] > 1 for i in s] == hit.tolist()

    def test_one_passage_in_very_many_documents(self, spark):
        rng = random.Random(9)
        passage = " ".join(word(rng) for _ in range(70))[:260]
        few = [(i, f"{passage}{' ' + word(rng) if i % 7 else ''}") for i in range(100)]
        table = spark.createDataFrame(few, "doc_id long, text string").crossJoin(spark.range(1000).withColumnRenamed("id", "k")).selectExpr("doc_id * 1000 + k as doc_id", "text")
        got = suffix_dedup.dedup(table).agg({"n_removed": "sum", "n_bytes": "sum", "n_spans": "sum", "*": "count"}).first()
        assert got["count(1)"] == got["sum(n_spans)"] == 100_000 and got["sum(n_removed)"] == got["sum(n_bytes)"]

    def test_long_texts(self, table, rows):
        got = {r.doc_id: r for r in suffix_dedup.dedup(table).collect()}
        long = max(rows, key=lambda r: len(r[1] or ""))
        assert got[long[0]].n_removed >= len(raw(long[1])) // 2 - 1

    def test_cut_keeps_columns(self, table, rows):
        out = suffix_dedup.cut(table)
        assert out.schema == table.schema
        digests = {(r.doc_id, r.kept_sha256) for r in suffix_dedup.dedup(table).collect()}
        for r in out.collect():
            assert (r.extra, r.rank, r["count"], r.rest) == ("e", 1, 2, "r")
            assert (r.doc_id, hashlib.sha256(raw(r.text)).hexdigest()) in digests

    def test_empty(self, spark):
        assert suffix_dedup.dedup(empty(spark)).count() == 0
        assert suffix_dedup.cut(empty(spark)).count() == 0


class TestJaccardJoin:
    def sets(self, rows):
        out = []
        for _, t in rows:
            w = WORD.findall(lower(raw(t)))
            out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        return out

    def brute(self, rows):
        sets = self.sets(rows)
        up = list(range(len(rows)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        lowest = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                lowest[find(i)] = min(d, lowest.get(find(i), d))
        return [(d, len(sets[i]), lowest.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]

    def test_against_all_pairs(self, table, rows):
        key = lambda x: tuple((y is None, y or 0) for y in x)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in bitmap_join.join(table).collect()]
        assert sorted(got, key=key) == sorted(self.brute(rows), key=key)

    @pytest.mark.parametrize("wide", [1, 3])
    def test_wide_components_are_cut_up_without_loss(self, spark, rows, wide):
        rng = random.Random(5)
        base = [word(rng) for _ in range(60)]
        near = []
        for i in range(40):
            base = [w if rng.random() > 0.012 else word(rng) for w in base]
            near.append((i, " ".join(base)))
        want = self.brute(near)
        assert 1 < len({x[2] for x in want}) < 40
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in bitmap_join.join(frame(spark, near), wide).collect()]
        assert sorted(got) == sorted(want)

    @pytest.mark.parametrize("hot", [1, 2])
    def test_hot_shingles_lose_no_link(self, table, rows, hot):
        key = lambda x: tuple((y is None, y or 0) for y in x)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in bitmap_join.join(table, 3, hot).collect()]
        assert sorted(got, key=key) == sorted(self.brute(rows), key=key)

    def test_linked_sets_share_a_posted_shingle(self):
        rng = np.random.default_rng(14)
        for _ in range(40):
            base = rng.integers(0, 2**40, int(rng.integers(4, 60)), dtype=np.uint64)
            sets = []
            for _ in range(12):
                own = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1])]
                sets.append(np.unique(np.concatenate([own, rng.integers(0, 2**40, int(rng.integers(0, 4)), dtype=np.uint64), base[:1]])))
            joined, begin = np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets]))
            _, back, n = np.unique(joined, return_inverse=True, return_counts=True)
            place, own = bitmap_join.heads(joined, begin, bitmap_join.step_of(n)[back])
            posted = [set(joined[place[own == k]].tolist()) for k in range(len(sets))]
            for x, y in itertools.combinations(range(len(sets)), 2):
                both = len(np.intersect1d(sets[x], sets[y]))
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    assert posted[x] & posted[y]

    def test_a_large_group_of_near_copies(self, spark):
        rng = random.Random(15)
        base = [word(rng) for _ in range(120)]
        rows = [(i, " ".join(w if rng.random() > 0.004 else word(rng) for w in base)) for i in range(2500)] + [(i, " ".join(word(rng) for _ in range(60)) + " " + " ".join(base[:40])) for i in range(3000, 3300)]
        got = {r.doc_id: r.component_id for r in bitmap_join.join(frame(spark, rows)).collect()}
        sets = self.sets(rows)
        for i in rng.sample(range(2500), 200):
            near = sum(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(0, 2500, 10) if j != i)
            assert not near or got[i] == 0
        assert all(got[i] == i for i in range(3000, 3300))

    def test_one_of_each(self, table, rows):
        out = bitmap_join.one_of_each(table)
        assert out.schema == table.schema
        got = collections.Counter(r.doc_id for r in out.collect())
        want = self.brute(rows)
        assert set(got) == {d for d, n, comp in want if not n or comp == d}
        assert all(got[d] == (1 if n else sum(1 for x in want if x[0] == d and not x[1])) for d, n, comp in want if d is not None and d in got)

    def test_threshold_is_inclusive(self, spark):
        words = [f"w{i}" for i in range(13)]  # 9 shingles; without the last word 8 of 9 stay, without two 7 of 9
        got = {r.doc_id: r.component_id for r in bitmap_join.join(frame(spark, [(1, " ".join(words)), (2, " ".join(words[:12])), (3, " ".join(words[:11])), (4, " ".join(words[:10]))])).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 1}
        got = {r.doc_id: r.component_id for r in bitmap_join.join(frame(spark, [(1, " ".join(words)), (3, " ".join(words[:11]))])).collect()}
        assert got == {1: 1, 3: 3}
        ten = [f"v{i}" for i in range(9)]  # 5 shingles, and 4 of them: exactly 0.8
        got = {r.doc_id: r.component_id for r in bitmap_join.join(frame(spark, [(7, " ".join(ten)), (5, " ".join(ten[:8]))])).collect()}
        assert got == {7: 5, 5: 5}

    def test_bitmaps_bound_the_difference(self):
        rng = np.random.default_rng(5)
        for size in (10, 200, 3000):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 2**63, size, dtype=np.uint64)]))
            x, y = (np.frombuffer(bitmap_join.bitmap(s), dtype=np.uint64)[None] for s in (a, b))
            least = 64 * min(x.shape[1], y.shape[1])
            differ = int(np.bitwise_count(bitmap_join.folded(x, least) ^ bitmap_join.folded(y, least)).sum())
            assert differ <= len(np.setxor1d(a, b))

    def test_empty(self, spark):
        assert bitmap_join.join(empty(spark)).count() == 0
        assert bitmap_join.one_of_each(empty(spark)).count() == 0


class TestShards:
    def test_law_and_slots(self, table, rows):
        got = hash_ring.shard(table).collect()
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by[s]) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
        want = sorted((-1 if i is None else i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t in rows)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want

    @pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 5000])
    def test_plan_covers_every_rank_once(self, n):
        rng = random.Random(n)
        counts = collections.Counter(rng.choice([7, rng.randrange(hash_ring.SLOTS)]) for _ in range(n))
        seen, places = collections.Counter(), collections.defaultdict(list)
        for slot, lo, hi, shard, base, _ in hash_ring.plan(dict(counts), 40):
            for rank in range(lo, hi + 1):
                seen[slot, rank] += 1
                places[shard].append(base + rank - 1)
        assert seen == collections.Counter({(s, r): 1 for s, k in counts.items() for r in range(1, k + 1)})
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        assert not n or max(map(len, places.values())) - (min(map(len, places.values())) if len(places) == 40 else 0) <= 1

    def test_few_rows_move_from_home(self):
        counts = {s: 3 for s in range(hash_ring.SLOTS)}
        moved = sum(hi - lo + 1 for _, lo, hi, shard, _, home in hash_ring.plan(counts, 40) if shard != home)
        assert moved < 0.2 * 3 * hash_ring.SLOTS

    def test_empty(self, spark):
        assert hash_ring.shard(empty(spark)).count() == 0

    def test_one_key_of_very_many_rows(self, spark):
        rows = spark.range(150_000).selectExpr("cast(if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as long) as doc_id", "if(id % 6 < 3, 'same', concat('text ', id)) as text")
        got = hash_ring.shard(rows)
        sizes = got.groupBy("shard").agg({"*": "count", "slot": "max"}).collect()
        assert len(sizes) == 40 and all(r["count(1)"] == r["max(slot)"] + 1 == 3750 for r in sizes)
        assert got.select("shard", "slot").distinct().count() == 150_000
        assert got.groupBy("doc_id", "size", "text_crc32").count().exceptAll(rows.selectExpr("doc_id", "cast(length(text) + 16 as long) as size", "crc32(cast(text as binary)) as text_crc32").groupBy("doc_id", "size", "text_crc32").count()).count() == 0


class TestSentencePiece:
    def test_against_the_library(self, table, rows):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL)
        got = sentencepiece_sa.encode(table, with_pieces=True).collect()
        want = sorted((-1 if i is None else i, tuple(sp.encode(t or ""))) for i, t in rows)
        assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.pieces)) for r in got) == want
        assert all(r.round_trip and r.n_pieces == len(r.pieces) and r.ids_crc32 == zlib.crc32(np.array(r.pieces, dtype="<i4").tobytes()) for r in got)

    def test_decoding(self, table, rows):
        out = sentencepiece_sa.decode(sentencepiece_sa.encode(table, with_pieces=True)).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out) == sorted((-1 if i is None else i, t or "") for i, t in rows)

    def test_odd_strings(self):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL)
        rng = random.Random(9)
        texts = ["  two  spaces ", "\n\n x\ty", "\x00a\x00", "a" * 70, "<s> </s> <0x0A>", "   ", "x▁y ▁", "1234567890.123", "if x:\n        return  y\n"]
        texts += ["".join(rng.choice("aabbe  \n.,tion") for _ in range(rng.randint(0, 60))) for _ in range(300)]
        got = sentencepiece_sa.Encoder(sentencepiece_sa.load()).encode([t.encode() for t in texts])
        assert [x.tolist() for x in got] == [sp.encode(t) for t in texts]

    def test_units_that_come_again_are_remembered_and_others_forgotten(self, monkeypatch):
        import sentencepiece

        monkeypatch.setattr(sentencepiece_sa, "CACHE_UNITS", 40)
        monkeypatch.setattr(sentencepiece_sa, "CACHE_IDS", 300)
        sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.MODEL)
        encoder, rng = sentencepiece_sa.Encoder(sentencepiece_sa.load()), random.Random(4)
        letters, kept = "aeiouß中é.,#$'- \nstr19", []
        for _ in range(40):
            texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + " the same words" for _ in range(rng.randint(0, 12))]
            found = encoder.encode([t.encode() for t in texts])
            assert [x.tolist() for x in found] == [sp.encode(t) for t in texts]
            assert encoder.decode(found) == [t.encode() for t in texts]
            kept.append(len(encoder.names))
        assert min(kept[10:]) < max(kept) and (np.diff(encoder.names.astype(object)) > 0).all()

    def test_pieces_that_span_words(self):
        merges = ["ab", "▁a", "b▁", "b▁a", "▁ab", ".a", "ab.", "é.", "▁▁", "ab▁a"]
        vocabulary = [(x, 0.0, "normal") for x in "▁abé."] + [(x, -1.0 - k, "normal") for k, x in enumerate(merges)] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
        score, ids = {x: s for x, s, _ in vocabulary}, {x: i for i, (x, _, _) in enumerate(vocabulary)}

        def merged(text):
            parts = list("▁" + text.replace(" ", "▁")) if text else []
            while True:
                best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
                if best is None:
                    return [k for x in parts for k in ([ids[x]] if x in ids else [ids[f"<0x{b:02X}>"] for b in x.encode()])]
                parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]

        rng = random.Random(6)
        texts = ["".join(rng.choice("aabb  .éx") for _ in range(rng.randint(0, 30))) for _ in range(400)]
        encoder = sentencepiece_sa.Encoder(sentencepiece_sa.Pieces(vocabulary))
        found = encoder.encode([t.encode() for t in texts])
        assert [x.tolist() for x in found] == [merged(t) for t in texts]
        assert encoder.decode(found) == [t.encode() for t in texts]

    def test_suffix_array(self):
        rng = random.Random(2)
        text = "".join(rng.choice("ab") for _ in range(400)).encode()
        order, keys = sentencepiece_sa.suffix_array(np.frombuffer(text, dtype=np.uint8), 20)
        want = [(text[i:] + b"\xff" * 20)[:20] for i in range(len(text))]
        assert [k.ljust(20, b"\0") for k in keys.tolist()] == sorted(want) and [want[i] for i in order] == sorted(want)

    def test_empty(self, spark):
        assert sentencepiece_sa.encode(empty(spark)).count() == 0


def test_chunks_stay_in_their_tasks_buckets(spark, table):
    import pyspark.sql.functions as F

    ids = [0, 1, -1, 2**40 + 5, 2**62, -(2**63)]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in ids], "x long").select(F.hash("x")).collect()] == common.spark_hash(np.array(ids)).tolist()
    for part, seq, buckets in itertools.product((0, 7, 1000), range(6), (1, 4, 211, 3000)):
        found = common.chunk_id(part, seq, buckets)
        assert int(common.spark_hash(np.array([found]))[0]) % buckets == (part * common.SPREAD + seq % common.SPREAD) % buckets
    corpus = common.packed(table)
    assert sum(len(common.unpacked(r.asDict())[0]) for r in corpus.rows.collect()) == table.count()


def test_intermediate_tables_can_be_released(spark):
    out = stored = common.stored(spark.range(3).toDF("x"))
    path = common._written[-1][0].removeprefix("file://")
    assert out.count() == 3 and stored is out
    kept, common._written[:] = common._written[:-1], common._written[-1:]
    common.release(spark)
    common._written[:] = kept
    assert not Path(path).exists()
