"""Language-model scoring from a log-frequency Bloom filter.

Counting: every chunk of the packed corpus sends each hash bucket one message with its distinct
words and bigrams there and their counts in training.  A bucket adds them up and turns its bigrams
into one page of the filter: a bigram with count c enters the page with each of the levels
1 .. 1 + floor(log(c) / log(LEVEL_BASE)).  The count is read back by probing level after level
until one is missing.  The bucket probes its page once for each bigram that any chunk has, and
answers every message with exact word counts and bigram levels.

Scoring: with c(v, w) from the filter (at most min(c(v), c(w))) and exact word counts, a bigram
model ``L * c(v, w) / c(v) + (1 - L) * P(w)`` is summed for each L in WEIGHTS, and the score is
the log10 of the equal mixture of these document probabilities.  A document that resembles
nothing in the corpus therefore loses at most log10(len(WEIGHTS)) against the base.

The number of buckets, and so of pages, follows from the bytes of the corpus alone, so neither the
scores nor a bucket's size depend on the session's settings or on how the rows are dealt.

No page needs to leave its bucket.  A caller may have the pages broadcast while they total at most
``max_filter_bytes``, and the chunks probe them; this costs more and gives the same score.

Defined results: a null or blank text is the end token alone; a null doc_id trains and is not
held out; repeated rows count each time; an empty table gives no rows; words are told apart by a
64-bit hash; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapsieve.llm import common as c

LEVEL_BASE = 1.5
BITS_PER_ENTRY = 12
PROBES = 7
WEIGHTS = (0.0, 0.1, 0.35, 0.7, 0.95)
MAX_FILTER_BYTES = 128 << 20
#: Text bytes of a chunk here, and of the slices in which its words are hashed.
CHUNK_BYTES, SLICE_BYTES = 4 << 20, 1 << 18
_END, _START = np.uint64(0xE0D), np.uint64(0x57A27)
_LEVELS = 64
#: The count that a level stands for: the middle of the counts that it holds.
_LEVEL_COUNT = np.array([0.0] + [max(1.0, (math.ceil(LEVEL_BASE ** (j - 1)) + math.ceil(LEVEL_BASE**j) - 1) / 2) for j in range(1, _LEVELS)])

#: body: words (8 bytes each) and their counts (4), then bigrams (4) and their counts (4).
_MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.int32()), ("body", pa.binary())])
#: reply: the bucket, the number of words (4 bytes each), their counts (8) and the bigrams' levels (1); of a page (chunk null), its bytes.
_ANSWER = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("reply", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])


def held_out(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.fromiter((k and zlib.crc32(str(i).encode()) % 10 == 0 for i, k in zip(ids.tolist(), known.tolist(), strict=True)), dtype=bool, count=len(ids))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then the end of each document), of the token before each, and where each document begins."""
    docs = len(offsets) - 1
    parts, firsts, n, at = [], [], 0, 0
    while at < docs:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        hashes, first = c.word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        parts.append(hashes)
        firsts.append(first[:-1] + n)
        n, at = n + len(hashes), to
    hashes, first = np.concatenate(parts), np.append(np.concatenate(firsts), n)
    begin = first + np.arange(docs + 1)
    token = np.full(len(hashes) + docs, _END, dtype=np.uint64)
    is_word = np.ones(len(token), dtype=bool)
    is_word[begin[1:] - 1] = False
    token[is_word] = hashes
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[begin[:-1]] = _START
    return token, before, begin


def _pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The hash of each bigram."""
    return c.mix(before * np.uint64(0xD6E8FEB86659FD93) + token)


def _names(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 further bits of each bigram's hash, as one number, by which messages and pages tell bigrams apart."""
    return pairs >> np.uint64(32 - bits)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order; the order of all keys, and where in it each distinct one begins."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], order, at


def _places(order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every key the place of its distinct one; see _distinct."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.repeat(np.arange(len(at)), np.diff(at, append=len(order)))
    return out


def _request(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64)
        for row in c.rows_of(batches):
            ids, known, offsets, data = c.unpacked(row)
            token, before, begin = _tokens(data, offsets)
            train = np.repeat(~held_out(ids, known), np.diff(begin)).astype(np.uint32)
            words, order, at = _distinct(token)
            seen = np.add.reduceat(train[order], at, dtype=np.uint32)
            pairs, order, at = _distinct(_names(_pairs(before, token), bits))
            hits = np.add.reduceat(train[order], at, dtype=np.uint32)
            w, p = (np.concatenate([[0], np.searchsorted(names, edges << np.uint64(shift)), [len(names)]]) for names, shift in ((words, 64 - bits), (pairs, 32)))
            names = pairs.astype(np.uint32)
            there = np.flatnonzero((np.diff(w) > 0) | (np.diff(p) > 0))
            body = [words[w[b] : w[b + 1]].tobytes() + seen[w[b] : w[b + 1]].tobytes() + names[p[b] : p[b + 1]].tobytes() + hits[p[b] : p[b + 1]].tobytes() for b in there]
            yield c.table(_MESSAGE, bucket=there.astype(np.int32), chunk=[row["chunk"]] * len(there), words=np.diff(w)[there].astype(np.int32), body=body)

    return run


def page_of(rem: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The filter page (bytes) of bigrams with the given 32-bit names and counts."""
    level = np.minimum(1 + np.floor(np.log(count) / math.log(LEVEL_BASE) + 1e-9), _LEVELS - 1).astype(np.int64)
    entry = np.repeat(rem.astype(np.uint64), level)
    step = np.arange(len(entry)) - np.repeat(np.cumsum(level) - level, level) + 1
    size = max(64, (len(entry) * BITS_PER_ENTRY + 63) // 64 * 64)
    page = np.zeros(size, dtype=bool)
    a, b = _seeds(entry, step.astype(np.uint64))
    for k in range(PROBES):
        page[(a + np.uint64(k) * b) % np.uint64(size)] = True
    return np.packbits(page, bitorder="little")


def _seeds(rem: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = c.mix(rem + (level << np.uint64(32)))
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


def probe(pages: np.ndarray, begin: np.ndarray, size: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """Levels of bigrams (0: absent). pages: joined bytes; begin (in bytes) and size (in bits): those of each bigram's page."""
    found = np.zeros(len(rem), dtype=np.int64)
    live = np.flatnonzero(size > 0)
    for level in range(1, _LEVELS):
        a, b = _seeds(rem[live].astype(np.uint64), np.full(len(live), level, dtype=np.uint64))
        at, most = begin[live], size[live].astype(np.uint64)
        left = np.arange(len(live))
        for k in range(PROBES):
            spot = ((a[left] + np.uint64(k) * b[left]) % most[left]).astype(np.int64)
            left = left[(pages[at[left] + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 > 0]
        live = live[left]
        if not len(live):
            break
        found[live] = level
    return found


def _reduce(with_page: bool):
    """A bucket's answers to its messages; with_page: and its page."""

    def run(key, messages):
        bucket, bodies = key[0].as_py(), [x.as_buffer() for x in messages.column("body")]
        n_words = messages.column("words").to_numpy()
        n_pairs = (np.array([len(x) for x in bodies]) - 12 * n_words) // 8

        def joined(kind, n, at):
            return np.concatenate([np.frombuffer(x, dtype=kind, count=k, offset=i) for x, k, i in zip(bodies, n.tolist(), at.tolist(), strict=True)])

        _, order, at = _distinct(joined(np.uint64, n_words, 0 * n_words))
        total = np.add.reduceat(joined(np.uint32, n_words, 8 * n_words)[order], at, dtype=np.int64)
        counts = total[_places(order, at)]
        names, order, at = _distinct(joined(np.uint32, n_pairs, 12 * n_words))
        hits = np.add.reduceat(joined(np.uint32, n_pairs, 12 * n_words + 4 * n_pairs)[order], at, dtype=np.int64)
        page = page_of(names[hits > 0], hits[hits > 0])
        levels = probe(page, np.zeros(len(names), dtype=np.int64), np.full(len(names), 8 * len(page)), names).astype(np.uint8)[_places(order, at)]
        w, p = np.cumsum(n_words), np.cumsum(n_pairs)
        rows = [np.array([bucket, k], dtype=np.int32).tobytes() + counts[i - k : i].tobytes() + levels[j - m : j].tobytes() for i, k, j, m in zip(w, n_words, p, n_pairs, strict=True)]
        chunks = messages.column("chunk").to_pylist()
        if with_page:
            rows.append(page.tobytes())
            chunks.append(None)
        first = [1] + [0] * (len(rows) - 1)
        return pa.Table.from_batches([c.table(_ANSWER, bucket=[bucket] * len(rows), chunk=chunks, reply=rows, tokens=[int(total.sum()) * f for f in first], types=[int((total > 0).sum()) * f for f in first])])

    return run


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(bits: int, total: int, types: int, train_docs: int, shared):
    """shared: a broadcast of (joined pages, begin and size in bits of each bucket's page), or None where the buckets' levels count."""

    def run(batches):
        log_base = math.log10(total + 0.1 * (types + 1))
        for row in c.rows_of(batches):
            ids, known, offsets, data = c.unpacked(row)
            token, before, begin = _tokens(data, offsets)
            answers = sorted((*np.frombuffer(x, dtype=np.int32, count=2).tolist(), x) for x in row["replies"])
            # of every distinct word: its count and the log10 of its probability
            count = np.concatenate([np.frombuffer(x, dtype=np.uint8, offset=8, count=8 * k).view(np.int64) for _, k, x in answers])
            log_p = np.log10(count + 0.1) - log_base
            place = _places(*_distinct(token)[1:])
            # of every distinct bigram: a place where it stands, its words' counts and the level of its name, which others may share
            pairs, order, at = _distinct(_pairs(before, token))
            pairs = _names(pairs, bits)
            back, where = _places(order, at), order[at]
            n, opens = count[place[where]], np.zeros(len(token), dtype=bool)
            opens[begin[:-1]] = True
            n_before = np.where(opens[where], train_docs, count[place[where - 1]])
            if shared is None:
                level = np.concatenate([np.frombuffer(x, dtype=np.uint8, offset=8 + 8 * k) for _, k, x in answers])[np.cumsum(np.append(False, pairs[1:] != pairs[:-1]))]
            else:
                pages, start, size = shared.value
                bucket = (pairs >> np.uint64(32)).astype(np.int64)
                level = probe(pages, start[bucket], size[bucket], pairs.astype(np.uint32))
            n_pair = np.minimum(np.minimum(_LEVEL_COUNT[level], n), n_before)
            ratio = n_pair / np.maximum(n_before, 1) / 10.0 ** log_p[place[where]]
            base = np.add.reduceat(log_p[place], begin[:-1])
            sums = []
            for weight in WEIGHTS:
                gain = np.where(n_before > 0, np.log10(weight * ratio + (1 - weight)), 0.0)[back] if weight else np.zeros(len(token))
                sums.append(base + np.add.reduceat(gain, begin[:-1]))
            top = np.max(sums, axis=0)
            score = top + np.log10(np.mean([10.0 ** (x - top) for x in sums], axis=0))
            yield c.table(SCORES, doc_id=c.ids_column(ids, known), held_out=held_out(ids, known), n_tokens=np.diff(begin), n_known=np.add.reduceat((count > 0).astype(np.int64)[place], begin[:-1]), train_tokens=np.full(len(ids), total), base_score=base, score=score)

    return run


def score(docs: DataFrame, max_filter_bytes: int = 0) -> DataFrame:
    """Scores of every document of (doc_id, text) by a model of those that are not held out."""
    spark = docs.sparkSession
    corpus = c.packed(docs, chunk_bytes=CHUNK_BYTES)
    bits = corpus.message_bits()
    asked = corpus.rows.mapInArrow(_request(bits), "bucket int, chunk long, words int, body binary")
    if 1 << bits > int(spark.conf.get("spark.sql.shuffle.partitions")):
        asked = asked.repartitionById(1 << bits, F.col("bucket"))  # a bucket a task; by hash, one task may get several
    answers = c.stored(asked.groupBy("bucket").applyInArrow(_reduce(max_filter_bytes > 0), "bucket int, chunk long, reply binary, tokens long, types long"))
    sums = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    if sums.tokens is None:
        return spark.createDataFrame([], SCORES_DDL)
    train_docs = docs.filter(F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % 10 != 0)).count()
    pages, shared = answers.filter("chunk is null").select("bucket", "reply"), None
    if 0 < max_filter_bytes >= (filter_bytes := pages.agg(F.sum(F.octet_length("reply"))).first()[0]):
        at, size, here = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64), 0
        joined = np.empty(filter_bytes, dtype=np.uint8)
        for r in pages.toLocalIterator():
            n = len(r.reply)
            at[r.bucket], size[r.bucket] = here, 8 * n
            joined[here : here + n] = np.frombuffer(r.reply, dtype=np.uint8)
            here += n
        shared = spark.sparkContext.broadcast((joined, at, size))
        del joined
    replies = answers.filter("chunk is not null").select("chunk", "reply")
    return c.with_replies(corpus, replies).mapInArrow(_score(bits, int(sums.tokens), int(sums.types), train_docs, shared), SCORES_DDL)
