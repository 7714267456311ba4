"""Exact removal of repeated substrings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of LENGTH bytes that also starts anywhere else covers it.  Sorting all
suffixes is not needed for that: only which starts share their first LENGTH bytes.

1. *Dealing*.  The starts of every document are cut into pieces: maximal runs of starts whose
   LENGTH bytes have the same least GRAM-byte hash (the minimizer).  Equal strings have equal
   minimizers, so starts of different minimizers never meet.  Chunks send each piece's minimizer,
   hash and place to the bucket of the minimizer.
2. *Verdicts*.  A piece whose whole text occurs twice is repeated at every start.  Pieces that
   share their minimizer with different ones, or hold it twice, are asked for; others are unique.
3. *Refinement*.  The pieces asked for meet in their bucket.  Their positions fall into buckets of
   equal STEP-grams, and buckets are refined by sorting on the bucket identifiers at later
   offsets: a round takes the pair of the stored identifiers of depth d at i and at i + d, and
   stores the pair's rank as the identifier of depth 2d, which the next round looks up.  Starts
   alone in their bucket leave after every round; those left at depth LENGTH are repeated.
4. *Cutting*.  The verdicts return to the chunks, which cut the covered bytes.

A minimizer with more than CROWD different pieces (the rim of a passage that many documents
share) is not gathered: the hashes of its starts' LENGTH bytes are dealt out each by itself.

So hashes of whole pieces and of crowded starts decide what they can, and refinement the rest:
pieces that differ but share their minimizer.  All hashes have 64 bits.  Defined results: a null text has 0 bytes; matches never cross
documents; shorter texts than LENGTH stay whole; repeated rows are documents of their own, so
they remove each other; a null doc_id is returned as null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapsieve.llm import common as c

LENGTH = 200
GRAM = 64
STEP = 50
CROWD = 20_000
_SLICE = 1 << 20
_SPAN = LENGTH - GRAM + 1
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_SPLIT, _WHOLE, _TEXT, _SINGLE = 0, 1, 2, 3


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for every i that has so many."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, offsets: np.ndarray):
    """Minimizer, text hash, first start, number of starts, and whether the minimizer occurs twice, for all pieces."""
    if len(data) < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none.astype(bool)
    prefix = c.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = c.mix(c.span_hash(prefix, at, at + GRAM))
    least = sliding_min(gram, _SPAN)
    edge = np.zeros(len(least) + 1, dtype=np.int32)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long + 1] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    begins[offsets[long]] = True
    first = np.flatnonzero(begins)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | begins[1:]
    count = np.flatnonzero(stop) - first + 1
    value = least[first]
    text = c.mix(c.span_hash(prefix, first, first + count - 1 + LENGTH) + count.astype(np.uint64))
    window = np.lib.stride_tricks.sliding_window_view(gram, _SPAN)
    twice = np.zeros(len(first), dtype=bool)
    for i in range(0, len(first), 8192):
        own = slice(i, i + 8192)
        left = first[own] + (window[first[own]] == value[own, None]).argmax(1)
        last = first[own] + count[own] - 1
        right = last + _SPAN - 1 - (window[last][:, ::-1] == value[own, None]).argmax(1)
        twice[own] = left != right
    return c.mix(value + _MIX), text, first, count, twice  # least hashes are small; mixed again they spread over the buckets


def _pieces_by_slice(data: np.ndarray, offsets: np.ndarray):
    """pieces() of some documents at a time, so that its work arrays stay small."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE // 2, side="right")) - 1)
        to = min(to, n)
        value, text, first, count, twice = pieces(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        yield value, text, first + offsets[at], count, twice
        at = to


def shared(x: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice at least."""
    order = np.argsort(x)
    same = x[order][1:] == x[order][:-1]
    out = np.zeros(len(x), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def refine(texts: list[np.ndarray], starts: list[np.ndarray]) -> list[np.ndarray]:
    """Which starts of each slice have their LENGTH bytes elsewhere among all starts.

    A position's bucket identifier is the number of its bucket.  Identifiers of depth STEP come
    from the STEP-grams of all positions; a round sorts positions by their identifier and the one
    that stands a depth later, and the ranks are the identifiers that the next round looks up.
    """
    alive = np.concatenate([s + at for s, at in zip(starts, np.cumsum([0, *map(len, texts)]), strict=False)]) if texts else np.zeros(0, dtype=np.int64)
    hit = np.ones(len(alive), dtype=bool)
    if not len(alive):
        return [hit]
    size = sum(map(len, texts))
    identifier = np.zeros(size, dtype=np.int64)
    grams, at = np.zeros(size, dtype=np.uint64), 0
    for t in texts:
        here = np.arange(max(len(t) - STEP + 1, 0))
        grams[at : at + len(here)] = c.mix(c.span_hash(c.prefix_hash(t), here, here + STEP))
        at += len(t)
    _, identifier = np.unique(grams, return_inverse=True)
    depth = STEP
    while True:
        hit[hit] = shared(identifier[alive[hit]])
        if depth == LENGTH:
            return np.split(hit, np.cumsum([len(s) for s in starts])[:-1])
        # the next round reads identifiers of twice the depth at the starts, and at those offsets later that its own pairs need
        steps = np.arange(0, LENGTH, 2 * depth)
        needed = np.unique((alive[hit][:, None] + steps[None, :]).ravel())
        pair = identifier[needed] * np.int64(size) + identifier[needed + depth]
        _, rank = np.unique(pair, return_inverse=True)
        identifier[needed] = rank
        depth *= 2


_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
_MESSAGE_DDL = "bucket int, kind int, chunk long, body binary"
_VERDICT = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("reply", pa.binary())])
_VERDICT_DDL = "chunk long, kind int, reply binary"


def _deal(bits: int):
    def run(batches):
        for row in c.rows_of(batches):
            _, _, offsets, data = c.unpacked(row)
            value, text, first, count, twice = (np.concatenate(x) for x in zip(*_pieces_by_slice(data, offsets), strict=True))
            order, there, at = c.by_bucket(value, bits)
            packed_count = (count.astype(np.uint64) << np.uint64(1) | twice.astype(np.uint64)).astype(np.uint32)
            bodies = [value[o].tobytes() + text[o].tobytes() + first[o].astype(np.uint32).tobytes() + packed_count[o].tobytes() for o in (order[i:j] for i, j in zip(at[:-1], at[1:], strict=True))]
            yield c.table(_MESSAGE, bucket=there.astype(np.int32), kind=[_SPLIT] * len(there), chunk=[row["chunk"]] * len(there), body=bodies)

    return run


def _by_chunk(chunk: np.ndarray, kind: int, rows: np.ndarray):
    """Replies (chunk, kind, bytes of that chunk's rows)."""
    order = np.argsort(chunk, kind="stable")
    there, at = np.unique(chunk[order], return_index=True)
    return [(k, kind, np.ascontiguousarray(rows[order[i:j]]).tobytes()) for k, i, j in zip(there.tolist(), at, np.append(at[1:], len(order)), strict=False)]


def _replies(rows) -> pa.Table:
    chunk, kind, reply = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, type=pa.int64()), "kind": pa.array(kind, type=pa.int32()), "reply": pa.array(reply, type=pa.binary())}, schema=_VERDICT)


def _judge(crowd: int):
    def run(key, messages):
        return _verdicts(messages, crowd)

    return run


def _verdicts(messages, most: int) -> pa.Table:
    """Verdict on every piece of a bucket: repeated as a whole, asked for, or (no reply) unique."""
    bodies = [x.as_buffer() for x in messages.column("body")]
    sizes = [len(x) // 24 for x in bodies]
    part = lambda kind, at: np.concatenate([np.frombuffer(x, dtype=kind, offset=at * n, count=n) for x, n in zip(bodies, sizes, strict=True)])
    value, text, first, count = part(np.uint64, 0), part(np.uint64, 8), part(np.uint32, 16).astype(np.int64), part(np.uint32, 20)
    twice, count = count & 1 > 0, (count >> 1).astype(np.int64)
    chunk = np.repeat(messages.column("chunk").to_numpy(), sizes)
    order = np.lexsort((first, chunk, text, value))
    value, text, first, count, twice, chunk = (x[order] for x in (value, text, first, count, twice, chunk))
    new_value = np.append(True, value[1:] != value[:-1])
    new_text = new_value | np.append(True, text[1:] != text[:-1])
    kind_of = np.cumsum(new_text) - 1
    group = np.cumsum(new_value) - 1
    copies = np.bincount(kind_of)
    whole = copies[kind_of] > 1
    rep = np.flatnonzero(new_text)
    kinds = np.bincount(group[rep])
    open_kinds = np.bincount(group[rep], weights=~whole[rep]) > 0
    ask = rep[((kinds[group[rep]] > 1) & open_kinds[group[rep]]) | (twice[rep] & ~whole[rep])]
    crowd = kinds[group[ask]] > most
    out = _by_chunk(chunk[whole], _WHOLE, np.stack([first[whole], count[whole]], 1))
    for kind, own in ((_TEXT, ask[~crowd]), (_SINGLE, ask[crowd])):
        out += _by_chunk(chunk[own], kind, np.stack([value[own].view(np.int64), first[own], count[own]], 1))
    return _replies(out)


def _starts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


def _answer(bits: int):
    """Texts, or identifiers of single starts, that a chunk is asked for."""

    def run(batches):
        for row in c.rows_of(batches):
            if not row["replies"]:
                continue
            _, _, _, data = c.unpacked(row)
            for kind in (_TEXT, _SINGLE):
                told = [np.frombuffer(x, dtype=np.int64, offset=8).reshape(-1, 3) for x in row["replies"] if np.frombuffer(x, dtype=np.int64, count=1)[0] == kind]
                if not told:
                    continue
                value, first, count = np.concatenate(told).T
                if kind == _TEXT:
                    order, there, at = c.by_bucket(np.ascontiguousarray(value).view(np.uint64), bits)
                    bodies = []
                    for i, j in zip(at[:-1], at[1:], strict=True):
                        o = order[i:j]
                        text = b"".join(data[a : a + n - 1 + LENGTH].tobytes() for a, n in zip(first[o].tolist(), count[o].tolist(), strict=True))
                        bodies.append(np.int64(j - i).tobytes() + first[o].tobytes() + count[o].tobytes() + text)
                else:
                    starts = _starts(first, count)
                    name = c.mix(c.span_hash(c.prefix_hash(data), starts, starts + LENGTH))
                    order, there, at = c.by_bucket(name, bits)
                    bodies = [name[order[i:j]].tobytes() + starts[order[i:j]].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield c.table(_MESSAGE, bucket=there.astype(np.int32), kind=[kind] * len(there), chunk=[row["chunk"]] * len(there), body=bodies)

    return run


def _settle(key, messages):
    """Repeated starts among the pieces or single starts of a bucket, as runs (first, number)."""
    chunks, bodies = messages.column("chunk").to_pylist(), [x.as_buffer() for x in messages.column("body")]
    if key[1].as_py() == _SINGLE:
        sizes = [len(x) // 16 for x in bodies]
        name = np.concatenate([np.frombuffer(x, dtype=np.uint64, count=n) for x, n in zip(bodies, sizes, strict=True)])
        starts = np.concatenate([np.frombuffer(x, dtype=np.int64, offset=8 * n) for x, n in zip(bodies, sizes, strict=True)])
        hit, owner = shared(name), np.repeat(chunks, sizes)
    else:
        texts, places, starts, owner, held, at = [], [], [], [], [], 0
        local: list[np.ndarray] = []
        for chunk, x in zip(chunks, bodies, strict=True):
            n = int(np.frombuffer(x, dtype=np.int64, count=1)[0])
            first, count = (np.frombuffer(x, dtype=np.int64, offset=8 + 8 * n * i, count=n) for i in (0, 1))
            held.append(np.frombuffer(x, dtype=np.uint8, offset=8 + 16 * n))
            begin = np.cumsum(count - 1 + LENGTH) - (count - 1 + LENGTH) + at
            local.append(_starts(begin, count))
            starts.append(_starts(first, count))
            owner.append(np.full(len(starts[-1]), chunk))
            at += len(held[-1])
            if at >= _SLICE:
                texts.append(np.concatenate(held))
                places.append(np.concatenate(local))
                held, local, at = [], [], 0
        if held:
            texts.append(np.concatenate(held))
            places.append(np.concatenate(local))
        hit = np.concatenate(refine(texts, places))
        starts, owner = np.concatenate(starts), np.concatenate(owner)
    starts, owner = starts[hit], owner[hit]
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    new = np.append(True, (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1]))[: len(starts)]
    first = np.flatnonzero(new)
    return _replies(_by_chunk(owner[first], _WHOLE, np.stack([starts[first], np.diff(np.append(first, len(starts)))], 1)) if len(first) else [])


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_CUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _covered(row, offsets: np.ndarray, data: np.ndarray):
    """Which bytes of a chunk go, how many of each document, and in how many runs."""
    step = np.zeros(len(data) + 1, dtype=np.int32)
    for x in row["replies"]:
        first, count = np.frombuffer(x, dtype=np.int64, offset=8).reshape(-1, 2).T
        np.add.at(step, first, 1)
        np.add.at(step, first + count - 1 + LENGTH, -1)
    gone = np.cumsum(step[:-1]) > 0
    total = np.append(0, np.cumsum(gone))
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = gone[inner]
    spans = np.append(0, np.cumsum(begins))
    return gone, total[offsets[1:]] - total[offsets[:-1]], spans[offsets[1:]] - spans[offsets[:-1]]


def _kept(data, offsets, gone, removed) -> list[bytes]:
    return [data[a:b].tobytes() if not n else data[a:b][~gone[a:b]].tobytes() for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True)]


def _cut(batches):
    for row in c.rows_of(batches):
        ids, known, offsets, data = c.unpacked(row)
        gone, removed, spans = _covered(row, offsets, data)
        yield c.table(_CUT, doc_id=c.ids_column(ids, known), n_bytes=np.diff(offsets), n_removed=removed, n_spans=spans, kept_sha256=[hashlib.sha256(x).hexdigest() for x in _kept(data, offsets, gone, removed)])


def _cut_rows(batches):
    """Rows with what is left of their texts; those of which nothing is left go."""
    for row in c.rows_of(batches):
        _, _, offsets, data = c.unpacked(row)
        gone, removed, _ = _covered(row, offsets, data)
        texts = [x.decode(errors="ignore").encode() if n else x for x, n in zip(_kept(data, offsets, gone, removed), removed.tolist(), strict=True)]
        places = np.flatnonzero([bool(x) or not n for x, n in zip(texts, removed.tolist(), strict=True)])
        yield c.rows_at(row, places, [texts[p] for p in places])


def _tagged(verdicts: DataFrame, kinds) -> DataFrame:
    """Replies with their kind in front."""
    tags = F.create_map(*(x for k in kinds for x in (F.lit(k), F.lit(bytearray(np.int64(k).tobytes())))))
    return verdicts.filter(F.col("kind").isin(*kinds)).select("chunk", F.concat(tags[F.col("kind")], F.col("reply")).alias("reply"))


def _marked(corpus: c.Corpus, crowd: int) -> DataFrame:
    """The packed corpus with the runs of repeated starts of every chunk as its replies."""
    bits = corpus.message_bits()
    dealt = corpus.dealt(corpus.rows.mapInArrow(_deal(bits), _MESSAGE_DDL), bits, "bucket")
    judged = c.stored(dealt.groupBy("bucket").applyInArrow(_judge(crowd), _VERDICT_DDL))
    sent = corpus.dealt(c.with_replies(corpus, _tagged(judged, (_TEXT, _SINGLE))).mapInArrow(_answer(bits), _MESSAGE_DDL), bits, "bucket", "kind")
    settled = sent.groupBy("bucket", "kind").applyInArrow(_settle, _VERDICT_DDL)
    return c.with_replies(corpus, _tagged(judged.unionByName(settled), (_WHOLE,)))


def dedup(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of (doc_id, text)."""
    return _marked(c.packed(docs), crowd).mapInArrow(_cut, _CUT_DDL)


def cut(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The rows of docs, with all their columns, and the text that stays; rows that lose all their text go.

    A character that a cut splits goes too.
    """
    return c.unpacked_rows(_marked(c.packed(docs, whole=True), crowd).mapInArrow(_cut_rows, c.ROWS_DDL), docs.schema)
