"""SentencePiece (BPE model) encoding and decoding by suffix-array matching.

Encoding a batch: its texts fall into units that no piece spans, cut wherever two bytes meet that
stand side by side in no piece of the vocabulary.  The distinct units that are new (they are told
apart by 64-bit hashes) are joined into one index text whose
suffixes are sorted up to the longest piece; two binary searches for every piece give the range of
its occurrences, each an edge over the index text.  The edges, sorted by where they end, are then
relaxed: an edge is taken if it begins where an accepted edge ends and the two pieces can stand
side by side, that is, byte-pair merging of their joined text would leave just these two.  Exactly
one edge is accepted at every reachable end, so what the last one at a unit's end leads back to is
the same segmentation as merging pairs by score.

Characters outside the vocabulary become byte pieces.  Spaces count as U+2581, with one in front of
every text, as the model's normalizer (identity, with a dummy prefix) has it.

Defined results: a null or empty text has no pieces and decodes to the empty text; U+2581 in a text
decodes to a space; repeated rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapsieve.llm import common as c

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ROUND_BYTES = 96 << 10
#: Units, and ids of theirs, that a worker process remembers before it forgets those that did not come again.
CACHE_UNITS, CACHE_IDS = 1 << 19, 1 << 22
_MARK = "▁".encode()
#: Slots of the table that remembers which pairs of pieces can stand side by side.
_PAIR_SLOTS = 1 << 20
_NONE, _BEGIN, _BARE = -3, -2, -1
#: Ids that are spelled at once.
_SPELLED = 1 << 18


class Pieces:
    """The vocabulary: bytes of every piece, byte pieces, merge order and how each piece was merged."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.text = [p.encode() for p, _, _ in pieces]
        self.name = hashlib.sha256(repr(pieces).encode()).hexdigest()
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.silent = {i for i, (_, _, kind) in enumerate(pieces) if kind == "other"}
        self.score = {p: s for p, s, kind in pieces if kind == "normal"}
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        # ranks: single characters first, then merges by descending score
        order = sorted(ids, key=lambda p: (len(p) > 1, -self.score[p], ids[p]))
        self.rank = {ids[p]: k for k, p in enumerate(order)}
        self.id_of_rank = [ids[p] for p in order]
        self.split, self.merged, usable = [(k, k) for k in range(len(order))], {}, []
        for p in order:
            if len(p) == 1:
                usable.append(ids[p])
            elif (parts := self._merge(p)) is not None:
                left, right = (self.rank[ids[x]] for x in parts)
                self.split[self.rank[ids[p]]] = (left, right)
                self.merged[left, right] = self.rank[ids[p]]
                usable.append(ids[p])
        self.usable = sorted(usable, key=lambda i: self.text[i])
        self.id_array = np.array(self.id_of_rank + [0])
        self.byte_array = np.array([self.byte_id.get(b, 0) for b in range(256)])
        self.longest = max(map(len, (self.text[i] for i in self.usable)))
        self.sought = np.array([self.text[i] for i in self.usable], dtype=f"S{self.longest}")
        self.beyond = np.array([self.text[i].ljust(self.longest, b"\xff") for i in self.usable], dtype=f"S{self.longest}")
        self.sought_rank = np.array([self.rank[i] for i in self.usable])
        self.sought_size = np.array([len(self.text[i]) for i in self.usable])

    def _merge(self, piece: str):
        """The two parts that merging by score joins last to make the piece, or None where it makes something else."""
        parts = list(piece)
        while len(parts) > 2:
            best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(-np.inf, 0))
            if best[0] == -np.inf:
                return None
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts if len(parts) == 2 and all(x in self.score for x in parts) else None

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether merging the joined text of pieces of ranks a and b leaves these two: no merge across their border comes first.

        The merges of both are undone, latest first; at each point the two parts at the border must not be ones that
        merge earlier than what has been undone.
        """
        limit = len(self.split)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return Pieces([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of text in the order of their suffixes' first depth bytes, and those bytes; the end is padded with 0xFF."""
    width = -(-depth // 8) * 8
    padded = np.concatenate([text, np.full(width, 0xFF, dtype=np.uint8)])
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[: len(text)])
    keys[:, depth:] = 0
    columns = keys.view(">u8").astype(np.uint64).T.copy()
    order = np.argsort(columns[0], kind="stable")
    # suffixes that are tied so far, by the next eight bytes; group: where their tie stands
    own = np.arange(len(order))
    group = columns[0][order]
    for column in columns[1:]:
        same = group[1:] == group[:-1]
        tied = np.append(False, same) | np.append(same, False)
        if not tied.any():
            break
        own = own[tied]
        first = np.append(True, group[tied][1:] != group[tied][:-1])
        number = np.cumsum(first)
        by = np.lexsort((column[order[own]], number))
        order[own] = order[own][by]
        value = column[order[own]]
        new = np.append(True, (number[by][1:] != number[by][:-1]) | (value[1:] != value[:-1]))
        group = np.cumsum(new)
    return order, keys[order][:, :depth].copy().view(f"S{depth}")[:, 0]


def spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers begin[0], begin[0] + 1, ... (many[0] of them), then those from begin[1], and so on."""
    return np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)


def cuts_of(pieces: Pieces) -> np.ndarray:
    """For every two bytes (256 * first + second) whether no piece holds them side by side, so that a text falls apart between them."""
    joined = np.zeros((256, 256), dtype=bool)
    joined[:, 0x80:0xC0] = True  # within a character
    for i in pieces.rank:
        raw = np.frombuffer(pieces.text[i].replace(_MARK, b" "), dtype=np.uint8)
        joined[raw[:-1], raw[1:]] = True
    return ~joined.ravel()


class Encoder:
    """Encodes texts with one vocabulary; keeps the answers of units by their hashes."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.names, self.begin, self.many = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        #: Whether each unit came again since the others were forgotten, and the answers of all, joined.
        self.again, self.ids = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int32)
        self.pairs, self.fit = np.full(_PAIR_SLOTS, -1, dtype=np.int64), np.zeros(_PAIR_SLOTS, dtype=bool)
        self.cuts = cuts_of(pieces)
        spelled = [b"" if i in pieces.silent else pieces.byte_of.get(i, t.replace(_MARK, b" ")) for i, t in enumerate(pieces.text)]
        self.spelled, self.spelled_size = np.frombuffer(b"".join(spelled), dtype=np.uint8), np.array([len(t) for t in spelled])
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Piece ids of each text."""
        spaced = [b" " + t.replace(_MARK, b" ") if t else b"" for t in texts]
        first = np.append(0, np.cumsum([len(t) for t in spaced])).astype(np.int64)
        data = np.frombuffer(b"".join(spaced), dtype=np.uint8)
        if not len(data):
            return [self.ids[:0]] * len(texts)
        cut = np.append(True, self.cuts[data[:-1].astype(np.uint16) << 8 | data[1:]])
        cut[first[:-1][np.diff(first) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        found, size = [], []
        edge = np.unique(np.append(np.searchsorted(start, np.arange(0, len(data), c.CHUNK_BYTES)), len(start))).tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            low = start[a]
            begin, many = self._answers(data[low : end[b - 1]], start[a:b] - low, end[a:b] - low)
            found.append(self.ids[spread(begin, many)])
            size.append(many)
        ids, ends = np.concatenate(found), np.append(0, np.cumsum(np.concatenate(size)))
        at = ends[np.searchsorted(start, first)].tolist()
        return [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def _answers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of every unit begin in self.ids, and how many they are."""
        if len(self.names) > CACHE_UNITS or len(self.ids) > CACHE_IDS:
            self._forget()
        keys = c.mix(c.span_hash(c.prefix_hash(data), start, end) + (end - start).astype(np.uint64))
        names, at, back = np.unique(keys, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.names, names)
        there = spot < len(self.names)
        there[there] = self.names[spot[there]] == names[there]
        self.again[spot[there]] = True
        new = np.flatnonzero(~there)
        if len(new):
            a, b = start[at[new]], end[at[new]]
            turn = np.cumsum(b - a) // ROUND_BYTES
            edge = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), len(new)]
            raw = data.tobytes()
            told = [self._index([raw[x:y] for x, y in zip(a[i:j].tolist(), b[i:j].tolist(), strict=True)]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            many = np.concatenate([n for _, n in told])
            begin = len(self.ids) + np.cumsum(many) - many
            self.ids = np.concatenate([self.ids, *(ids for ids, _ in told)])
            self.names, self.begin, self.many, self.again = (np.insert(x, spot[new], y) for x, y in ((self.names, names[new]), (self.begin, begin), (self.many, many), (self.again, False)))
            spot = np.searchsorted(self.names, names)
        return self.begin[spot][back], self.many[spot][back]

    def _forget(self) -> None:
        """Keep the units that came again since the last time; none, if they are over half of what may be kept."""
        keep = self.again if self.again.sum() <= CACHE_UNITS // 2 and self.many[self.again].sum() <= CACHE_IDS // 2 else np.zeros(len(self.again), dtype=bool)
        begin, self.names, self.many = self.begin[keep], self.names[keep], self.many[keep]
        self.ids = self.ids[spread(begin, self.many)]
        self.begin, self.again = np.cumsum(self.many) - self.many, np.zeros(len(self.names), dtype=bool)

    def _index(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units, joined, and how many each has."""
        p = self.pieces
        marked = [u.replace(b" ", _MARK) for u in units]
        text = np.frombuffer(b"\xff".join(marked), dtype=np.uint8)
        order, keys = suffix_array(text, p.longest)
        low, high = np.searchsorted(keys, p.sought), np.searchsorted(keys, p.beyond, side="right")
        many = high - low
        start = order[spread(low, many)]
        rank = np.repeat(p.sought_rank, many)
        end = start + np.repeat(p.sought_size, many)
        # characters without a piece: an edge of their own, which nothing merges with
        head = np.flatnonzero((text & 0xC0) != 0x80)
        head = head[text[head] != 0xFF]
        width = np.where(text[head] < 0x80, 1, np.where(text[head] < 0xE0, 2, np.where(text[head] < 0xF0, 3, 4)))
        char = np.zeros(len(text), dtype=np.int64)
        char[head] = width
        has_piece = np.zeros(len(text), dtype=bool)
        has_piece[start[end - start == char[start]]] = True
        bare = ~has_piece[head]
        start, end, rank = np.concatenate([start, head[bare]]), np.concatenate([end, (head + width)[bare]]), np.concatenate([rank, np.full(int(bare.sum()), -1)])
        size = np.array([len(m) for m in marked])
        begin = np.cumsum(size + 1) - size - 1
        inner = end - np.repeat(begin, size + 1)[np.minimum(end - 1, len(text) - 1)]
        by_end = np.argsort(inner, kind="stable")
        start, end, rank = start[by_end], end[by_end], rank[by_end]
        cut = np.searchsorted(inner[by_end], np.arange(1, int(size.max()) + 2))
        last, back = np.full(len(text) + 2, _NONE, dtype=np.int64), np.zeros(len(text) + 2, dtype=np.int64)
        last[begin] = _BEGIN
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s, e, r = start[a:b], end[a:b], rank[a:b]
            before = last[s]
            there = before > _NONE
            both = np.flatnonzero((before >= 0) & (r >= 0))
            there[both] = self._beside(before[both], r[both])
            s, e, r = s[there], e[there], r[there]
            last[e], back[e] = r, s
        # back from the ends of all units at once, a piece a step
        at, unit, steps = begin + size, np.arange(len(units)), []
        while len(unit):
            steps.append((unit, last[at], back[at]))
            at = back[at]
            going = at > begin[unit]
            at, unit = at[going], unit[going]
        unit, ranks, where = (np.concatenate([x[k] for x in reversed(steps)]) for k in (0, 1, 2))
        by_unit = np.argsort(unit, kind="stable")
        unit, ranks, where = unit[by_unit], ranks[by_unit], where[by_unit]
        many = np.where(ranks >= 0, 1, char[where])
        ids = np.repeat(np.where(ranks >= 0, p.id_array[ranks], 0), many)
        bytes_of = np.repeat(ranks < 0, many)
        ids[bytes_of] = p.byte_array[text[spread(where, many)[bytes_of]]]
        return ids.astype(np.int32), np.bincount(unit, weights=many, minlength=len(units)).astype(np.int64)

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """side_by_side for many pairs, by a table that keeps the latest pair of each slot."""
        key = a * len(self.pieces.split) + b
        slot = (key * 0x9E3779B97F4A7 >> 20) & (_PAIR_SLOTS - 1)
        missing = np.flatnonzero(self.pairs[slot] != key)
        out = self.fit[slot]
        if len(missing):
            first, back = np.unique(key[missing], return_inverse=True)
            n, told = len(self.pieces.split), self.pieces.side_by_side
            found = np.fromiter((told(k // n, k % n) for k in first.tolist()), dtype=bool, count=len(first))
            out[missing] = found[back]
            own = slot[missing]
            self.pairs[own], self.fit[own] = key[missing], out[missing]
            # of pairs that met in a slot one stays; its answer must be its own
            stays = self.pairs[own] == key[missing]
            self.fit[own[stays]] = out[missing[stays]]
        return out

    def decode(self, found: list[np.ndarray]) -> list[bytes]:
        """The texts of lists of piece ids."""
        ids = np.concatenate([*found, self.ids[:0]])
        ends = np.append(0, np.cumsum(self.spelled_size[ids]))
        raw = b"".join(self.spelled[spread(self.spelled_at[x], self.spelled_size[x])].tobytes() for x in (ids[i : i + _SPELLED] for i in range(0, len(ids), _SPELLED)))
        at = ends[np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)].tolist()
        return [raw[i + (raw[i : i + 1] == b" " and i < j) : j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _batches(pieces: Pieces, batch: pa.RecordBatch, column: int):
    """(first row, ids of every row, whether they decode to the text) for parts of a batch."""
    encoder = _encoder(pieces)
    for a, b, data, offsets in c.text_parts(batch.column(column)):
        texts = [data[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        found = encoder.encode(texts)
        yield a, b, found, [x == t.replace(_MARK, b" ") for x, t in zip(encoder.decode(found), texts, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(pieces: Pieces) -> Encoder:
    """The worker process's encoder for a vocabulary; later tasks in the process find its answers there."""
    if pieces.name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[pieces.name] = Encoder(pieces)
    return _ENCODERS[pieces.name]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("pieces", pa.list_(pa.int32()))])
_OUT_DDL = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, pieces array<int>"


def encode(docs: DataFrame, path: str = MODEL, with_pieces: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip) of every row of (doc_id, text); with_pieces adds the ids.

    ids_crc32 is the CRC of the ids as little-endian 32-bit numbers; round_trip tells whether decoding gives the text.
    """
    pieces = load(path)

    def run(batches):
        for batch in batches:
            for a, b, found, same in _batches(pieces, batch, 1):
                ids = pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32), pa.array(np.concatenate(found), type=pa.int32())) if with_pieces else [None] * len(found)
                yield c.table(_OUT, doc_id=batch.column(0).slice(a, b - a), n_pieces=[len(x) for x in found], ids_crc32=[zlib.crc32(x.tobytes()) for x in found], round_trip=same, pieces=ids)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT_DDL)
    return out if with_pieces else out.drop("pieces")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, pieces)."""
    pieces = load(path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        encoder = Encoder(pieces)
        for batch in batches:
            texts = encoder.decode([np.array(x.as_py() or [], dtype=np.int32) for x in batch.column(1)])
            yield c.table(schema, doc_id=batch.column(0), text=[x.decode(errors="replace") for x in texts])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "pieces").mapInArrow(run, "doc_id long, text string")
