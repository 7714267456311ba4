"""Benchmark decontamination by template windows with slot checking.

Texts become templates: words lose edge punctuation and capitals, numbers become <num>, measuring
units <unit>, and names (capitalised words inside a sentence) <name>.  Windows of WIDTH template
tokens of the benchmark are looked up in the windows of the documents, so a question with other
numbers or names still matches.  Hits of a document with the same item and the same shift form
one alignment; its slots must be filled consistently: equal fillings of the item stand against
equal fillings of the document (unequal ones may become equal, as new numbers may coincide); units
match literally or as any other unit.  An alignment counts when it covers SHARE of the item's tokens, or LONG tokens.
Windows of the words as they are, without capitals, are looked up as well, so that a copy in
capitals, in which every word looks like a name, is found too.

A capitalised word that opens a sentence may be a name or not, and a name may have several words.
Therefore two further readings are looked up, in which a run of name words (within a sentence and
without punctuation between them) is one token: in "runs" an opening word is literal, in "names" it
is a name unless it is one of FUNCTION.  Hits of such a reading align by its own tokens; coverage is
counted in words of the item in every reading.

Template windows with fewer than LITERAL literal tokens say little by their placeholders; they are
looked up by their words alone, so they match where they are filled alike.  Items shorter than WIDTH
have one window of their own length; one of fewer than LEAST words matches the documents that consist
of its words and nothing else.

Both sides become rows.  Benchmark items give a row for each window: hash, item, place, fillings.
Documents give the same for those of their windows whose hash stands in a gate, a bit array of the
benchmark's hashes (two bits each) of at most 2**MOST_GATE bits, which is all that is broadcast; a hash that passes
it by chance meets nothing later.  Both tables are joined on the hash (by broadcast where the
benchmark's part is small, otherwise with hot hashes dealt out), the hits of a document are aligned
and checked, and the answers go back to the packed documents, whose text is not moved.

Defined results: a null, empty or blank text is clean; null items are skipped; repeated items
count once each; of equally covered items the one with the smallest id is named (null last);
repeated rows get equal answers; an empty benchmark finds nothing; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapsieve.llm import common as c

WIDTH = 8
LEAST = 4
LITERAL = 4
SHARE = 0.5
LONG = 16
LEAST_GATE, MOST_GATE = 17, 27
_SLICE_BITS = 16
#: The readings of a text, each with the space in which its shifts are counted (template and literal have the same tokens).
READINGS = {"template": 0, "literal": 0, "runs": 1, "names": 2}
_STEP_NUMBER = 0xA24BAED4963EE407
_STEP = np.uint64(_STEP_NUMBER)
_NUM, _UNIT, _NAME = np.uint64(0x11), np.uint64(0x22), np.uint64(0x33)
#: Measuring units, currencies and periods that stand for one another in a template.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "kilometre", "kilometres", "g", "kg", "mg", "lb", "lbs", "oz", "ton", "tons", "tonne", "tonnes", "gram", "grams", "kilogram",
    "kilograms", "pound", "pounds", "ounce", "ounces", "s", "sec", "secs", "second", "seconds", "min", "mins", "minute", "minutes", "h", "hr", "hrs", "hour",
    "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "l", "ml", "cl", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "pint", "pints", "cup", "cups", "mph", "kmh", "km/h", "m/s", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "a", "ohm", "j", "kj", "cal", "kcal", "kb",
    "mb", "gb", "tb", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "gbp", "yen", "percent",
)
#: Words that are no names where they open a sentence.
FUNCTION = (
    "who", "whom", "whose", "what", "which", "when", "where", "why", "how", "if", "then", "else", "than", "the", "a", "an", "and", "but", "or", "nor", "so",
    "because", "while", "although", "though", "since", "until", "unless", "after", "before", "for", "in", "on", "at", "by", "from", "with", "without", "to",
    "of", "as", "into", "over", "under", "about", "between", "during", "this", "that", "these", "those", "there", "here", "it", "its", "he", "she", "they",
    "we", "you", "i", "his", "her", "their", "our", "my", "your", "is", "are", "was", "were", "be", "do", "does", "did", "has", "have", "had", "can", "could",
    "should", "would", "not", "no", "yes", "all", "both", "each", "every", "some", "any", "many", "much", "most", "more",
)


def _hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return c.mix(c.span_hash(c.prefix_hash(raw, True), np.array([0]), np.array([len(raw)])) + np.uint64(len(raw)))[0]


_UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], dtype=np.uint64))
_FUNCTION_HASHES = np.sort(np.array([_hash_of(w) for w in FUNCTION], dtype=np.uint64))
_DIGIT, _NUMERIC, _STOP = (np.zeros(256, dtype=bool) for _ in range(3))
_STOP[[*b".!?:"]] = True
_DIGIT[48:58] = True
_NUMERIC[[*range(48, 58), *b".,%-+/:"]] = True


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is among the known ones; nearly all others fail by their first 16 bits."""
    first = np.zeros(1 << 16, dtype=bool)
    first[known >> np.uint64(48)] = True
    out = first[hashes >> np.uint64(48)]
    own = np.flatnonzero(out)
    out[own] = known[np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)] == hashes[own]
    return out


def _numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word (none is empty) has a digit and nothing but digits and the marks that stand in numbers."""
    out = _NUMERIC[data[start]] & _NUMERIC[data[end - 1]]
    own = np.flatnonzero(out)
    if len(own):
        size = end[own] - start[own]
        begin = np.cumsum(size) - size
        held = data[np.arange(int(size.sum())) + np.repeat(start[own] - begin, size)]
        out[own] = np.logical_and.reduceat(_NUMERIC[held], begin) & np.logical_or.reduceat(_DIGIT[held], begin)
    return out


class Reading:
    """Tokens of some documents in one reading: their hashes, whether each is a slot, the first word of each (and the number of words), and where each document begins."""

    def __init__(self, hashes: np.ndarray, slot: np.ndarray, word: np.ndarray, first: np.ndarray):
        self.hashes, self.slot, self.word, self.first = hashes, slot, word, first

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window at every token, and whether the window lies in one document."""
        n = max(len(self.hashes) - width + 1, 0)
        rolled = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            rolled = rolled * _STEP + self.hashes[i : i + n]
        fits = np.zeros(len(self.hashes) + 1, dtype=np.int32)
        long = np.flatnonzero(np.diff(self.first) >= width)
        np.add.at(fits, self.first[long], 1)
        np.add.at(fits, self.first[long + 1] - width + 1, -1)
        return c.mix(rolled), np.cumsum(fits)[:n] > 0


class Tokens:
    """Words of some documents: their literal hashes, where each document begins, and the readings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        start, end, doc = c.words(data, offsets)
        self.first = np.searchsorted(doc, np.arange(len(offsets)))
        if not len(start):
            self.literal = np.zeros(0, dtype=np.uint64)
            self.readings = dict.fromkeys(READINGS, Reading(self.literal, np.zeros(0, dtype=bool), np.zeros(1, dtype=np.int64), self.first))
            return
        a, b = c.stripped(data, start, end)
        empty = a >= b
        a, b = np.where(empty, start, a), np.where(empty, end, b)
        self.literal = c.mix(c.span_hash(c.prefix_hash(data, True), a, b) + (b - a).astype(np.uint64))
        number = _numbers(data, a, b)
        unit = _among(self.literal, _UNIT_HASHES)
        head, second = data[a], data[np.minimum(a + 1, len(data) - 1)]
        capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        # a sentence begins with a document, after . ! ? : or after a line's end
        opens = np.zeros(len(start), dtype=bool)
        opens[self.first[:-1][self.first[:-1] < len(start)]] = True
        lines = np.cumsum(data == 10, dtype=np.int32)
        opens[1:] |= _STOP[data[end[:-1] - 1]] | (lines[start[1:] - 1] > lines[end[:-1] - 1])
        proper = capital & ~number & ~unit
        name = proper & ~opens
        wide = proper & ~(opens & _among(self.literal, _FUNCTION_HASHES))
        held = np.append(False, ~opens[1:] & (b[:-1] == end[:-1]) & (a[1:] == start[1:]))
        words = np.arange(len(start) + 1)
        self.readings = {}
        for kind, names, joined in (("template", name, None), ("runs", name, held), ("names", wide, held)):
            slot = number | unit | names
            hashes = np.where(number, _NUM, np.where(unit, _UNIT, np.where(names, _NAME, self.literal)))
            if joined is None:
                self.readings[kind] = Reading(hashes, slot, words, self.first)
                self.readings["literal"] = Reading(self.literal, slot, words, self.first)
            else:
                at = np.flatnonzero(~(joined & names & np.append(False, names[:-1])))
                self.readings[kind] = Reading(hashes[at], slot[at], np.append(at, len(start)), np.searchsorted(at, self.first))


_KINDS = tuple(READINGS)


def _keys(reading: Reading, kind: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the windows of a reading, which tell kinds and widths apart, and whether each window lies in one text."""
    hashes, fits = reading.windows(width)
    return c.mix(hashes ^ np.uint64((64 * kind + width) * _STEP_NUMBER & (1 << 64) - 1)), fits


def item_windows(tokens: Tokens):
    """(kind, width, keys, item numbers, first tokens) of the windows that are looked up, for every kind and width there is."""
    for kind, name in enumerate(_KINDS):
        reading = tokens.readings[name]
        size = np.diff(reading.first)
        literals = np.append(0, np.cumsum(~reading.slot))
        for width in sorted({min(WIDTH, int(n)) for n in size if n and (n >= LEAST or name == "literal")}):
            keys, fits = _keys(reading, kind, width)
            at = np.flatnonzero(fits)
            item = np.searchsorted(reading.first, at, side="right") - 1
            own = (size[item] >= WIDTH) if width == WIDTH else (size[item] == width)
            own &= (literals[at + width] - literals[at] >= min(LITERAL, width)) | (name == "literal")
            yield kind, width, keys[at[own]], item[own], at[own]


def text_windows(tokens: Tokens, wanted: list[tuple[int, int]], gate: np.ndarray):
    """The same for texts: windows of the wanted kinds and widths whose key stands in the gate."""
    shift, mask = np.uint64(64 - (8 * len(gate)).bit_length() + 1), np.uint64(8 * len(gate) - 1)
    for kind, width in wanted:
        reading = tokens.readings[_KINDS[kind]]
        keys, fits = _keys(reading, kind, width)
        if width < LEAST:
            fits = np.zeros(len(keys), dtype=bool)
            fits[reading.first[:-1][np.diff(reading.first) == width]] = True
        at = np.flatnonzero(fits)
        for place in (lambda x: x >> shift, lambda x: x & mask):
            spot = place(keys[at]).astype(np.int64)
            at = at[(gate[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0]
        if len(at):
            yield kind, width, keys[at], np.searchsorted(reading.first, at, side="right") - 1, at


def body(tokens: Tokens, kind: int, width: int, at: int) -> bytes:
    """The tokens of a window: which are slots, their numbers of words, and the literal hashes of the words."""
    reading = tokens.readings[_KINDS[kind]]
    word = reading.word[at : at + width + 1]
    return reading.slot[at : at + width].astype(np.int32).tobytes() + np.diff(word).astype(np.int32).tobytes() + tokens.literal[word[0] : word[-1]].tobytes()


def _opened(body: bytes, width: int) -> list[tuple[int, list]]:
    """(slot, words) of every token of a window."""
    slot, n = np.frombuffer(body, dtype=np.int32, count=2 * width).reshape(2, width).tolist()
    words = np.frombuffer(body, dtype=np.uint64, offset=8 * width).tolist()
    ends = np.cumsum(n).tolist()
    return [(s, words[e - k : e]) for s, k, e in zip(slot, n, ends, strict=True)]


def aligned(hits: list[tuple]) -> list[tuple]:
    """(item, item_id, covered words, words) of the alignments that count among a text's hits; the best one of each item.

    hits: (item, item_id, words of the item, kind, shift, spot, width, body of the item's window, body of the text's window).
    """
    best: dict[object, tuple] = {}
    hits = sorted(hits, key=lambda h: (h[0], READINGS[_KINDS[h[3]]], h[4], h[5], h[6]))
    for (item, _, shift), own in itertools.groupby(hits, key=lambda h: (h[0], READINGS[_KINDS[h[3]]], h[4])):
        own = list(own)
        n, end, covered, pairs = own[0][2], -1, 0, set()
        for k, (_, _, _, _, _, spot, width, mine, theirs) in enumerate(own):
            # a window adds nothing where the next one begins within what is covered, or at this one's place, and reaches further
            if spot + width <= end or (k + 1 < len(own) and own[k + 1][5] <= max(end, spot)):
                continue
            for j, ((slot, a), (_, b)) in enumerate(zip(_opened(mine, width), _opened(theirs, width), strict=True)):
                if spot + j >= end:
                    covered += len(a)
                    if slot:
                        pairs |= fillings(a, b)
            end = spot + width
        if (covered >= SHARE * n or covered >= LONG) and covered > best.get(item, (0, 0, 0))[2] and len({a for a, _ in pairs}) == len(pairs):
            best[item] = (item, own[0][1], covered, n)
    return list(best.values())


def fillings(mine: list, theirs: list) -> set[tuple[tuple, tuple]]:
    """What stands for what in a slot: word by word, or, where the numbers of words differ, the middle parts between equal words (none against a part that is empty)."""
    if len(mine) == len(theirs):
        return {((a,), (b,)) for a, b in zip(mine, theirs, strict=True)}
    least = min(len(mine), len(theirs))
    left = next((i for i in range(least) if mine[i] != theirs[i]), least)
    right = next((i for i in range(least - left) if mine[-1 - i] != theirs[-1 - i]), least - left)
    a, b = tuple(mine[left : len(mine) - right]), tuple(theirs[left : len(theirs) - right])
    return {((x,), (x,)) for x in mine[:left] + mine[len(mine) - right :]} | ({(a, b)} if a and b else set())


_ITEMS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("width", pa.int32()), ("item", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("spot", pa.int32()), ("item_body", pa.binary())])
_ITEMS_DDL = "key long, kind int, width int, item long, item_id long, words int, spot int, item_body binary"
_TEXTS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("width", pa.int32()), ("chunk", pa.int64()), ("place", pa.int32()), ("at", pa.int32()), ("body", pa.binary())])
_TEXTS_DDL = "key long, kind int, width int, chunk long, place int, at int, body binary"


def _of_items(batches):
    for batch in batches:
        for a, b, data, offsets in c.text_parts(batch.column(2)):
            tokens, names = Tokens(data, offsets), batch.column(0).slice(a, b - a).to_numpy()
            ids, size = batch.column(1).slice(a, b - a), np.diff(tokens.first)
            for kind, width, keys, item, at in item_windows(tokens):
                n = len(keys)
                first = tokens.readings[_KINDS[kind]].first
                yield c.table(_ITEMS, key=keys.view(np.int64), kind=[kind] * n, width=[width] * n, item=names[item], item_id=ids.take(pa.array(item)), words=size[item].astype(np.int32), spot=(at - first[item]).astype(np.int32), item_body=[body(tokens, kind, width, i) for i in at.tolist()])


def _of_texts(wanted, gate):
    def run(batches):
        for row in c.rows_of(batches):
            _, _, offsets, data = c.unpacked(row)
            tokens = Tokens(data, offsets)
            for kind, width, keys, doc, at in text_windows(tokens, wanted, gate.value):
                n = len(keys)
                first = tokens.readings[_KINDS[kind]].first
                yield c.table(_TEXTS, key=keys.view(np.int64), kind=[kind] * n, width=[width] * n, chunk=[row["chunk"]] * n, place=doc.astype(np.int32), at=(at - first[doc]).astype(np.int32), body=[body(tokens, kind, width, i) for i in at.tolist()])

    return run


def _gate_slices():
    out = pa.schema([("slice", pa.int32()), ("held", pa.binary())])

    def run(key, rows):
        held = np.zeros(1 << _SLICE_BITS, dtype=bool)
        held[rows.column("spot").to_numpy() & (len(held) - 1)] = True
        return pa.table({"slice": pa.array([key[0].as_py()], type=pa.int32()), "held": pa.array([np.packbits(held, bitorder="little").tobytes()], type=pa.binary())}, schema=out)

    return run


def gate_of(items: DataFrame) -> np.ndarray:
    """Two bits for each key of a windows table, the first digits of the key and the last: about 512 bits a key, 2**MOST_GATE in all at most."""
    bits = max(LEAST_GATE, min(MOST_GATE, (512 * items.count()).bit_length()))
    gate = np.zeros(1 << (bits - 3), dtype=np.uint8)
    spots = items.select(F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND((1 << bits) - 1))).alias("spot")).distinct()
    for r in spots.select("spot", F.shiftright("spot", _SLICE_BITS).cast("int").alias("slice")).groupBy("slice").applyInArrow(_gate_slices(), "slice int, held binary").collect():
        gate[r.slice * len(r.held) : (r.slice + 1) * len(r.held)] = np.frombuffer(r.held, dtype=np.uint8)
    return gate


_FOUND = np.dtype([("place", "<i8"), ("n_items", "<i4"), ("known", "<i4"), ("item_id", "<i8"), ("covered", "<i8"), ("coverage", "<f8")])


def named(found: list[tuple]) -> tuple:
    """(item_id, covered, coverage) of the most covered item among aligned ones, of equals that with the smallest id, null last."""
    share, _, item_id, covered = min((-m / n, (name is None, name or 0), name, m) for _, name, m, n in found)
    return item_id, covered, -share


def _align(key, rows):
    columns = ("item", "item_id", "words", "kind", "at", "spot", "width", "item_body", "body")
    hits = [(*h[:4], h[4] - h[5], *h[5:]) for h in zip(*(rows.column(x).to_pylist() for x in columns), strict=True)]
    found = aligned(hits)
    reply = []
    if found:
        item_id, covered, coverage = named(found)
        reply = [np.array([(key[1].as_py(), len(found), item_id is not None, item_id or 0, covered, coverage)], dtype=_FOUND).tobytes()]
    return pa.table({"chunk": pa.array([key[0].as_py()] * len(reply), type=pa.int64()), "reply": pa.array(reply, type=pa.binary())})


def _marked(corpus: c.Corpus, benchmark: DataFrame) -> DataFrame:
    """The packed corpus with what was found in every chunk's texts as its replies."""
    keys = ["key", "kind", "width"]
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()
    items = c.stored(rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(_of_items, _ITEMS_DDL))
    wanted = sorted((r.kind, r.width) for r in items.select("kind", "width").distinct().collect())
    gate = corpus.rows.sparkSession.sparkContext.broadcast(gate_of(items))
    texts = c.stored(corpus.rows.mapInArrow(_of_texts(wanted, gate), _TEXTS_DDL))
    met = items.join(texts.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    hits = c.hot_join(texts, c.stored(met), keys, "inner")
    return c.with_replies(corpus, hits.groupBy("chunk", "place").applyInArrow(_align, "chunk long, reply binary"))


_SCAN = pa.schema([("doc_id", pa.int64()), ("contaminated", pa.bool_()), ("n_items", pa.int32()), ("item_id", pa.int64()), ("covered", pa.int32()), ("coverage", pa.float64())])
_SCAN_DDL = "doc_id long, contaminated boolean, n_items int, item_id long, covered int, coverage double"


def _replied(row: dict) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pybytes() for x in row["replies"]), dtype=_FOUND)


def _tell(batches):
    for row in c.rows_of(batches):
        ids, known, _, _ = c.unpacked(row)
        out = np.zeros(len(ids), dtype=_FOUND)
        found = _replied(row)
        out[found["place"]] = found
        yield c.table(_SCAN, doc_id=c.ids_column(ids, known), contaminated=out["n_items"] > 0, n_items=out["n_items"].copy(), item_id=pa.array(out["item_id"], mask=out["known"] == 0), covered=out["covered"].astype(np.int32), coverage=out["coverage"].copy())


def _clean_rows(batches):
    for row in c.rows_of(batches):
        stays = np.ones(len(row["ids"]) // 8, dtype=bool)
        stays[_replied(row)["place"]] = False
        yield c.rows_at(row, np.flatnonzero(stays))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, covered, coverage) of every row of (doc_id, text) against (item_id, text)."""
    return _marked(c.packed(docs), benchmark).mapInArrow(_tell, _SCAN_DDL)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no item of the benchmark was found."""
    return c.unpacked_rows(_marked(c.packed(docs, whole=True), benchmark).mapInArrow(_clean_rows, c.ROWS_DDL), docs.schema)
