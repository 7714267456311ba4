"""Quality classifier: ordinal cumulative-link regression over hashed text.

Grades come from the graded labels of a document: 0 where its quality is 0, 1 where it is of
quality 1 but toxic, 2 otherwise.  One weight vector over hashed features gives a position on a
line, and ordered thresholds cut the line: P(grade >= j) = sigmoid(position - threshold_j).  The
expected grade is the sum of these tails; the last tail, P(grade >= top), decides selection.

Features are which hashed words a text has (lower-cased A-Z, without ASCII punctuation at the edges), each
worth 1 / sqrt(number of distinct ones) in one half of the position and 1 in the other, so that a
single tell-tale word counts in a long text; and measures of shape (capitals, punctuation,
repetition), in steps, each a feature like a word.  Features of fewer than LEAST_DOCS training
documents have no weight.

Training takes at most SAMPLE labelled documents, those first by the hash of their id, and runs on
the driver over their feature numbers.  Scoring sends the weights (2 * DIM numbers, a fixed size)
to the workers and reads every text whole.

Defined results: a null or empty text has no words and its shape alone speaks; labels that are
null are left out, of repeated ones the lowest grade counts, and of repeated documents one; with fewer than two grades in the sample every
document gets the one grade there is (the top one where there are no labels); repeated rows get
equal scores; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapsieve.llm import common as c

BITS = 20
DIM = 1 << BITS
SAMPLE = 16_000
GRADES = 3
LEAST_DOCS = 12
EPOCHS = 25
CUT = 0.5
_SHAPES = 9


def numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features (below DIM) of each document, joined, and where each document's begin."""
    bare, first = c.word_hashes(data, offsets, strip=True)
    bare = (bare >> np.uint64(64 - BITS)).astype(np.int64)
    slots = (c.mix(c.word_hashes(data, offsets)[0]) >> np.uint64(64 - BITS)).astype(np.int64)
    shape = _shape(data, offsets, first, slots)
    out, sizes = [], []
    for d in range(len(offsets) - 1):
        own = np.unique(np.concatenate([slots[first[d] : first[d + 1]], bare[first[d] : first[d + 1]]]))
        out.append(own)
        out.append(DIM - 64 * _SHAPES + shape[d])
        sizes.append(len(own) + _SHAPES)
    return (np.concatenate(out) if out else slots[:0]), np.append(0, np.cumsum(sizes)).astype(np.int64)


def _shape(data, offsets, first, slots) -> np.ndarray:
    """Steps (below 64 each) of some measures of each document; features of their own at the end of the hash range."""
    total = lambda x: np.diff(np.append(0, np.cumsum(x))[offsets])
    n = np.maximum(np.diff(offsets), 1)
    words = np.diff(first)
    upper = total((data >= 65) & (data <= 90))
    lower = total((data >= 97) & (data <= 122))
    digit = total((data >= 48) & (data <= 57))
    space = total(np.isin(data, (32, 10)))
    line = total(data == 10)
    other = n - upper - lower - digit - space - total(data >= 128)
    same = np.append(False, slots[1:] == slots[:-1])
    same = np.diff(np.append(0, np.cumsum(same))[first])
    step = lambda x, y: np.minimum(15, np.ceil(16 * x / np.maximum(y, 1))).astype(np.int64)
    distinct = np.array([len(np.unique(slots[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], dtype=np.int64)
    log = lambda x: np.minimum(15, np.log2(x + 1)).astype(np.int64)
    measures = (step(upper, upper + lower), step(other, n), step(digit, n), step(same, words), step(distinct, words), log(words), log(n // np.maximum(words, 1)), step(line, words), np.zeros(len(n), dtype=np.int64))
    return np.stack([64 * i + x for i, x in enumerate(measures)], 1)


def _features(batches):
    out = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])
    for batch in batches:
        for a, b, data, offsets in c.text_parts(batch.column(1)):
            x, at = numbers(data, offsets)
            yield c.table(out, doc_id=batch.column(0).slice(a, b - a), x=[x[i:j].astype(np.int32).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)])


class Model:
    """Weights (presence, diluted presence) and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def __getstate__(self):
        there = np.flatnonzero(self.weights).astype(np.int32)
        return there, self.weights[there], self.thresholds

    def __setstate__(self, state):
        there, values, self.thresholds = state
        self.weights = np.zeros(2 * DIM, dtype=np.float32)
        self.weights[there] = values

    def position(self, x: np.ndarray, at: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
        """Positions of documents; count: their numbers of features, where x leaves some out that have no weight."""
        count = np.diff(at) if count is None else count
        begin = np.minimum(at[:-1], max(len(x) - 1, 0))
        return np.add.reduceat(self.weights[x], begin) + np.add.reduceat(self.weights[DIM + x], begin) / np.sqrt(count)

    def tails(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. GRADES - 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - self.position(x, at)[:, None], -40, 40)))


def slopes(position: np.ndarray, thresholds: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log-likelihood of grades g: by each position, and by each threshold (a column each)."""
    up = 1 / (1 + np.exp(-np.clip(position[:, None] - thresholds[None, :], -30, 30)))
    bounds = np.concatenate([np.ones((len(g), 1)), up, np.zeros((len(g), 1))], 1)
    row = np.arange(len(g))
    chance = np.maximum(bounds[row, g] - bounds[row, g + 1], 1e-9)
    slope = bounds * (1 - bounds)
    cut = np.zeros((len(g), GRADES + 1))
    cut[row, g] -= slope[row, g] / chance
    cut[row, g + 1] += slope[row, g + 1] / chance
    return (slope[row, g] - slope[row, g + 1]) / chance, cut[:, 1:GRADES]


def fit(x: np.ndarray, at: np.ndarray, grade: np.ndarray, epochs: int = EPOCHS, rate: float = 0.2, shrink: float = 3e-4) -> Model:
    """Cumulative-link regression by AdaGrad over shuffled batches; thresholds stay in order by their gaps' logarithms."""
    there = np.unique(grade)
    if len(there) < 2:
        top = int(there[0]) if len(there) else GRADES - 1
        return Model(np.zeros(2 * DIM, dtype=np.float32), np.where(np.arange(1, GRADES) <= top, -40.0, 40.0))
    rng = np.random.Generator(np.random.PCG64(7))
    tail = np.array([np.clip((grade >= j).mean(), 1e-3, 1 - 1e-3) for j in range(1, GRADES)])
    cuts = -np.log(tail / (1 - tail))
    low, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 0.05))
    w = np.zeros(2 * DIM)
    seen, seen_cut = np.full(2 * DIM, 1e-3), np.full(GRADES - 1, 1e-3)
    count = np.diff(at)
    often = np.bincount(x, minlength=DIM) >= LEAST_DOCS
    often[DIM - 64 * _SHAPES :] = True
    common = often[x]
    at = np.append(0, np.cumsum(common, dtype=np.int32))[at]
    x, size = x[common], np.diff(at)
    for _ in range(epochs):
        order = rng.permutation(len(grade))
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            begin = np.append(0, np.cumsum(size[own]))
            xs = np.concatenate([x[at[i] : at[i + 1]] for i in own])
            thresholds = low + np.append(0, np.cumsum(np.exp(gaps)))
            model = Model(w, thresholds)
            position = model.position(xs, begin, count[own])
            pull, by_cut = slopes(position, thresholds, grade[own])
            each = np.repeat(pull, size[own])
            touched, inverse = np.unique(xs, return_inverse=True)
            for half, factor in ((0, 1.0), (DIM, np.repeat(1 / np.sqrt(count[own]), size[own]))):
                grad = np.bincount(inverse, weights=each * factor) / len(own)
                seen[half + touched] += grad * grad
                pace = rate / np.sqrt(seen[half + touched])
                moved = w[half + touched] + pace * grad
                w[half + touched] = np.sign(moved) * np.maximum(0.0, np.abs(moved) - pace * shrink)
            by_cut = by_cut.mean(0)
            grad = np.array([by_cut.sum(), *(by_cut[j + 1 :].sum() * np.exp(gaps[j]) for j in range(GRADES - 2))])
            seen_cut += grad * grad
            step = rate * grad / np.sqrt(seen_cut)
            low, gaps = low + step[0], gaps + step[1:]
    return Model(w.astype(np.float32), low + np.append(0, np.cumsum(np.exp(gaps))))


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels (doc_id, quality, toxic)."""
    good, toxic = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    return labels.filter(F.col("doc_id").isNotNull() & good.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(good == 0, 0).when(toxic != 0, 1).otherwise(2).alias("grade"))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Feature numbers, their bounds and grades of at most ``sample`` labelled documents."""
    told = {}
    for r in grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample).collect():
        told.setdefault(r.doc_id, r.grade)
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in told], "doc_id long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_features, "doc_id long, x binary")
    # a partition at a time, which the driver's heap is spared for
    rows = [(r.doc_id, r.x) for r in found.groupBy("doc_id").agg(F.min("x").alias("x")).toLocalIterator()]
    rows.sort(key=lambda r: r[0])
    sizes, grade = [len(x) // 4 for _, x in rows], np.array([told[i] for i, _ in rows], dtype=np.int64)
    x = np.empty(sum(sizes), dtype=np.int32)
    at = np.append(0, np.cumsum(sizes)).astype(np.int64)
    for i in range(len(rows)):
        x[at[i] : at[i + 1]] = np.frombuffer(rows[i][1], dtype=np.int32)
        rows[i] = None
    return x, at, grade


_SCORED = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("top_tail", pa.float64()), ("kept", pa.bool_())])
_SCORED_DDL = "doc_id long, expected_grade double, top_tail double, kept boolean"


def _score(model: Model, cut: float):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in c.text_parts(batch.column(1)):
                tails = model.tails(*numbers(data, offsets))
                yield c.table(_SCORED, doc_id=batch.column(0).slice(a, b - a), expected_grade=tails.sum(1), top_tail=tails[:, -1], kept=tails[:, -1] >= cut)

    return run


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, expected_grade, top_tail, kept) of every row of (doc_id, text); kept: the top grade is as likely as ``cut``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model, cut), _SCORED_DDL)


def select(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, whose top grade is as likely as ``cut``."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            keep = [np.zeros(0, dtype=bool)]
            for _, _, data, offsets in c.text_parts(batch.column(at)):
                keep.append(model.tails(*numbers(data, offsets))[:, -1] >= cut)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, schema)
