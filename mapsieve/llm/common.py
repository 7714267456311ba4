"""Shared text kernels, the packed-corpus table and shared-folder tables.

The packed corpus keeps documents in *chunks*: one row holds the ids, the offsets and the
concatenated UTF-8 bytes of some megabytes of documents.  It is written once, bucketed by chunk
id, so a later pass can join per-chunk replies without moving the text again.  Operators then
exchange messages: chunks send compact binary requests to hash buckets, buckets send replies to
chunks.  Both sides are plain DataFrames; only the bytes in a message are laid out by numpy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one packed chunk aims at; a longer document makes a longer chunk of its own.
CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TABLE_FOLDED = _TABLE[_FOLD]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_powers: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of this machine if all of Spark runs on it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints/mapsieve"
    return found.rstrip("/")


#: What this process has written into shared folders, and the names of tables among it.
_written: list[tuple[str, str | None]] = []


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; results that still read them must have been written before."""
    while _written:
        path, name = _written.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    _written.append((path, None))
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- text kernels


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for n positions at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, x, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray, folded: bool = False) -> np.ndarray:
    """P with P[j] - P[i] a shifted polynomial hash of data[i:j]; see span_hash."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((_TABLE_FOLDED if folded else _TABLE)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that all bits of a hash depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word ``[^\\x20\\x09-\\x0D]+``; words end where a document ends."""
    if not len(data):
        return (np.zeros(0, dtype=np.int64),) * 3
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the ASCII punctuation marks at either edge; a word of such marks alone ends empty."""
    marked = np.flatnonzero(_MARK[data[start]] | _MARK[data[end - 1]])
    plain, a, b = np.flatnonzero(~_MARK[data]), start[marked], end[marked]
    left, right = np.searchsorted(plain, a), np.searchsorted(plain, b)
    some = left < right
    at = np.append(plain, 0)
    start, end = start.copy(), end.copy()
    start[marked], end[marked] = np.where(some, at[left], a), np.where(some, at[np.maximum(right, 1) - 1] + 1, a)
    return start, end


def word_hashes(data: np.ndarray, offsets: np.ndarray, folded: bool = True, strip: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The mixed 64-bit hash of every word and the words before each document: word i of document d is hashes[first[d] + i]."""
    start, end, doc = words(data, offsets)
    if strip and len(start):
        start, end = stripped(data, start, end)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return mix(span_hash(prefix_hash(data, folded), start, end) + (end - start).astype(np.uint64)), first


# ---------------------------------------------------------------- Arrow


def text_parts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for slices of about limit bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n), data[offsets[at] : offsets[min(to, n)]], offsets[at : min(to, n) + 1] - offsets[at]
        at = min(to, n)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


# ---------------------------------------------------------------- packed corpus

PACKED = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("offsets", pa.binary()), ("data", pa.binary()), ("rest_offsets", pa.binary()), ("rest", pa.binary())])
PACKED_DDL = "chunk long, size long, ids binary, known binary, offsets binary, data binary, rest_offsets binary, rest binary"


#: Buckets that one writing task fills; it leaves so many files at most, whatever it reads.
SPREAD = 4


def spark_hash(x: np.ndarray) -> np.ndarray:
    """The engine's hash() of 64-bit integers (Murmur3, seed 42), by which a bucketed table deals its rows."""
    x = np.asarray(x, dtype=np.int64).view(np.uint64)
    h = np.full(len(x), 42, dtype=np.uint32)
    for k in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
        k = k * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h ^= k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def chunk_id(part: int, seq: int, buckets: int) -> int:
    """An id for a task's chunk that the engine deals to one of the task's own buckets."""
    target, base = (part * SPREAD + seq % SPREAD) % buckets, (part << 40) + (seq << 20)
    for low in range(0, 1 << 20, step := max(256, 8 * buckets)):
        ids = base + np.arange(low, min(low + step, 1 << 20), dtype=np.int64)
        fit = np.flatnonzero(spark_hash(ids) % np.int32(buckets) == target)
        if len(fit):
            return int(ids[fit[0]])
    return base


def _packer(buckets: int, chunk_bytes: int):
    return lambda batches: _pack(batches, buckets, chunk_bytes)


def _pack(batches: Iterator[pa.RecordBatch], buckets: int, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def joined(k):
        offsets, at = [np.zeros(1, dtype=np.int64)], 0
        for x in held:
            offsets.append(x[k][1:] + at)
            at += int(x[k][-1])
        return np.concatenate(offsets).tobytes(), b"".join(x[k + 1] for x in held)

    def flush():
        nonlocal held, size, seq
        (offsets, data), (rest_offsets, rest) = joined(2), joined(4)
        row = table(PACKED, chunk=[chunk_id(part, seq, buckets)], size=[len(data)], ids=[b"".join(x[0] for x in held)], known=[b"".join(x[1] for x in held)], offsets=[offsets], data=[data], rest_offsets=[rest_offsets], rest=[rest])
        held, size, seq = [], 0, seq + 1
        return row

    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        known = np.asarray(ids.is_valid())
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in text_parts(batch.column(1)):
            (rest, rest_offsets), *more = [x[2:] for x in text_parts(batch.column(2).slice(a, b - a), 1 << 62)]
            held.append((values[a:b].tobytes(), known[a:b].tobytes(), offsets, data.tobytes(), rest_offsets, rest.tobytes()))
            size += len(data) + len(rest) + 32 * (b - a)
            if size >= chunk_bytes * 3 // 4:
                yield flush()
    if held:
        yield flush()


#: Text bytes that one bucket of a packed table, and one bucket of messages, aims at.
TABLE_BUCKET_BYTES = 128 << 20
MESSAGE_BUCKET_BYTES = 8 << 20
_MOST_TABLE_BUCKETS = 1 << 16


class Corpus(NamedTuple):
    """A packed table and its number of buckets."""

    rows: DataFrame
    buckets: int

    def message_bits(self) -> int:
        """Binary digits of the number of message buckets: by the bytes of the corpus alone, whatever the session's settings."""
        size = self.rows.agg(F.sum("size")).first()[0] or 0
        return max(4, min(24, (-(-size // MESSAGE_BUCKET_BYTES) - 1).bit_length()))

    def dealt(self, messages: DataFrame, bits: int, *keys: str) -> DataFrame:
        """Messages partitioned by their keys, in more partitions than the session has where there are more buckets."""
        parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return messages.repartition(1 << bits, *keys) if 1 << bits > parts else messages


def guessed_bytes(df: DataFrame) -> int | None:
    """The optimizer's guess of a table's size, or None where it has none; for layouts, never for results."""
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return guess if guess < 1 << 60 else None


def packed(docs: DataFrame, whole: bool = False, chunk_bytes: int = CHUNK_BYTES) -> Corpus:
    """Write (doc_id, text) as a packed corpus table, bucketed by chunk, and read it back.

    The text is written once and never shuffled.  There are at least as many buckets as
    ``spark.sql.shuffle.partitions`` (more where TABLE_BUCKET_BYTES asks for them), so that a join
    on chunk moves the other side only.  Chunk ids are chosen so that a task fills SPREAD buckets,
    which keeps files few and large.
    whole: the other columns come along as a JSON text of each row; see unpacked_rows.
    chunk_bytes: what a chunk aims at; larger chunks send fewer messages.
    """
    spark = docs.sparkSession
    name = f"packed_{uuid.uuid4().hex}"
    _written.append((f"{shared_dir(spark)}/{name}", name))
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(_MOST_TABLE_BUCKETS, (guessed_bytes(docs) or 0) // TABLE_BUCKET_BYTES))
    others = [x for x in docs.columns if x not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*(F.col(f"`{x}`") for x in others))) if whole and others else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), rest.alias("rest")).mapInArrow(_packer(buckets, chunk_bytes), PACKED_DDL)
    rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "chunk").saveAsTable(name)
    return Corpus(spark.table(name), buckets)


ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("rest", pa.string())])
ROWS_DDL = "doc_id long, text binary, rest string"


def rows_at(row: dict, places: np.ndarray, texts: list | None = None) -> pa.RecordBatch:
    """Rows of a chunk (packed whole), as ROWS; texts: what to put in place of their texts."""
    ids, known, offsets, data = unpacked(row)
    at, rest = np.frombuffer(row["rest_offsets"], dtype=np.int64), row["rest"].to_pybytes()
    texts = [data[offsets[p] : offsets[p + 1]].tobytes() for p in places] if texts is None else texts
    return table(ROWS, doc_id=ids_column(ids[places], known[places]), text=texts, rest=[rest[at[p] : at[p + 1]].decode() for p in places])


def unpacked_rows(rows: DataFrame, schema) -> DataFrame:
    """ROWS as a table of the given schema; bytes of a character that was cut apart are dropped."""
    others = [f for f in schema if f.name not in ("doc_id", "text")]
    kind = "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in others) + ">"
    parsed = rows.withColumn("rest", F.from_json("rest", kind)) if others else rows
    text = F.col("text").cast("string")
    return parsed.select(*(F.col("doc_id").cast(f.dataType).alias("doc_id") if f.name == "doc_id" else text.alias("text") if f.name == "text" else F.col(f"rest.`{f.name}`").alias(f.name) for f in schema))


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, known (false where the id is null), offsets and bytes of one packed row."""
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["known"], dtype=bool), np.frombuffer(row["offsets"], dtype=np.int64), np.frombuffer(row["data"], dtype=np.uint8)


def with_replies(corpus: Corpus, replies: DataFrame) -> DataFrame:
    """Packed rows with the list of replies to their chunk: replies (chunk, reply binary) -> column replies."""
    if corpus.buckets > int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        replies = replies.repartition(corpus.buckets, "chunk")
    lists = replies.groupBy("chunk").agg(F.collect_list("reply").alias("replies"))
    return corpus.rows.join(lists.hint("shuffle_hash"), "chunk", "left")


#: Rows of one key that a join may gather in one task, and the greatest number of shares that a key is split into.
HOT_ROWS, MOST_SHARES = 100_000, 64


def hot_join(left: DataFrame, few: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined with few (and ``n``: how many rows of left a key meets), so that no hot key gathers in one task; how: left or inner.

    few is a stored table, which is measured.  It is broadcast where it is below the session's
    broadcast threshold.  Otherwise its hot keys alone are, where they are below it; failing that too,
    few's rows are repeated for each share of left's rows (by the hash of left's first two columns that
    are no keys, so that a task that runs again deals its rows as before).
    """
    rows, hot, most = few.agg(F.count("*"), F.count(F.when(F.col("n") > HOT_ROWS, 1)), F.coalesce(F.max("n"), F.lit(0))).first()
    threshold, size = int(few.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()), guessed_bytes(few) or 0
    fits = lambda n: size * n <= threshold * rows
    if fits(rows):
        return left.join(F.broadcast(few.drop("n")), keys, how)
    if not hot:
        return left.join(few.drop("n").hint("merge"), keys, how)
    if fits(hot):
        of_hot = few.filter(F.col("n") > HOT_ROWS).drop("n")
        cold = left.join(F.broadcast(of_hot.select(*keys).distinct()), keys, "left_anti")
        return left.join(F.broadcast(of_hot), keys).unionByName(cold.join(few.filter(F.col("n") <= HOT_ROWS).drop("n").hint("merge"), keys, how))
    shares = min(MOST_SHARES, -(-most // HOT_ROWS))
    own = [x for x in left.columns if x not in keys]
    left = left.withColumn("__share", F.pmod(F.xxhash64(*own[:2]), F.lit(shares)))
    few = few.drop("n").withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return left.join(few.hint("merge"), [*keys, "__share"], how).drop("__share")


def split_join(left: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with few (unique keys, computed from a shuffle by them): shuffled once more, which lets adaptive execution split a hot key's rows of left."""
    return left.join(few.repartition(*keys), keys, how)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches one by one; binary values stay buffers."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            out = {}
            for name, column in zip(names, batch.columns, strict=True):
                x = column[i]
                if pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type):
                    out[name] = x.as_buffer()
                elif pa.types.is_list(x.type):
                    out[name] = [y.as_buffer() for y in x.values] if x.is_valid else []
                else:
                    out[name] = x.as_py()
            yield out


def as_bytes(numbers) -> Column:
    """An array<long> column as binary, eight bytes each, big end first; see numbers_of."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def numbers_of(raw, offset: int = 0) -> np.ndarray:
    return np.frombuffer(raw, dtype=">i8", offset=offset).astype(np.int64)


def ids_column(ids: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(ids, type=pa.int64(), mask=~known)


def by_bucket(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that groups keys by their top bits; the buckets there are, and where each begins (with the end)."""
    order = np.argsort(key, kind="stable")
    bucket = (key[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), dtype=np.int64)
    there, at = np.unique(bucket, return_index=True)
    return order, there, np.append(at, len(key))
