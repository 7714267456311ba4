"""Approximate nearest neighbours with a permutation index.

A bounded sample of vectors gives PIVOTS pivots, which the driver holds.  A vector is represented by
the order of all pivots by nearness.  Every vector is posted in the inverted files of the POSTED pivots
nearest to it, and a query goes to the files of the ASKED pivots nearest to it and to no others.  In a
file the query ranks what is posted there by Spearman's footrule of the two orders and reranks the best
(SHARE of each block of a file, LEAST at least) by Euclidean distance.

Files and queries are blocks of rows, joined on the pivot by a sort-merge join, so a task holds one
block of each at a time.  A file of more than FILE_ROWS vectors, or one asked by more than
FILE_QUERIES queries, is split into shares, and every share of one side meets every share of the other.
Only counts for each pivot reach the driver.

Equal vectors are one posting, with their k + 1 smallest ids (no query needs more), so a vector that a
third of all rows share fills neither a file nor a rerank list.  Queries with equal vectors are asked once.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do null vec_ids and vectors of another length than the commonest one (the shortest of equally
common ones); equal distances rank by vec_id; with fewer than k candidates all are returned; rows
of a repeated vec_id are one candidate each by its smallest distance, and are queries together; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapsieve.llm import common as c

PIVOTS = 256
POSTED, ASKED = 2, 96
SHARE, LEAST = 0.06, 100
BLOCK_ROWS, QUERY_ROWS = 4096, 512
FILE_ROWS, FILE_QUERIES = 1 << 16, 1 << 14
#: Rows that a task holds before it deals them to files, and found rows that it holds before it merges them.
_HELD, _FOUND_ROWS = 1 << 17, 1 << 19
_FOUND = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_BLOCK = pa.schema([("pivot", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("many", pa.binary()), ("vectors", pa.binary())])
_BLOCK_DDL = "pivot int, n long, ids binary, many binary, vectors binary"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part; components keep their type where they are float, else are double."""
    v = F.col("embedding")
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    sound = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(kind).alias("embedding")).filter(sound)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("embedding") == (sizes[0].d if sizes else 0))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """(class, ids array, embedding): the distinct vectors with at most so many of their smallest ids."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.distinct().withColumn("rank", rank).filter(F.col("rank") <= ids)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("embedding").alias("class"), "ids", "embedding")


def ranks(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of every pivot in each vector's order, nearest first, ties to the earlier pivot (at most 256 pivots)."""
    near = (pivots * pivots).sum(1) - 2 * vectors @ pivots.T
    order = np.argsort(near, axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.uint8)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.uint8), order.shape), 1)
    return out


def _post(pivots: np.ndarray, most: int, rows: int, kind: str):
    """Blocks for the files of the ``most`` pivots nearest to each vector; rows: (ids array, embedding)."""
    dim = pivots.shape[1]

    def run(batches):
        held, size = [], 0

        def flush():
            nonlocal held, size
            many, ids, v = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
            held, size = [], 0
            at = np.cumsum(many) - many
            pivot = np.argsort(ranks(v.astype(np.float64), pivots), axis=1, kind="stable")[:, :most]
            order = np.argsort(pivot.ravel(), kind="stable")
            there, begin = np.unique(pivot.ravel()[order], return_index=True)
            out = []
            for p, i, j in zip(there.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
                for low in range(i, j, rows):
                    own = order[low : min(j, low + rows)] // most
                    spot = np.arange(int(many[own].sum())) - np.repeat(np.cumsum(many[own]) - many[own], many[own]) + np.repeat(at[own], many[own])
                    out.append((p, len(own), ids[spot].tobytes(), many[own].astype(np.int32).tobytes(), v[own].tobytes()))
            for i in range(0, len(out), 64):
                yield c.table(_BLOCK, **{name: [x[k] for x in out[i : i + 64]] for k, name in enumerate(_BLOCK.names)})

        for batch in batches:
            if batch.num_rows:
                lists, v = batch.column(0), batch.column(1)
                held.append((np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(), v.flatten().to_numpy().astype(kind).reshape(-1, dim)))
                size += batch.num_rows
                if size >= _HELD:
                    yield from flush()
        if size:
            yield from flush()

    return run


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spearman's footrule between the places a (m) and each row of b (n, m)."""
    return (np.maximum(b, a) - np.minimum(b, a)).sum(1, dtype=np.uint32)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest ids of every query, each id by its smallest score; ties to the smaller id."""
    order = np.lexsort((score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[: len(query)]
    query, ids, score = query[first], ids[first], score[first]
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    return query[place < k], ids[place < k], score[place < k]


def _search(pivots: np.ndarray, k: int, kind: str):
    dim = pivots.shape[1]

    def read(row, name):
        many = np.frombuffer(row[f"{name}many"], dtype=np.int32)
        v = np.frombuffer(row[f"{name}vectors"], dtype=kind).reshape(-1, dim).astype(np.float64)
        return many, np.frombuffer(row[f"{name}ids"], dtype=np.int64), ranks(v, pivots), v

    def run(batches):
        found, size = [], 0
        last: dict[str, tuple] = {}

        def kept(row, name):
            # the join brings the same block several times in a row
            key = row[f"{name}ids"].to_pybytes()
            if name not in last or last[name][0] != key:
                last[name] = key, read(row, name)
            return last[name][1]

        def merged():
            return best_of(*(np.concatenate([x[i] for x in found]) for i in range(3)), k)

        for row in c.rows_of(batches):
            many, ids, place, v = kept(row, "")
            _, names, q_place, q_v = kept(row, "q_")
            at = np.cumsum(many) - many
            most = max(LEAST, k, int(SHARE * len(v)))
            # squares of the distances, near enough to tell which are looked at exactly
            squares = (v * v).sum(1)[None, :], (q_v * q_v).sum(1)[:, None]
            far = squares[0] + squares[1] - 2 * (q_v @ v.T)
            if not np.isfinite(far).all():  # the squares of very large components
                far = np.stack([((v - q) ** 2).sum(1) for q in q_v])
            if len(v) > most:
                for i, q_rank in enumerate(q_place):
                    by_rank = footrule(q_rank, place)
                    # all that tie with the last stay, so that the order of a block's rows does not matter
                    far[i, by_rank > np.partition(by_rank, most - 1)[most - 1]] = np.inf
            edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if len(v) > k else far.max(axis=1, keepdims=True)
            asked, own = np.nonzero(far <= edge + 1e-10 * (squares[0] + squares[1]))
            score = np.sqrt(((v[own] - q_v[asked]) ** 2).sum(1))
            spot = np.arange(int(many[own].sum())) - np.repeat(np.cumsum(many[own]) - many[own], many[own]) + np.repeat(at[own], many[own])
            found.append((np.repeat(names[asked], many[own]), ids[spot], np.repeat(score, many[own])))
            size += len(spot)
            if size >= _FOUND_ROWS:
                found = [merged()]
                size = len(found[0][0])
                if size >= _FOUND_ROWS // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found[0])), schema=_FOUND)
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged())), schema=_FOUND)

    return run


def _shares(blocks: DataFrame, most: int) -> dict[int, int]:
    """Pivots with more than ``most`` rows in their blocks, and into how many shares they are split."""
    return {r.pivot: -(-r.n // most) for r in blocks.groupBy("pivot").agg(F.sum("n").alias("n")).filter(F.col("n") > most).collect()}


def _paired(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Every block of a file with every block of queries that ask it."""
    split = [_shares(files, FILE_ROWS), _shares(asked, FILE_QUERIES)]

    def of(own: dict[int, int]):
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), F.col("pivot")), F.lit(1)) if own else F.lit(1)

    def dealt(blocks, own, other):
        mine = F.pmod(F.xxhash64("ids"), of(split[own])).cast("int").alias(f"share_{own}")
        theirs = F.explode(F.sequence(F.lit(0), of(split[other]).cast("int") - 1)).alias(f"share_{other}")
        return blocks.select("*", mine, theirs)

    queries = dealt(asked, 1, 0)
    queries = queries.select("pivot", "share_0", "share_1", *(F.col(x).alias(f"q_{x}") for x in ("n", "ids", "many", "vectors")))
    return dealt(files, 0, 1).join(queries.hint("merge"), ["pivot", "share_0", "share_1"])


def search(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest others of each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    rows = c.stored(usable(rows))
    spark = rows.sparkSession
    kind = "f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    # one more than asked for, as a query finds itself
    own = c.stored(classes(rows, k + 1))
    sample = own.select("class", "embedding").orderBy("class").limit(PIVOTS).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = np.array([r.embedding for r in sample], dtype=np.float64)
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding", F.xxhash64("embedding").alias("class")).distinct()
    asking = queries.select(F.array("class").alias("ids"), "embedding").distinct()
    files = c.stored(own.select("ids", "embedding").mapInArrow(_post(pivots, POSTED, BLOCK_ROWS, kind), _BLOCK_DDL))
    asked = c.stored(asking.mapInArrow(_post(pivots, ASKED, QUERY_ROWS, kind), _BLOCK_DDL))
    found = _paired(files, asked).mapInArrow(_search(pivots, k + 1, kind), "query long, vec_id long, score double")
    found = found.groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k + 1).drop("rank")
    # a query's id is left out wherever it was found, and ranks are counted again
    found = queries.select(F.col("vec_id").alias("query_id"), F.col("class").alias("query")).join(found, "query").filter("query_id <> vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
