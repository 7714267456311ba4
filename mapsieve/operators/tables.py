"""Relational tables of the store: joins, upserts, appends and logs, without a mutable database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapsieve.operators.storage import written


def with_pages(rows: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """rows (page_id) with their page (page_id, pdf_id, page_number) and file (pdf_id, filename)."""
    return rows.join(pages, "page_id").join(files, "pdf_id")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], defaults: dict[str, Column] | None = None, order: list[Column] | None = None) -> DataFrame:
    """New rows take the place of those with equal keys; columns that new lacks get their defaults, else null.

    Of several new rows of a key the last by ``order`` stays.
    """
    defaults = defaults or {}
    for name in existing.columns:
        if name not in new.columns:
            new = new.withColumn(name, defaults.get(name, F.lit(None).cast(existing.schema[name].dataType)))
    if order:
        w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
        new = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def append_with_ids(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the greatest id there is, without gaps, in the order given (ties by the hash of the row).

    Rows are sorted into ranges and written once with the number of their range and their place in
    it; both the sizes of the ranges and the rows are read from there, so they belong to one sort.
    """
    start = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).first()[0]
    spark, by = new.sparkSession, [*order, F.xxhash64(*new.columns)]
    number = F.monotonically_increasing_id()  # the partition's number above 33 bits, the row's place below
    ranged = written(new.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", number))
    ranged = ranged.withColumn("__p", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    before, total = [], start
    for p, n in sorted((r["__p"], r["count"]) for r in ranged.groupBy("__p").count().collect()):
        before.append((p, total))
        total += n
    offsets = spark.createDataFrame(before, "__p long, __before long")
    numbered = ranged.join(F.broadcast(offsets), "__p").withColumn(key, (F.col("__before") + F.col("__at") + 1).cast(existing.schema[key].dataType))
    return existing.unionByName(numbered.select(*existing.columns))


def recreate(df: DataFrame, path: str) -> DataFrame:
    """The table at path dropped, made anew of df, and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_history(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1000, keep: int = 500) -> DataFrame:
    """Of every key with more than ``most`` rows the last ``keep`` by order, of others all."""
    w = Window.partitionBy(*keys)
    placed_rows = rows.withColumns({"__n": F.count("*").over(w), "__at": F.row_number().over(w.orderBy(*order))})
    return placed_rows.filter((F.col("__n") <= most) | (F.col("__at") > F.col("__n") - keep)).drop("__n", "__at")


def placed(df: DataFrame, first: Column, bucket: Column, order: list[Column]) -> DataFrame:
    """df with ``place``, the number of each row in an order that begins with first (descending), then bucket (ascending); no row is left out.

    Rows are numbered within their bucket; what stands before it comes from counts, so that no task sorts the whole table.
    """
    df = df.withColumns({"__f": first, "__b": bucket})
    counts = df.groupBy("__f", "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.groupBy("__f").agg(F.sum("__n").alias("__n"))
    above = F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__f")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("__before", before).alias("o").join(firsts.withColumn("__above", above).alias("s"), F.col("o.__f").eqNullSafe(F.col("s.__f"))).select(F.col("o.__f").alias("__g"), F.col("o.__b").alias("__c"), (F.col("__above") + F.col("__before")).alias("__offset"))
    rows = df.withColumn("__row", F.row_number().over(Window.partitionBy("__f", "__b").orderBy(*order)))
    joined = rows.join(at, F.col("__f").eqNullSafe(F.col("__g")) & F.col("__b").eqNullSafe(F.col("__c")))
    return joined.withColumn("place", F.col("__offset") + F.col("__row")).drop("__f", "__b", "__g", "__c", "__offset", "__row")


def processing_log(results: DataFrame) -> DataFrame:
    """(pdf_path, status, addresses_count, error_message) of files (pdf_path, addresses_count, error_message)."""
    status = F.when(F.col("error_message").isNotNull(), "error").when(F.col("addresses_count") > 0, "success").otherwise("no_addresses")
    return results.select("pdf_path", status.alias("status"), F.coalesce("addresses_count", F.lit(0)).alias("addresses_count"), "error_message")


def expired(cache: DataFrame, as_of) -> DataFrame:
    return cache.filter(F.col("expires_at") <= F.lit(as_of))


def live(cache: DataFrame, as_of) -> DataFrame:
    return cache.filter(F.col("expires_at") > F.lit(as_of))


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_hash").agg(F.count("*").alias("hit_count"))


def missing_downloads(tasks: DataFrame, there: DataFrame) -> DataFrame:
    """Tasks (url, path) whose path is not there yet."""
    return tasks.join(there.select("path").distinct(), "path", "left_anti")


def as_json(df: DataFrame, simplified: list[str] | None = None) -> DataFrame:
    """One JSON text a row; simplified: of these columns only."""
    columns = simplified or df.columns
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
