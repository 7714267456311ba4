"""SQLite database files as tables: each file is opened in memory by the task that reads it."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that a task hands on at a time.
ROWS = 10_000


def read(spark: SparkSession, folder: str, query: str, schema: str | StructType, pattern: str = "*.db") -> DataFrame:
    """The rows of a query, run in every database file under a folder; columns are matched to the schema by position."""
    kinds = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("content")
    names = kinds.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with sqlite3.connect(":memory:") as con:
                    con.deserialize(bytes(content))
                    rows = con.execute(query)
                    while part := rows.fetchmany(ROWS):
                        yield pd.DataFrame(part, columns=names)

    return files.repartition(F.md5("content")).mapInPandas(run, kinds)


def dump(tables: dict[str, pd.DataFrame]) -> bytes:
    """A database file with the given small tables."""
    with sqlite3.connect(":memory:") as con:
        for name, rows in tables.items():
            rows.to_sql(name, con, index=False)
        return con.serialize()
