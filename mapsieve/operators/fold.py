"""Order-dependent suppression and grouping of a page's detections.

A page's rows are gathered in order into one array and folded over: each row is held against
what has been kept so far.  The fold is an expression, so it runs inside the engine; pages are
the unit of work, as large as what was detected on one sheet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Hit = Callable[[Column, Column], Column]


def _gathered(df: DataFrame, by: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """One row a group: its rows as structs, in order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("__at", place).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__at", *fields))).alias("__rows"))
    return rows.withColumn("__rows", F.transform("__rows", lambda r: F.struct(*(r[f].alias(f) for f in fields))))


def _none_of(rows: Column) -> Column:
    return F.filter(rows, lambda r: F.lit(False))


def greedy_dedupe(df: DataFrame, by: list[str], order: list[Column], hit: Hit, better: Hit | None = None) -> DataFrame:
    """Rows that no kept row before them hits; better(new, kept): a later row that hits takes the first kept one's place."""
    fields = [x for x in df.columns if x not in by]

    def step(kept, row):
        hits = F.transform(kept, lambda k: F.coalesce(hit(k, row), F.lit(False)))
        first = F.array_position(hits, True)
        if better is None:
            return F.when(first == 0, F.array_append(kept, row)).otherwise(kept)
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == first) & F.coalesce(better(row, k), F.lit(False)), row).otherwise(k))
        return F.when(first == 0, F.array_append(kept, row)).otherwise(swapped)

    folded = _gathered(df, by, order, fields).withColumn("__kept", F.aggregate("__rows", _none_of(F.col("__rows")), step))
    return folded.select(*by, F.inline("__kept")).select(*df.columns)


def seed_groups(df: DataFrame, by: list[str], order: list[Column], hit: Hit) -> DataFrame:
    """(by.., group, members): each row joins the first group whose first row it hits, or begins a group."""
    fields = [x for x in df.columns if x not in by]

    def step(groups, row):
        first = F.array_position(F.transform(groups, lambda g: F.coalesce(hit(g["members"][0], row), F.lit(False))), True)
        own = F.struct(F.array(row).alias("members"))
        grown = F.transform(groups, lambda g, i: F.when(i + 1 == first, F.struct(F.array_append(g["members"], row).alias("members"))).otherwise(g))
        return F.when(first == 0, F.array_append(groups, own)).otherwise(grown)

    rows = _gathered(df, by, order, fields)
    start = F.filter(F.array(F.struct(F.col("__rows").alias("members"))), lambda g: F.lit(False))
    folded = rows.withColumn("__groups", F.aggregate("__rows", start, step))
    return folded.select(*by, F.posexplode("__groups").alias("group", "__g")).select(*by, "group", F.col("__g.members").alias("members"))


def best_of_groups(groups: DataFrame, by: list[str], key: Callable[[Column], Column]) -> DataFrame:
    """The member with the greatest key of each group, the first of equal ones."""
    best = F.aggregate("members", F.col("members")[0], lambda a, m: F.when(key(m) > key(a), m).otherwise(a))
    return groups.select(*by, "group", best.alias("__m")).select(*by, "group", "__m.*")


def islands(df: DataFrame, by: list[str], order: list[Column], apart: Hit, name: str = "island") -> DataFrame:
    """Number runs of rows (from 0) in which no row is apart from the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    fields = [x for x in df.columns if x not in by]
    this, before = F.struct(*fields), F.lag(F.struct(*fields)).over(w)
    marked = df.withColumn("__this", this).withColumn("__before", before)
    new = F.when(F.col("__before").isNull(), 0).otherwise(apart(F.col("__before"), F.col("__this")).cast("int"))
    return marked.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__this", "__before", "__new")


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
