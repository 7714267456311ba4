"""Document trees: prefecture / city / district / file from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files under root with their place; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("last_modified"))
    return located(files, root)


def located(files: DataFrame, root: str = "", least_depth: int = 4) -> DataFrame:
    """Files (path) with prefecture, city, district, filename and full_address, by the levels under root; shallower ones are left out."""
    bare = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^.*?" + _quoted(root), "") if root else F.col("path")
    parts = F.split(F.regexp_replace(bare, "^/+", ""), "/")
    out = files.withColumn("__p", parts).filter(F.size("__p") >= least_depth)
    names = ("prefecture", "city", "district")
    out = out.select("*", *(F.col("__p")[i].alias(n) for i, n in enumerate(names)), F.element_at("__p", -1).alias("filename"))
    return out.withColumn("full_address", F.concat("prefecture", "city", "district")).drop("__p")


def _quoted(root: str) -> str:
    import re

    return re.escape(re.sub(r"^[a-z]+:/+", "/", root).rstrip("/"))


def suffix_location(path: Column) -> Column:
    """Struct prefecture, city, district from the end of a path; levels that it has not are null."""
    parts = F.split(path, "/")
    at = lambda i: F.when(F.size(parts) >= i, F.element_at(parts, -i))
    return F.struct(at(4).alias("prefecture"), at(3).alias("city"), at(2).alias("district"))


def folders(files: DataFrame) -> DataFrame:
    """Distinct places with display_name."""
    return files.select("prefecture", "city", "district").distinct().withColumn("display_name", F.concat_ws(" ", "prefecture", "city", "district"))


def files_by_district(files: DataFrame) -> DataFrame:
    return files.groupBy("prefecture", "city", "district").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def four_way_index(files: DataFrame) -> dict[str, DataFrame]:
    """Distinct prefectures, cities of each, districts of each, and files."""
    return {
        "prefectures": files.select("prefecture").distinct(),
        "cities": files.groupBy("prefecture").agg(F.array_sort(F.collect_set("city")).alias("cities")),
        "districts": files.groupBy("prefecture", "city").agg(F.array_sort(F.collect_set("district")).alias("districts")),
        "files": files.select("prefecture", "city", "district", "path"),
    }


def misplaced(dirs: DataFrame, wards: DataFrame) -> DataFrame:
    """Directories (prefecture, name) at city level that are a ward of a city (prefecture, city, ward, ord): the first city's, with the right path."""
    hit = dirs.join(wards, (dirs.prefecture == wards.prefecture) & (dirs.name == wards.ward)).select(dirs.prefecture, dirs.name, wards.city, wards.ord)
    first = hit.groupBy("prefecture", "name").agg(F.min_by("city", "ord").alias("city"))
    return first.withColumn("current_path", F.concat_ws("/", "prefecture", "name")).withColumn("correct_path", F.concat_ws("/", "prefecture", "city", "name")).filter("current_path <> correct_path")


def moves(files: DataFrame, wards: DataFrame) -> DataFrame:
    """(path, target) of every file (path) whose directory at city level is a misplaced ward."""
    part = F.split("path", "/")
    at = files.select("path", part[0].alias("prefecture"), part[1].alias("name"))
    plan = misplaced(at.select("prefecture", "name").distinct(), wards)
    rest = F.expr("substring(path, char_length(current_path) + 1)")
    return at.join(plan, ["prefecture", "name"]).select("path", F.concat("correct_path", rest).alias("target"))


def move_plan_report(plan: DataFrame) -> DataFrame:
    """(city, report) of misplaced wards."""
    return plan.groupBy("city").agg(F.concat_ws(", ", F.array_sort(F.collect_list("name"))).alias("report"))
