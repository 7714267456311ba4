"""python -m mapsieve: runs a registered query over a folder of tables, searches it, or lists the queries."""

import argparse
import datetime as dt

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    ask = argparse.ArgumentParser(prog="mapsieve", description=__doc__)
    ask.add_argument("query", nargs="?", help="name of a query; without one, and without a search, the names are listed")
    ask.add_argument("--tables", "--input", default="/root/testdata/sf0.001", help="folder of the tables")
    ask.add_argument("--out", "--output", help="folder for the result, as Parquet; else its first rows are shown")
    ask.add_argument("--rows", type=int, default=20, help="rows that are shown")
    ask.add_argument("--search", help="text to search among the detections of a place's files")
    ask.add_argument("--address", help="address whose files are searched")
    for level in ("prefecture", "city", "district"):
        ask.add_argument(f"--{level}", default="", help="place that a search is held to")
    ask.add_argument("--similarity", type=float, default=70.0, help="least similarity of a search, 0 to 100")
    ask.add_argument("--max-results", type=int, default=50, help="most rows of a search, 1 to 200")
    ask.add_argument("--max-files", type=int, default=50, help="files that a search opens")
    ask.add_argument("--stats", action="store_true", help="show the service's counts")
    ask.add_argument("--debug", action="store_true", help="show the plan as well")
    return ask


def answer(spark: SparkSession, args: argparse.Namespace):
    """The table that the flags ask for, or None where names are to be listed."""
    from mapsieve.plans import derived
    from mapsieve.plans.registry import QUERIES
    from mapsieve.service import SearchService
    from mapsieve.sources.config import ServiceLimits

    if args.query:
        return QUERIES[args.query](spark, args.tables)
    if not (args.search or args.address or args.stats):
        return None
    files, pages = derived.files(spark, args.tables), derived.pages(spark, args.tables)
    found = derived.detections(spark, args.tables).join(pages.select("page_id", "pdf_id"), "page_id").join(files.selectExpr("file_id AS pdf_id", "path"), "pdf_id")
    service = SearchService(spark, files, found, ServiceLimits(args.similarity, args.max_results, max_files=args.max_files))
    if args.stats:
        return spark.createDataFrame([tuple(map(float, service.stats().values()))], list(service.stats()))
    if args.address:
        return service.by_address(args.address)
    return service.by_text(args.search, dt.datetime.now(), **{k: v for k in ("prefecture", "city", "district") if (v := getattr(args, k))})


def main() -> None:
    args = parser().parse_args()
    from mapsieve.plans.registry import QUERIES

    if not (args.query or args.search or args.address or args.stats):
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("mapsieve").getOrCreate()
    df = answer(spark, args)
    if args.debug:
        df.explain("formatted")
    df.write.mode("overwrite").parquet(args.out) if args.out else df.show(args.rows, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
