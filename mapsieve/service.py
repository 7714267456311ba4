"""The search service as functions over tables: what its web routes answer, without a web server."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapsieve.functions import text as T
from mapsieve.operators import fold, search, storage, tables
from mapsieve.sources.config import ServiceLimits

CACHE_DDL = "query_hash string, results string, hit_count long, created_at timestamp, expires_at timestamp"
LOG_DDL = "query_hash string, hit boolean"


class SearchService:
    """Searches files (prefecture, city, district, path) and detections (path, text, confidence, page_id, idx)."""

    def __init__(self, spark: SparkSession, files: DataFrame, detections: DataFrame, limits: ServiceLimits | None = None):
        self.spark, self.files, self.detections, self.limits = spark, files, detections, limits or ServiceLimits()
        self.at = storage.shared_path(spark, "service")
        self.clear_cache()
        spark.createDataFrame([], LOG_DDL).write.mode("overwrite").parquet(f"{self.at}/log")

    @property
    def cache(self) -> DataFrame:
        """The newest entry of every query."""
        rows = self.spark.read.schema(CACHE_DDL).parquet(f"{self.at}/cache-{self.generation}")
        return fold.best_per_key(rows, ["query_hash"], [F.desc("created_at")])

    def _logged(self, key: str, hit: bool) -> None:
        self.spark.createDataFrame([(key, hit)], LOG_DDL).coalesce(1).write.mode("append").parquet(f"{self.at}/log")

    def prefectures(self) -> DataFrame:
        return self.files.select("prefecture").distinct().orderBy("prefecture")

    def cities(self, prefecture: str) -> DataFrame:
        return search.by_location(self.files, prefecture).select("city").distinct().orderBy("city")

    def districts(self, prefecture: str, city: str) -> DataFrame:
        return search.by_location(self.files, prefecture, city).select("district").distinct().orderBy("district")

    def query_hash(self, query: str, **place: str) -> str:
        """Of all that decides the answer."""
        parts = [query, *(place.get(k, "") for k in ("prefecture", "city", "district")), self.limits.similarity, self.limits.max_results]
        return hashlib.md5("_".join(map(str, parts)).encode()).hexdigest()

    def by_address(self, query: str) -> DataFrame:
        """Files by the places that a query names."""
        wanted = T.parse_address(query)
        if wanted["prefecture"]:
            # only what the query names comes to the driver
            named = search.by_location(self.files, wanted["prefecture"]).filter(F.lit(query).contains(F.col("city"))).select("city").distinct().orderBy("city")
            cities = tuple(r.city for r in named.collect())
            wanted = T.parse_address(query, cities)
        return search.hierarchical_search(self.files, wanted, self.limits.max_results)

    def by_text(self, query: str, as_of: dt.datetime, **place: str) -> DataFrame:
        """Detections of the first files of a place, by similarity; answers are cached for a while."""
        key = self.query_hash(query, **place)
        hit = search.cache_probe(self.cache, key, as_of)
        schema = "path string, page_id long, idx int, text string, similarity double"
        if not hit.isEmpty():
            self._logged(key, True)
            return hit.select(F.explode(F.from_json("results", f"array<struct<{', '.join(x.strip().replace(' ', ':') for x in schema.split(','))}>>")).alias("r")).select("r.*")
        self._logged(key, False)
        chosen = search.by_location(self.files, **place).orderBy("path").limit(self.limits.max_files).select("path")
        found = search.fuzzy_search(self.detections.join(chosen, "path"), query, self.limits.similarity, self.limits.max_results).select("path", F.col("page_id").cast("long").alias("page_id"), F.col("idx").cast("int").alias("idx"), "text", "similarity")
        rows = found.collect()  # at most max_results
        body = self.spark.createDataFrame(rows, schema).select(F.to_json(F.collect_list(F.struct("*"))).alias("results"))
        expires = as_of + dt.timedelta(seconds=self.limits.cache_seconds)
        entry = body.select(F.lit(key).alias("query_hash"), "results", F.lit(0).cast("long").alias("hit_count"), F.lit(as_of).alias("created_at"), F.lit(expires).alias("expires_at"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.at}/cache-{self.generation}")
        return self.spark.createDataFrame(rows, schema)

    def _start_cache(self, rows: DataFrame) -> None:
        generation = uuid.uuid4().hex
        rows.write.parquet(f"{self.at}/cache-{generation}")
        self.generation = generation

    def sweep(self, as_of: dt.datetime) -> None:
        """Write the entries that live on as a table of their own, and read that from now on."""
        self._start_cache(tables.live(self.cache, as_of))

    def clear_cache(self) -> None:
        self._start_cache(self.spark.createDataFrame([], CACHE_DDL))

    def stats(self) -> dict[str, float]:
        log = self.spark.read.schema(LOG_DDL).parquet(f"{self.at}/log")
        searches, hits = log.agg(F.count("*"), F.count_if("hit")).first()
        return {"files": self.files.count(), "searches": searches, "cache_hits": hits, "cache_misses": searches - hits, "hit_rate": hits / searches if searches else 0.0}

    def health(self) -> dict[str, str]:
        return {"status": "healthy", "spark": self.spark.version}
