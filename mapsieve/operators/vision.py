"""The boundary to recognition engines: image pages in, detections out.

Engines are plug-ins.  None is part of this library; a missing one is simply not registered.
"""

from __future__ import annotations

import importlib.util
import threading
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTION_DDL = "text string, x1 int, y1 int, x2 int, y2 int, confidence double, engine string"


class Engine(ABC):
    name = "engine"

    @abstractmethod
    def detect(self, image: bytes, width: int, height: int) -> list[tuple[str, int, int, int, int, float]]:
        """(text, x1, y1, x2, y2, confidence) of what is seen."""

    def info(self) -> dict[str, str]:
        return {"name": self.name}


class GridEngine(Engine):
    """Reads nothing: names the cells of a grid.  For tests, and as a pattern for real engines."""

    name = "grid"

    def detect(self, image, width, height):
        return [(f"{r * 2 + c + 1}", c * (width // 2), r * (height // 2), (c + 1) * (width // 2), (r + 1) * (height // 2), 0.9) for r in (0, 1) for c in (0, 1)]


#: Fixed value: how long an engine may look at one page, in seconds.
TIMEOUT = 30.0


class Registry:
    """Engines by name, each with the weight of its confidences and the time that it has for a page."""

    def __init__(self):
        self.engines: dict[str, tuple[Engine, float, float]] = {}

    def add(self, engine: Engine, weight: float = 1.0, timeout: float = TIMEOUT) -> None:
        self.engines[engine.name] = (engine, weight, timeout)

    def add_if_available(self, modules: tuple[str, ...], build: Callable[[], Engine], weight: float = 1.0, timeout: float = TIMEOUT) -> bool:
        """Register what build makes if all modules that it needs can be found; whether that was so."""
        found = all(importlib.util.find_spec(m) is not None for m in modules)
        if found:
            self.add(build(), weight, timeout)
        return found

    def available(self) -> list[str]:
        return sorted(self.engines)

    def info(self) -> list[dict[str, object]]:
        return [self.engines[n][0].info() | {"weight": self.engines[n][1], "timeout": self.engines[n][2]} for n in self.available()]

    def detect(self, pages: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Detections of pages (page_id, image, width, height) by the named engines, all of them by default.

        Confidences count by the engine's weight, 1 at most.  An engine that takes longer than its time
        for a page, or fails on it, has found nothing there.
        """
        engines = [self.engines[n] for n in names or self.available()]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(p, *d[:5], min(1.0, d[5] * weight), e.name) for p, image, w, h in batch.itertuples(index=False) for e, weight, timeout in engines for d in _in_time(e, image, w, h, timeout)]
                yield pd.DataFrame(rows, columns=["page_id", "text", "x1", "y1", "x2", "y2", "confidence", "engine"])

        return pages.select("page_id", "image", "width", "height").mapInPandas(run, "page_id long, " + DETECTION_DDL)


def _in_time(engine: Engine, image: bytes, width: int, height: int, timeout: float) -> list[tuple]:
    """What an engine finds, or nothing where it fails or its time runs out (its thread is left to end by itself)."""
    found: list[list[tuple]] = [[]]

    def work():
        try:
            found[0] = engine.detect(image, width, height)
        except Exception:  # noqa: BLE001  a page that an engine cannot read is a page without detections
            found[0] = []

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(timeout)
    return [] if thread.is_alive() else found[0]


def adapted_thresholds(images: DataFrame, confidence: float = 0.5, overlap: float = 0.3, most: int = 1000) -> DataFrame:
    """Images (mean_brightness, contrast, width, height) with the thresholds that suit each: dark ones ask a tenth less confidence,
    bright ones a tenth more, flat ones allow a tenth less overlap, and large ones half as many detections again."""
    light = F.when(F.col("mean_brightness") < 100, 0.9).when(F.col("mean_brightness") > 200, 1.1).otherwise(1.0)
    large = F.col("width").cast("long") * F.col("height") > 2_000_000
    return images.withColumns({
        "confidence_threshold": F.lit(confidence) * light,
        "overlap_threshold": F.lit(overlap) * F.when(F.col("contrast") < 100, 0.9).otherwise(1.0),
        "max_detections": F.when(large, int(most * 1.5)).otherwise(most),
    })


def first_engine(df: DataFrame, order: list[str], page: str = "page_id") -> DataFrame:
    """Of every page the rows of the first engine in ``order`` that has any."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("engine"))
    best = df.filter(place > 0).groupBy(page).agg(F.min(place).alias("best"))
    return df.join(best, page).filter(place == F.col("best")).drop("best")


def with_fallback(first: DataFrame, second: DataFrame, least: int, page: str = "page_id") -> DataFrame:
    """First's rows, and second's for the pages where first has fewer than ``least``."""
    enough = first.groupBy(page).count().filter(F.col("count") >= least).select(page)
    return first.unionByName(second.join(enough, page, "left_anti"))
