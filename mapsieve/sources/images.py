"""Image files as rows: their bytes, and the sizes that their headers state."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of files that uploads may have.
UPLOADS = ("png", "jpg", "jpeg", "gif", "bmp", "pdf")


def size_of(data: bytes) -> tuple[str | None, int | None, int | None]:
    """(kind, width, height) from the header of a PNG, GIF, BMP or JPEG; nulls for other or broken files."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return "bmp", w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data) and data[at] == 0xFF:
                # frame headers but for tables of codes, arithmetic conditioning and reserved ones
                if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None, None, None


def read(spark: SparkSession, folder: str, kinds: tuple[str, ...] = UPLOADS) -> DataFrame:
    """Files (path, length, content) of the given endings under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")
    return rows.filter(F.lower(F.element_at(F.split("path", "[.]"), -1)).isin(*kinds))


def sized(images: DataFrame) -> DataFrame:
    """(path, kind, width, height) of images (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [size_of(bytes(x)) for x in batch["content"]]
            out = pd.DataFrame(found, columns=["kind", "width", "height"]).astype({"width": "Int32", "height": "Int32"})
            yield out.assign(path=batch["path"].to_numpy())[["path", "kind", "width", "height"]]

    return images.select("path", "content").mapInPandas(run, "path string, kind string, width int, height int")
