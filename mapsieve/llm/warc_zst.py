"""WARC archives with one Zstandard frame a record and an embedded dictionary.

Writing: rows fill archives of about ``archive_bytes``.  A dictionary is built from the records of
the archive itself (an even slice of each, TRAIN_BYTES in all), stands in a skippable frame at the
head of the archive, behind it a warcinfo record, and every record follows as a frame of its own,
so a reader can start at any record's offset.  Archives of fewer than LEAST_TRAINED records, or too
uniform to train on, have no dictionary.  Payloads of LEAST_REVISIT bytes or more that equal an
earlier one (smaller page_id) become revisit records, which hold headers alone.

Reading: the dictionary comes out of the leading frame; records are decompressed one by one.  The
length and digest of a response are those of the bytes read back; a revisit gets them from the
response that it refers to, found among the records read.

Which record a revisit refers to is a grouped minimum over digests.  It is joined to the pages by
broadcast where it is small, otherwise with hot digests dealt out over several tasks, so a payload
that a third of all pages share is gathered nowhere; nor is the response that its revisits refer to.

Defined results: a null html is an empty payload; a null page_id is written as an empty id, loses
against every other, and is read back as null (equal payloads of null ids alone are all responses);
of several rows of one page_id and payload one (that of the least url) is the response and the
others revisit it; a null url gives an empty target; extra columns are ignored; an empty table gives
no archives and no rows; a revisit whose response is not among the archives read is an error.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapsieve.llm import common as c

ARCHIVE_BYTES = 16 << 20
LEAST_REVISIT = 100
LEAST_TRAINED = 8
TRAIN_BYTES = 2 << 20
DICT_BYTES = 64 << 10
LEVEL = 3
#: Fixed values of the format: the skippable frame that holds the dictionary, and the magic of a Zstandard frame.
DICT_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
_DATE = "1970-01-01T00:00:00Z"

ARCHIVES_DDL = "archive string, n_records int, content binary"
_ARCHIVE = pa.schema([("archive", pa.string()), ("n_records", pa.int32()), ("content", pa.binary())])


def record(page_id, url: str, payload: bytes, digest: str, refers_to, place: str = "") -> bytes:
    """One WARC/1.1 record; a revisit has the digest of its payload and no block.  place: where the record stands, for its id."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place}:{page_id}')}>",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def information(name: str) -> bytes:
    """The warcinfo record at the head of an archive."""
    block = b"software: mapsieve\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {_DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not fit")
    return fields, rest[:n]


def archive(records: list[bytes]) -> bytes:
    """The records as an archive: dictionary frame (left out where none can be trained), then a frame each."""
    sample = records[:: max(1, min(-(-sum(map(len, records)) // TRAIN_BYTES), len(records) // LEAST_TRAINED))]
    sample = [r[: 2 * TRAIN_BYTES // len(sample)] for r in sample]
    head, trained = b"", None
    if len(sample) >= LEAST_TRAINED:
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, sample, k=256, d=8)
        except zstandard.ZstdError:
            trained = None  # too little or too uniform to train on; the format allows archives without one
    if trained is not None:
        body = trained.as_bytes()
        head = struct.pack("<II", DICT_FRAME, len(body)) + body
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    return head + b"".join(map(pack.compress, records))


def frames(content: bytes) -> Iterator[bytes]:
    """The decompressed records of an archive."""
    at, trained = 0, None
    if len(content) >= 8:
        magic, n = struct.unpack_from("<II", content)
        if magic == DICT_FRAME:
            body = bytes(content[8 : 8 + n])
            if body[:4] == struct.pack("<I", ZSTD_FRAME):
                body = zstandard.ZstdDecompressor().decompress(body)
            trained, at = zstandard.ZstdCompressionDict(body), 8 + n
    view = memoryview(content)
    unpack = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(content):
        one = unpack.decompressobj()
        size = zstandard.frame_content_size(view[at : at + 18])
        step, out = max(1024, min(size, 1 << 20) if size > 0 else 1 << 16), []
        while not one.eof:
            if at >= len(content):
                raise ValueError("the archive is cut short")
            out.append(one.decompress(view[at : at + step]))
            at += min(step, len(content) - at)
        at -= len(one.unused_data)
        yield b"".join(out)


def _write(archive_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        name = lambda: f"part-{part:06d}-{seq:06d}.warc.zst"

        def flush():
            nonlocal seq, held, size
            row = c.table(_ARCHIVE, archive=[name()], n_records=[len(held)], content=[archive([information(name()), *held])])
            seq, held, size = seq + 1, [], 0
            return row

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.append(record(page_id, url or "", html or b"", digest, refers_to, f"{name()}:{len(held)}"))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, n_records, content) of (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    by_page = rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("k"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "k"))
    repeated = by_page.groupBy("digest").agg(first.alias("first"), F.sum("k").alias("n")).filter("n > 1 and not first.unknown")
    repeated = c.stored(repeated.select("digest", "n", F.col("first.page_id").alias("first_id"), F.col("first.k").alias("n_first")))
    rows = c.hot_join(rows, repeated, ["digest"])
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    tied = F.col("first_id").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("n_first") > 1)
    out = rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), tied.alias("tied"))
    ties = not repeated.filter("n_first > 1").isEmpty()
    if ties:
        out = out.filter("not tied").unionByName(_one_response(out.filter("tied")))
    return out.drop("tied").mapInArrow(_write(archive_bytes), ARCHIVES_DDL)


def _one_response(tied: DataFrame) -> DataFrame:
    """Rows of one page_id and payload with one response among them; their payload is kept once."""
    groups = tied.groupBy("digest", "page_id", "url").agg(F.first("html").alias("html"), F.count("*").alias("k"))
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")))
    copies = groups.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    response = (F.col("place") == 1) & (F.col("copy") == 1)
    return copies.select("page_id", "url", F.when(response, F.col("html")).alias("html"), "digest", F.when(~response, F.col("page_id")).alias("refers_to"), F.lit(True).alias("tied"))


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
_RECORD_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _number(digits: str | None):
    return int(digits) if digits else None


def _read(with_payload: bool):
    def run(batches):
        for row in c.rows_of(batches):
            out: dict[str, list] = {f.name: [] for f in _RECORD}
            size = 0
            for raw in frames(row["content"].to_pybytes()):
                fields, payload = parse(raw)
                kind = fields["WARC-Type"]
                if kind not in ("response", "revisit"):
                    continue
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one written")
                values = (_number(fields["WARC-Page-ID"]), len(payload) if kind == "response" else None, digest, kind, _number(fields.get("WARC-Refers-To-Page")), fields["WARC-Target-URI"], payload if with_payload else None)
                for name, x in zip(out, values, strict=True):
                    out[name].append(x)
                size += len(payload)
                if with_payload and size >= c.CHUNK_BYTES:
                    yield c.table(_RECORD, **out)
                    out, size = {f.name: [] for f in _RECORD}, 0
            yield c.table(_RECORD, **out)

    return run


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (.., content): a row each; with_payload adds url and payload (empty for revisits).

    archives should be stored: they are read for the records and again for what revisits refer to.
    """
    light = c.stored(archives.select("content").mapInArrow(_read(False), _RECORD_DDL).drop("url", "payload"))
    asked = light.filter("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    there = light.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("payload_bytes").alias("full_bytes"))
    answers = c.stored(asked.join(there, ["refers_to", "payload_digest"]))
    records = archives.select("content").mapInArrow(_read(True), _RECORD_DDL) if with_payload else light
    out = c.hot_join(records, answers, ["refers_to", "payload_digest"])
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("refers_to").cast("string"), F.lit("?"))))
    size = F.coalesce("payload_bytes", "full_bytes", lost.cast("long"))
    return out.withColumn("payload_bytes", size).select(*records.columns)


def save(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file of its own through Spark's file system for ``folder``.

    The bytes go out from the driver one archive at a time (an archive is bounded by its size limit).
    """
    jvm, conf = archives.sparkSession._jvm, archives.sparkSession._jsc.hadoopConfiguration()
    for row in archives.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{row.archive}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(row.content))
        out.close()
