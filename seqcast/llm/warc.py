"""WARC archives: write pages as records, and read records back by verified chains of boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqcast.sources.shared import discard_table, written
from seqcast.sources.ship import ship_package

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
# What records of all versions read begin with, and what follows it in each.
SEPARATOR = "WARC/1."
VERSIONS = (b"0", b"1")
RECORD_END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A revisit keeps no payload; its length stands in a field of our own.
LENGTH_FIELD = "X-Payload-Length"

LEAST_BYTES = 1000

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
CANDIDATE = f"file string, split long, place long, size long, blank long, next long, {RECORD}"


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. Line ends within a value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: each page as a WARC record without its closing line ends.

    Of pages with equal payloads of at least ``least_bytes``, that with the largest id is a response and the
    others are revisits of it. Equal payloads are found by their SHA-256, with counts combined before the shuffle;
    only digests that repeat are joined back, and the planner sees their written table's size.
    Null html is an empty payload. A page without an id is always a response, as are rows that repeat the largest id.
    """
    base = (pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
            .withColumn("bytes", F.octet_length("html")).withColumn("key", F.sha2("html", 256)))
    again = written(base.filter(F.col("bytes") >= least_bytes).groupBy("key")
                    .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keeper is not null")
                    .select("key", "keeper"), "payloads")
    revisit = F.col("keeper").isNotNull() & (F.col("page_id") != F.col("keeper"))
    common = F.concat(
        _field("WARC-Record-ID", _id(F.col("page_id"))), _field("WARC-Target-URI", F.col("url")),
        F.lit(f"WARC-Date: {date}\r\n"), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("html"))),
        _field(LENGTH_FIELD, F.col("bytes").cast("string")))
    body = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(RECORD_END), F.col("html"))
    response = F.concat(F.lit(f"{MAGIC}WARC-Type: response\r\n"), common,
                        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
                        F.octet_length(body).cast("string"), F.lit(RECORD_END), body)
    pointer = F.concat(F.lit(f"{MAGIC}WARC-Type: revisit\r\n"), common, F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"),
                       _field("WARC-Refers-To", _id(F.col("keeper"))), F.lit(f"Content-Length: 0{RECORD_END}"))
    return base.join(again, "key", "left").select(F.when(F.coalesce(revisit, F.lit(False)), pointer).otherwise(response).alias("value"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write ``pages`` as uncompressed archive files, one per task. A record's closing line ends are the text sink's separator."""
    records(pages, least_bytes).write.option("lineSep", RECORD_END).text(path)


def _page(value: str | None) -> int | None:
    value = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


class BrokenArchive(ValueError):
    """A file whose chain of records ends before the file does."""


def _fields(lines: list[bytes]) -> dict[bytes, str] | None:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before. Nothing if these are no headers."""
    fields: dict[bytes, bytes] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last is not None:
            fields[last] += b" " + line.strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        last = name.strip().lower()
        fields[last] = value.strip()
    return {name: value.decode("utf-8", "replace") for name, value in fields.items()}


def parse_record(data: bytes) -> tuple[int, tuple] | None:
    """Length of the record that begins with the bytes after a separator, and its fields; nothing if these are no version and headers.

    The fields' payload is only looked at when ``data`` is the whole record.
    """
    head, end, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not end or version not in VERSIONS or (fields := _fields(lines)) is None:
        return None
    length = fields.get(b"content-length", "")
    if not (length.isascii() and length.isdigit()) or b"warc-type" not in fields:
        return None
    total = len(head) + 4 + int(length) + 4
    kind, named = fields[b"warc-type"], fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    stated = fields.get(LENGTH_FIELD.lower().encode(), "")
    if kind == "response" and total == len(data):
        payload = rest[: int(length)].partition(b"\r\n\r\n")[2]
        size, digest = len(payload), hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    else:
        size, digest = int(stated) if stated.isascii() and stated.isdigit() else None, named or None
    return total, (_page(fields.get(b"warc-record-id")), fields.get(b"warc-target-uri"), size, digest, kind,
                   _page(fields.get(b"warc-refers-to")), not named or digest == named)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """File, split, place behind the split's first row, and bytes of each chunk between separators, in the order of the files."""
    now, place = None, 0
    for batch in batches:
        for file, split, value in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(),
                                      batch.column("value"), strict=True):
            if now != (file, split):
                now, place = (file, split), 0
            data = value.as_py()
            yield file, split, place, data
            place += len(data) + len(SEPARATOR)


def _rows(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in text.split(", "))])


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk: where it begins and, if it reads as a record's start, where that record says the next one begins."""

    def rows() -> Iterator[tuple]:
        for file, split, place, data in _walk(batches):
            total, fields = parse_record(data) or (None, (None,) * 7)
            yield file, split, place, len(data), len(data) - len(data.rstrip()), None if total is None else place + total, *fields

    yield from _rows(rows(), _schema(CANDIDATE))


_CHUNK = "file string, split long, place long, data binary"


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(_walk(batches), _schema(_CHUNK))


def _assemble(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    data = SEPARATOR.encode().join(rows.sort_values("at")["data"])
    total = parse_record(data)
    # What follows the last record of a file in its last chunk is not part of it.
    parsed = parse_record(data[: total[0]]) if total else None
    return pd.DataFrame([parsed[1]] if parsed else [], columns=[f.split()[0] for f in RECORD.split(", ")]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def reachable(nodes: DataFrame) -> DataFrame:
    """``file, at`` of the nodes on the chain from each file's start, of ``nodes(file, at, next)``.

    Pointer jumping: after round k the pointers skip 2^k records and the nodes found so far are the first
    2^k of their chain, so the rounds are as many as the logarithm of the longest chain. Every round's pointers
    and finds are written tables of a few numbers per record.
    """
    known = nodes.select(F.col("file").alias("to_file"), F.col("at").alias("to"))
    jump = written(nodes.join(known, (F.col("file") == F.col("to_file")) & (F.col("next") == F.col("to")))
                   .select("file", "at", "next").filter("next > at"), "jumps")
    reach = written(nodes.filter("at = 0").select("file", "at"), "reached")
    while not jump.isEmpty():
        last = reach, jump
        reach = written(reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))).distinct(), "reached")
        onward = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = written(jump.join(onward, ["file", "next"]).select("file", "at", F.col("after").alias("next")), "jumps")
        discard_table(*last)
    return reach


def _broken(found: DataFrame, marked: DataFrame) -> int:
    """How many files go on, other than with white space, where their chain ends, or end before it."""
    files = found.groupBy("file").agg(F.max(F.col("at") + F.col("size") + len(SEPARATOR)).alias("length"), F.max_by("blank", "at").alias("blank"))
    chains = marked.filter("real").groupBy("file").agg(F.max("next").alias("reached"))
    left = F.col("length") - F.coalesce("reached", F.lit(0))
    return files.join(chains, "file", "left").filter((left < 0) | (left > F.col("blank"))).count()


def read_archive(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """A row per record on a file's chain: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact``.

    Files are read in splits with the beginning of a magic as separator, so a chunk is what follows one up to the
    next, wherever that stands; versions 1.0 and 1.1 are told apart by what follows. Lengths of the splits before give each chunk its offset in the file. A task
    parses each chunk as a record and emits the offset of its successor; ``reachable`` keeps
    those on the chain from offset 0, so a magic inside a payload, or a whole record there, is no record. Where a
    payload holds a magic, the record's chunks are brought together by a second read. Payloads are otherwise
    digested where they are read and never moved.

    ``payload_bytes`` and ``payload_digest`` (bare hex SHA-1) are those of the payload read; a
    revisit's are as stated in its header. ``intact`` tells whether a response's payload has the digest stated.
    A file that breaks off or does not begin with a record raises ``BrokenArchive``, which names how many files do; with
    ``lenient`` it gives the records up to there. White space after the last record is no break. Header lines may be folded. Files are uncompressed.
    Payloads of any length are read whole, each by one task. Rows are as many as records, repeated ones too. No files, no rows.
    """
    ship_package(spark.sparkContext)
    chunks = (spark.read.option("lineSep", SEPARATOR).text(path)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                      F.col("value").cast("binary").alias("value")))
    sizes = chunks.groupBy("file", "split").agg(F.sum(F.octet_length("value") + len(SEPARATOR)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # Offsets count from behind the chunk before a file's first magic, which is empty in an archive.
    bases = sizes.select("file", "split", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(SEPARATOR)).alias("base"))
    found = written(chunks.mapInArrow(_candidates, CANDIDATE).join(bases, ["file", "split"])
                    .withColumn("at", F.col("base") + F.col("place")).withColumn("next", F.col("base") + F.col("next") + len(SEPARATOR))
                    .drop("base"), "candidates")
    found = found.withColumn("whole", F.col("next") == F.col("at") + F.col("size") + len(SEPARATOR))
    nodes = found.filter("at >= 0 and next is not null").select("file", "at", "next")
    on_chain = reachable(nodes).withColumn("real", F.lit(True))
    marked = written(found.filter("at >= 0").join(on_chain, ["file", "at"], "left"), "marked")
    if not lenient and (broken := _broken(found, marked)):
        raise BrokenArchive(f"{broken} files of {path} hold more than a chain of whole records")
    names = [f.split()[0] for f in RECORD.split(", ")]
    single = marked.filter("real and whole").select(*names)
    up_to = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = written(marked.select("file", "split", "place", "at", F.max(F.when(F.col("real"), F.struct("at", "whole", "next"))).over(up_to).alias("owner"))
                    .filter("not owner.whole and at < owner.next").select("file", "split", "place", "at", F.col("owner.at").alias("owner")), "parts")
    if parts.isEmpty():
        return single
    several = (chunks.mapInArrow(_chunks, _CHUNK).join(parts, ["file", "split", "place"])
               .groupBy("file", "owner").applyInPandas(_assemble, RECORD))
    return single.union(several)
