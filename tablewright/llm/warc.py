"""Content-addressed WARC archive.

Layout. `payloads`: each payload once, as a zstd frame, under its SHA-256. `headers`: one row for each record
with its exact header bytes and the digest of its payload. A record is its header bytes, the payload (response
records only) and the closing blank lines; a join on the digest gives it back byte for byte. Readers hash every
payload again and fail on one that is not what its digest says. The query's rows come from such reconstructed
records: their parsed headers, and size and SHA-1 of the block that they hold; a revisit takes those of the record
that its digest names.

Rule. Of records with equal payloads of at least `min_revisit` bytes, that with the largest page_id is a response
and the others revisit it; shorter ones are responses, though their payload too is stored once.

Scale. Payload bytes cross the network once, dealt by (digest, page_id), so a payload that a third of all pages
repeat is moved once. Digests, lengths and headers travel as narrow rows; their hot keys meet stored tables, so
adaptive execution can split them.

Headers of revisits meet no payload bytes, so a payload that is revisited very often is read once.

Cases. A long payload is held as one value. Null html is an empty payload. Null url: the header has no target. Null page_id sorts below all others; if
all page_ids of a payload are null, each record is a response. Rows that repeat the largest page_id are all
responses; record ids repeat with the page_id. Line breaks in a url are percent-encoded. An empty table gives an empty archive. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import materialize

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Says that a revisit's payload is that of the record it refers to.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_REVISIT = b"\r\nWARC-Type: revisit\r\n"


def _binary(col: Column) -> Column:
    return F.coalesce(col.cast("binary"), F.lit("").cast("binary"))


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frames = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        payloads = batch.column("payload").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([hashlib.sha256(x).digest() for x in payloads], pa.binary()),
                batch.column("page_id"),
                pa.array([frames.compress(x) for x in payloads], pa.binary()),
            ],
            ["digest", "page_id", "frame"],
        )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archive(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """The stored tables: headers (page_id, digest, header) and payloads (digest, frame)."""
    payload = _binary(F.col("html"))
    page_id = F.col("page_id").cast("long").alias("page_id")
    narrow = pages.select(
        page_id, F.col("url").cast("string").alias("url"), F.unhex(F.sha2(payload, 256)).alias("digest"),
        F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    keepers = materialize(narrow.groupBy("digest").agg(F.max("page_id").alias("keep")), "warc-keepers")
    revisit = (F.col("bytes") >= min_revisit) & (F.col("keep").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("keep"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("keep")))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    headers = narrow.join(keepers, "digest").select("page_id", "digest", header.cast("binary").alias("header"))
    packed = pages.select(page_id, payload.alias("payload")).mapInArrow(_pack_batches, "digest BINARY, page_id BIGINT, frame BINARY")
    # plain keys for join and dedup alike, so that payload bytes are shuffled once
    page = lambda col: F.coalesce(F.col(col), F.lit(-(1 << 63))).alias("_page")
    kept = keepers.select("digest", page("keep")).hint("merge")
    payloads = packed.select("digest", page("page_id"), "frame").join(kept, ["digest", "_page"], "left_semi")
    payloads = payloads.groupBy("digest", "_page").agg(F.first("frame").alias("frame")).select("digest", "frame")
    return materialize(headers, "warc-headers"), materialize(payloads, "warc-payloads")


def open_frame(digest: bytes, frame: bytes) -> bytes:
    payload = zstandard.ZstdDecompressor().decompress(frame)
    if hashlib.sha256(payload).digest() != digest:
        raise ValueError(f"stored payload does not match its digest {digest.hex()}")
    return payload


def _record(header: bytes, digest: bytes, frame: bytes | None) -> bytes:
    """The exact bytes of a record; a response without its payload fails."""
    if _REVISIT in header:
        return header + b"\r\n\r\n"
    if frame is None:
        raise ValueError(f"no verified payload for record with digest {digest.hex()}")
    return header + open_frame(digest, frame) + b"\r\n\r\n"


def _joined(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Headers with the frames of their payloads; revisits, which hold none, meet none."""
    wanted = F.when(F.instr("header", F.lit(_REVISIT)) == 0, F.col("digest"))
    frames = payloads.select(F.col("digest").alias("at"), "frame")
    return headers.withColumn("wanted", wanted).join(frames.hint("merge"), F.col("wanted") == F.col("at"), "left").select("page_id", "digest", "header", "frame")


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_record(*row) for row in zip(*(batch.column(x).to_pylist() for x in ("header", "digest", "frame")))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], ["page_id", "record"])


def reconstruct_records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, record): the exact bytes of every WARC record, header and payload joined by digest."""
    return _joined(headers, payloads).mapInArrow(_record_batches, "page_id BIGINT, record BINARY")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"\r\n([^:\r\n]+): ([^\r\n]*)", head.decode()))
    return fields, rest[: int(fields["Content-Length"])]


_INDEX = "page_id BIGINT, digest BINARY, record_type STRING, refers_to BIGINT, said STRING, payload_bytes BIGINT, payload_digest STRING"


def _page_of(urn: str) -> int | None:
    found = re.fullmatch("<urn:page:(-?[0-9]+)>", urn)
    return int(found[1]) if found else None


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each reconstructed record says and holds; records are made and parsed one at a time."""
    for batch in batches:
        rows = []
        for header, digest, frame in zip(*(batch.column(x) for x in ("header", "digest", "frame"))):
            digest = digest.as_py()
            fields, block = parse_record(_record(header.as_py(), digest, frame.as_py()))
            said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            held = (None, None)
            if fields["WARC-Type"] != "revisit":
                held = (len(block), hashlib.sha1(block).hexdigest())
                if held[1] != said:
                    raise ValueError(f"no verified payload for record {said}: its block has {held[1]}")
            rows.append((_page_of(fields["WARC-Record-ID"]), digest, fields["WARC-Type"], _page_of(fields.get("WARC-Refers-To", "")), said, *held))
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        names = [x.split()[0] for x in _INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_index(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row for each record, from the reconstructed records: what its header says, and size and SHA-1 of its payload."""
    read = materialize(_joined(headers, payloads).mapInArrow(_index_batches, _INDEX), "warc-read")
    held = read.where("payload_digest IS NOT NULL").groupBy("digest").agg(F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("sha1"))
    rows = read.join(materialize(held, "warc-held"), "digest", "left")
    wrong = F.col("sha1").isNull() | (F.col("sha1") != F.col("said"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("no verified payload for record "), F.col("said")))).otherwise(F.col("sha1"))
    return rows.select("page_id", F.col("bytes").alias("payload_bytes"), checked.cast("string").alias("payload_digest"), "record_type", "refers_to")


def archive_pages(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the archive of `pages`, read it back, one row for each page."""
    return read_index(*write_archive(pages, min_revisit))
