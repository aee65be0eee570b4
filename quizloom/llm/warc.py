"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole records, with a seek
table in a skippable frame at the end (compressed and uncompressed size of every frame, the
layout of the public seekable format). ``write_bundles`` returns the record index: for every
record its bundle, frame, and offset and length inside the uncompressed frame. ``read_bundles``
reads everything; ``read_records`` opens only the frames that hold the wanted records.

Bundles carry a fresh name per task attempt, and only those named in the written index count. A
lost executor or a repeated task therefore leaves unused files behind, but never a wrong archive.

Defined results: a null payload is an empty one. Of rows with equal payloads of at least
``min_bytes`` bytes, those with the largest id are ``response`` and the others ``revisit`` that
id; rows repeated with the same id and payload have the same type. A null id never wins against
another id, is written without a number, and is read back as null; rows of a payload with null
ids only are all ``response``. A null URL is left out of the record; line breaks in a URL are
percent-encoded. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.tables import one_per_task

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")
HEADER = struct.Struct("<II")

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:record:"
INDEX_SCHEMA = "bundle string, id long, record_type string, frame int, offset long, length long"
RECORD_SCHEMA = (
    "id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(number: int | None) -> str:
    return f"<{ID_PREFIX}{'none' if number is None else number}>"


def _number(record_id: str) -> int | None:
    text = record_id.strip("<>").removeprefix(ID_PREFIX)
    return None if text == "none" else int(text)


def make_record(number, url, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the payload's length, and no body."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = head if is_revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(number)}", f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name: value.strip() for name, _, value in (line.partition(":") for line in lines)}


def parse_record(frame: memoryview, start: int) -> tuple[dict, int]:
    """The record at ``start`` and where the next one begins."""
    text = frame.obj
    head_end = text.index(b"\r\n\r\n", start)
    fields = _fields(text[start:head_end])
    first = head_end + 4
    last = first + int(fields["Content-Length"])
    body = text.index(b"\r\n\r\n", first) + 4
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else bytes(frame[body:last])
    http = _fields(text[first:body - 4])
    record = {
        "id": _number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": _number(fields["WARC-Refers-To"]) if revisit else None,
        "payload_bytes": int(http["Content-Length"]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if revisit else base32_sha1(payload),
        "payload": payload,
    }
    return record, last + 4


class BundleWriter:
    """Writes one bundle frame by frame; holds one frame in memory."""

    def __init__(self, folder: str, level: int):
        filesystem, path = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self._out = filesystem.open_output_stream(f"{path}/{self.name}", compression=None)
        self._compressor = zstandard.ZstdCompressor(level=level)
        self._sizes: list[tuple[int, int]] = []
        self._frame = bytearray()
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in the frame, and length of the record."""
        place = len(self._sizes), len(self._frame), len(record)
        self._frame += record
        return place

    def frame_bytes(self) -> int:
        return len(self._frame)

    def end_frame(self) -> None:
        if not self._frame:
            return
        packed = self._compressor.compress(bytes(self._frame))
        self._out.write(packed)
        self._sizes.append((len(packed), len(self._frame)))
        self.written += len(packed)
        self._frame = bytearray()

    def close(self) -> None:
        self.end_frame()
        table = b"".join(ENTRY.pack(*sizes) for sizes in self._sizes)
        table += FOOTER.pack(len(self._sizes), 0, SEEK_TABLE_MAGIC)
        self._out.write(HEADER.pack(SKIPPABLE_MAGIC, len(table)) + table)
        self._out.close()


class BundleReader:
    """Frames of a bundle by number, by way of the seek table."""

    def __init__(self, folder: str, name: str):
        filesystem, path = pafs.FileSystem.from_uri(folder)
        self._file = filesystem.open_input_file(f"{path}/{name}")
        size = self._file.size()
        frames, _, magic = FOOTER.unpack(self._file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEK_TABLE_MAGIC:
            raise ValueError(f"{name} has no seek table")
        table = self._file.read_at(
            frames * ENTRY.size, size - FOOTER.size - frames * ENTRY.size
        )
        self._places, at = [], 0
        for packed, plain in ENTRY.iter_unpack(table):
            self._places.append((at, packed, plain))
            at += packed
        self._decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self._places)

    def frame(self, number: int) -> memoryview:
        at, packed, plain = self._places[number]
        data = self._decompressor.decompress(self._file.read_at(packed, at), max_output_size=plain)
        return memoryview(data)

    def close(self) -> None:
        self._file.close()


def tag_revisits(df: DataFrame, id_col: str, digest: str, size: str, min_bytes: int) -> DataFrame:
    """Adds ``_keep``, the id of the response with an equal payload, if there is one.

    Only ids and digests are grouped and joined by digest, so a payload that a third of the rows
    share costs 60 bytes a row there; payloads move once, by id.
    """
    slim = df.select(id_col, digest, size).distinct()
    keep = slim.where(F.col(size) >= min_bytes).groupBy(digest).agg(F.max(id_col).alias("_keep"))
    tags = slim.join(keep, digest).select(
        F.col(id_col).alias("_id"), F.col(digest).alias("_of"), "_keep"
    )
    same = df[id_col].eqNullSafe(tags["_id"]) & (df[digest] == tags["_of"])
    return df.join(tags, same, "left").drop("_id", "_of")


def write_bundles(
    df: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, *, min_bytes: int = 0,
    frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per row below ``folder`` and returns the index (see ``INDEX_SCHEMA``).

    The files are written when the index is computed: write it as a table once, and read that.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
        payload.alias("payload"),
    ).withColumns({"_digest": F.sha1("payload"), "_size": F.octet_length("payload")})
    tagged = tag_revisits(rows, "id", "_digest", "_size", min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, index = None, []
        names = ["bundle", "id", "record_type", "frame", "offset", "length"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

        def taken() -> pa.RecordBatch:
            columns = list(zip(*index)) or [[]] * len(names)
            index.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )

        for batch in batches:
            for number, url, body, keep in zip(*(batch[c] for c in ("id", "url", "payload", "_keep"))):
                bundle = bundle or BundleWriter(folder, level)
                number, keep = number.as_py(), keep.as_py()
                revisit = keep is not None and keep != number
                record = make_record(number, url.as_py(), body.as_py(), keep, revisit, date)
                kind = "revisit" if revisit else "response"
                index.append((bundle.name, number, kind, *bundle.add(record)))
                if bundle.frame_bytes() >= frame_bytes:
                    bundle.end_frame()
                    yield taken()
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if bundle:
            bundle.close()
        yield taken()

    return tagged.select("id", "url", "payload", "_keep").mapInArrow(write, INDEX_SCHEMA)


def _as_batch(records: list[dict], with_payload: bool) -> pa.RecordBatch:
    schema = pa.schema([
        ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])
    if not with_payload:
        records = [r | {"payload": None} for r in records]
    return pa.RecordBatch.from_pylist(records, schema)


def read_bundles(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the indexed bundles, a frame at a time. Lengths and digests of responses
    are taken from what was read; revisits have those of their header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["bundle"].to_pylist():
                bundle = BundleReader(folder, name)
                for number in range(len(bundle)):
                    frame, at, records = bundle.frame(number), 0, []
                    while at < len(frame):
                        record, at = parse_record(frame, at)
                        records.append(record)
                    yield _as_batch(records, with_payload)
                bundle.close()

    bundles = one_per_task(index.select("bundle").distinct(), "bundle")
    return bundles.mapInArrow(read, RECORD_SCHEMA)


def read_records(wanted: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """The records of the wanted ids; only frames that hold one of them are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, bundle, number, frame = None, None, None, None
        for batch in batches:
            records = []
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    name, bundle, number = row["bundle"], BundleReader(folder, row["bundle"]), None
                if row["frame"] != number:
                    number, frame = row["frame"], bundle.frame(row["frame"])
                records.append(parse_record(frame, row["offset"])[0])
            yield _as_batch(records, True)

    places = wanted.select("id").distinct().join(index, "id")
    placed = places.select("bundle", "frame", "offset").repartition("bundle", "frame")
    return placed.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(read, RECORD_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives each revisit the length and digest of the response that was read for it; a revisit
    whose response is missing or differs from its header gets nulls."""
    responses = (
        records.where("record_type = 'response'")
        .groupBy(F.col("id").alias("_id"), F.col("payload_digest").alias("_digest"))
        .agg(F.max("payload_bytes").alias("_bytes"))
    )
    # Sizes are guessed from the few bundle names, so a broadcast would be chosen at any size.
    responses = responses.hint("merge")
    revisit = F.col("record_type") == "revisit"
    found = records.where(revisit).join(
        responses,
        (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left",
    )
    resolved = found.withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest")})
    return records.where(~revisit).unionByName(resolved.drop("_id", "_digest", "_bytes"))


def archive(
    spark: SparkSession, df: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str,
    **options,
) -> DataFrame:
    """Writes the bundles and their index (``folder``/index) and returns the stored index."""
    write_bundles(df, f"{folder}/bundles", id_col, url_col, payload_col, **options).write.parquet(
        f"{folder}/index"
    )
    return spark.read.parquet(f"{folder}/index")
