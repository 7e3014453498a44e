"""WARC archives in seekable Zstandard bundles, written and read back by Spark tasks."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import open_store, partitions, settle, small_batches, write_file
from rollbook.sources.workspace import new_path

# Fixed values of the seekable format: skippable frame, footer of the seek table, descriptor.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
FRAME = 1 << 18  # payload bytes after which a frame ends; a larger record has a frame of its own


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, from its hex digits."""
    hexed = F.sha1(payload)
    # 160 bits are 32 digits of 5 bits; 10 hex digits (40 bits) at a time fit a long
    parts = [F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(4)]
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[
        F.substring(letters, (F.shiftright(part, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
        for part in parts
        for j in range(8)
    ])


def _clean(value: str) -> str:
    """A header value in one line of ASCII: other bytes are percent-encoded."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in value.encode())


def record(row: dict, payload: bytes) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:row:{row['uid']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row["key"] is not None:
        head.append(f"X-Page-ID: {row['key']}")
    if row["uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['uri'])}")
    if row["record_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:row:{row['refers_uid']}>")
        if row["refers_to"] is not None:
            head.append(f"X-Refers-To-Page-ID: {row['refers_to']}")
        body = b""
    else:
        head.append("Content-Type: text/html; charset=utf-8")
        body = payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers and block of the record that ``data`` starts with."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    return fields, rest[:n]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at the end of a bundle: compressed and plain size of every frame."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(store, path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, read from the end of a bundle."""
    size = store.get_file_info(path).size
    with store.open_input_file(path) as f:
        n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        table = f.read_at(8 * n, size - 9 - 8 * n)
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", table, 8 * i)
        out.append((at, c, d))
        at += c
    return out


def _bundles(batches, folder, frame_bytes):
    """Write one bundle a task, none without rows; yield where each record lies."""
    import itertools

    import pandas as pd
    import zstandard

    batches = (b for b in batches if len(b))
    head = next(batches, None)
    if head is None:
        return
    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
    index, sizes = [], []
    packer = zstandard.ZstdCompressor(level=3)

    def frame(held):
        plain = b"".join(held)
        packed = packer.compress(plain)
        sizes.append((len(packed), len(plain)))
        return packed

    def chunks():
        held, n = [], 0
        for batch in itertools.chain([head], batches):
            for row in batch.to_dict("records"):
                row = {c: v if c == "payload" or not pd.isna(v) else None for c, v in row.items()}
                data = record(row, bytes(row["payload"]))
                if held and n + len(data) > frame_bytes:
                    yield frame(held)
                    held, n = [], 0
                index.append((row["uid"], path, len(sizes), n, len(data)))
                held.append(data)
                n += len(data)
        yield frame(held)
        yield seek_table(sizes)

    write_file(path, chunks())
    for at in range(0, len(index), 10000):
        yield pd.DataFrame(index[at : at + 10000], columns=["uid", "path", "frame", "offset", "length"])


def _records(batches):
    """Read records back: seek table, frame, relative offset."""
    import base64
    import hashlib

    import pandas as pd
    import zstandard

    tables, unpack = {}, zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for path, rows in batch.groupby("path", sort=False):
            store, local = open_store(path)
            if path not in tables:
                tables = {path: read_seek_table(store, local)}
            with store.open_input_file(local) as f:
                for frame, some in rows.groupby("frame", sort=False):
                    at, packed, plain = tables[path][frame]
                    data = unpack.decompress(f.read_at(packed, at), max_output_size=plain)
                    for uid, offset, length in zip(some["uid"], some["offset"], some["length"]):
                        fields, body = parse(data[offset : offset + length])
                        if fields["WARC-Record-ID"] != f"<urn:row:{uid}>":
                            raise ValueError("the index and the archive disagree")
                        named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != named:
                            raise ValueError("a payload does not have its digest")
                        refers = fields.get("X-Refers-To-Page-ID")
                        key = fields.get("X-Page-ID")
                        out.append((
                            None if key is None else int(key), fields.get("WARC-Target-URI"), kind, named,
                            int(fields["X-Payload-Length"]), None if refers is None else int(refers),
                            body if kind == "response" else None,
                        ))
        names = ["key", "uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({"key": "Int64", "refers_to": "Int64"})


def write_archives(
    df: DataFrame, key: str, uri: str, payload: str, least: int = 0, frame_bytes: int = FRAME
) -> tuple[DataFrame, str]:
    """Write one record a row into bundles of a new folder; return the index of records and the folder.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest key (nulls last; of
    repeated rows one) is a response, the others are revisits of it. Smaller payloads are all responses.
    Null payloads count as empty. Header values lose no byte: white space and other control characters are
    percent-encoded. The index maps a record to its bundle, frame and offset in the frame.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(
        F.col(key).cast("long").alias("key"),
        F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = settle(rows.withColumn("payload_digest", digest(F.col("payload"))), "pages")
    large = rows.where(F.octet_length("payload") >= least)
    first = F.min(F.struct(F.col("key").isNull(), "key", "uid")).alias("first")
    first = large.groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    first = settle(first.select(F.col("payload_digest").alias("same"), "first.key", "first.uid"), "responses")
    narrow = rows.select("uid", "payload_digest", (F.octet_length("payload") >= least).alias("large"))
    narrow = narrow.where("large").join(
        first.select("same", F.col("key").alias("refers_to"), F.col("uid").alias("refers_uid")),
        F.col("payload_digest") == F.col("same"),
    )
    again = settle(
        narrow.where("uid <> refers_uid").select(F.col("uid").alias("again"), "refers_to", "refers_uid"), "revisits"
    )
    kind = F.when(F.col("again").isNull(), "response").otherwise("revisit").alias("record_type")
    full = rows.join(again, F.col("uid") == F.col("again"), "left").select(
        "uid",
        *[F.col(c).cast("string").alias(c) for c in ("key", "refers_to", "refers_uid")],  # pandas would make floats
        "uri",
        "payload",
        "payload_digest",
        kind,
    )
    folder = new_path(spark, "llm-warc")
    index = full.mapInPandas(
        lambda b: _bundles(b, folder, frame_bytes), "uid long, path string, frame int, offset long, length long"
    )
    return settle(index, "warc-index"), folder


def read_archives(index: DataFrame) -> DataFrame:
    """The records an index names: key, uri, record_type, payload_digest, payload_bytes, refers_to, payload.

    A revisit's payload is null. Every response's payload is held against its digest.
    """
    dealt = index.repartition(partitions(index.sparkSession), "path", F.floor(F.col("frame") / 64)).sortWithinPartitions("path", "frame", "offset")
    return dealt.mapInPandas(
        _records,
        "key long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
        "payload binary",
    )
