"""Texts stored as lossless WebP images, and features computed from what is read back.

A payload is the text's UTF-8 bytes and blanks up to a positive multiple of a row
of pixels.  It is stored as images of ``WIDTH`` pixels a row and at most ``ROWS``
rows, three samples a pixel; the stored form of a longer payload is its images' files
one after another.

Defined results: a null or empty text is one row of blanks; equal texts, and so
repeated rows, give equal bytes, whatever batch they are in; a very long text is stored
whole, as many images; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import textkernels as K
from .webp import decode_images, encode_images, image_chunk

WIDTH, ROWS = 64, 64
ROW_BYTES = 3 * WIDTH
CHUNK = 1 << 19  # bytes of text stored in one go
STORED = 1 << 22  # bytes of stored forms decoded in one go


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text in its stored form."""
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_bytes", LongType()), StructField("media", BinaryType())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.utf8_column(batch.column(1))
            for lo, hi in K.chunks(offs, CHUNK):
                size = np.diff(offs[lo : hi + 1])
                rows = np.maximum(1, -(-size // ROW_BYTES))
                first = np.cumsum(rows) - rows
                samples = np.full(int(rows.sum()) * ROW_BYTES, 32, np.uint8)
                start = np.repeat(first * ROW_BYTES - (offs[lo:hi] - offs[lo]), size)
                samples[start + np.arange(int(size.sum()))] = buf[offs[lo] : offs[hi]]
                images = -(-rows // ROWS)
                image_rows = np.full(int(images.sum()), ROWS)
                last = np.cumsum(images) - 1
                image_rows[last] = rows - (images - 1) * ROWS
                files = encode_images(samples, image_rows * ROW_BYTES, WIDTH)
                media = [b"".join(files[b - k + 1 : b + 1]) for b, k in zip(last.tolist(), images.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(media, pa.binary())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(store, schema)


def media_files(media: bytes) -> list[bytes]:
    """The single images' files of a stored form."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(media[at : at + size])
        at += size
    return out


def pixel_arrays(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, pixels): red, green and blue samples of the decoded images, row by row."""
    schema = StructType(media.schema.fields + [StructField("pixels", BinaryType())])
    return media.mapInArrow(lambda batches: (b for b, _ in _decoded(batches, schema.names)), schema)


def _decoded(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        _, offs = K.utf8_column(batch.column(2))
        for lo, hi in K.chunks(offs, STORED):
            files = [media_files(m) for m in batch.column(2).slice(lo, hi - lo).to_pylist()]
            images = decode_images([image_chunk(f) for one in files for f in one])
            samples = [np.ascontiguousarray(i[..., 1:]).tobytes() for i in images]
            ends = np.cumsum([len(one) for one in files])
            payloads = [b"".join(samples[b - len(one) : b]) for b, one in zip(ends.tolist(), files)]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary())], names), payloads


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of every stored text, from the decoded pixels."""
    schema = StructType(
        [media.schema["doc_id"], StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType())]
        + [StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType())]
    )

    def features(payload: bytes) -> str:
        """Rows, mean sample per channel and mean step between neighbouring pixels, in thousandths."""
        a = np.frombuffer(payload, np.uint8).reshape(-1, 3)
        mean = a.sum(axis=0, dtype=np.int64) * 1000 // len(a)
        step = int(np.abs(a[1:].astype(np.int16) - a[:-1]).sum(dtype=np.int64)) * 1000 // (3 * (len(a) - 1))
        return f"rows={len(a) // WIDTH} red={mean[0]} green={mean[1]} blue={mean[2]} step={step}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, payloads in _decoded(batches, ["doc_id", "n_bytes", "media", "pixels"]):
            stored = part.column(2).to_pylist()
            columns = [
                part.column(0),
                part.column(1),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                pa.array([len(m) for m in stored], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                pa.array([features(p) for p in payloads]),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
