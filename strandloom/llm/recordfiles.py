"""Length-delimited binary records of token ids, with a separate offset index.

A record is: length of the payload (8 bytes), masked checksum of those 8 bytes
(4), payload, masked checksum of the payload (4), all little-endian.  The
checksum is CRC-32, masked by a rotation by 15 bits and an added constant, so
that files of files are safe.  The payload is the ids as unsigned 16-bit numbers
where the tokenizer's ids fit, else 32-bit.  Beside each file lies an index with one
fixed-size entry a record, so that a reader can fetch records in any order.

Documents are range-partitioned and sorted by doc_id, and by a hash of the text, so
that texts are no range bounds; each task writes one file
and its index under a temporary name and moves them into place, so a task that
runs again replaces its files.  Only one row a file reaches the driver.

Defined results: a null or empty text gives a record with the end id alone; rows
with equal doc_id are ordered by the text's hash, then by text; a null doc_id comes
first; other columns are ignored; an empty table writes no files and gives no rows; a
very long text is one record, held whole by one task.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .storage import shared_dir
from .wordpieces import encode_column

# Fixed value: the constant of the checksum mask.
MASK_DELTA = 0xA282EAD8

INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n_tokens", "<u4")])
_HEAD = struct.Struct("<Q")
_SUM = struct.Struct("<I")


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return _SUM.pack((((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, masked(head), payload, masked(payload)))


def read_frame(source) -> bytes:
    """The next payload of an open file; raises on any damage."""
    head = source.read(12)
    if len(head) != 12 or masked(head[:8]) != head[8:]:
        raise ValueError("damaged record length")
    (n,) = _HEAD.unpack(head[:8])
    body = source.read(n + 4)
    if len(body) != n + 4 or masked(body[:n]) != body[n:]:
        raise ValueError("damaged record")
    return body[:n]


@dataclass(frozen=True)
class RecordSet:
    """A written set: its files in doc_id order with the ids before each."""

    files: list[tuple[str, int, int]]  # path, records, ids before
    width: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def id_width(tokenizer: str, end_id: int = 0) -> int:
    """Bytes that hold every id of a tokenizer file."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(most, end_id) < 1 << 16 else 4


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> RecordSet:
    """Encode the texts of (doc_id, text) and write them in ascending doc_id order."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-records")
    width = id_width(tokenizer, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}"
        files, base = _open(path)
        files.create_dir(base, recursive=True)
        temporary = f"{base}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        index, out, at, n_ids = [], None, 0, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, tokens in encode_column(batch.column(1), tokenizer):
                out = out or files.open_output_stream(temporary)
                record = frame(np.append(tokens, np.uint32(end_id)).astype(f"<u{width}").tobytes())
                out.write(record)
                index.append((ids[row] or 0, ids[row] is not None, at, len(tokens) + 1))
                at, n_ids = at + len(record), n_ids + len(tokens) + 1
        if out is not None:
            out.close()
            with files.open_output_stream(temporary + ".idx") as f:
                f.write(np.array(index, INDEX).tobytes())
            target = f"{base}/{os.path.basename(name)}"
            files.move(temporary + ".idx", target + ".idx")
            files.move(temporary, target + ".rec")
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [name], "n": [len(index)], "n_ids": [n_ids]})

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
    ordered = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    rows = ordered.mapInArrow(write, "part long, path string, n long, n_ids long").collect()
    found, before = [], 0
    for r in sorted(rows):
        found.append((r["path"], r["n"], before))
        before += r["n_ids"]
    return RecordSet(found, width)


def read_indexed(path: str, order: np.ndarray | None = None, width: int = 2) -> Iterator[tuple[np.void, np.ndarray]]:
    """Index entries and ids of one file, in file order or in the given order of records."""
    files, at = _open(path)
    with files.open_input_stream(at + ".idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    with files.open_input_file(at + ".rec") if order is not None else files.open_input_stream(at + ".rec", buffer_size=1 << 20) as f:
        for i in range(len(index)) if order is None else order:
            if order is not None:
                f.seek(int(index[i]["offset"]))
            yield index[i], np.frombuffer(read_frame(f), f"<u{width}").astype("<u4")


def read_records(docs: DataFrame, records: RecordSet) -> DataFrame:
    """doc_id, start, n_tokens and checksum of every record, from the files alone."""
    spark = docs.sparkSession
    listed = spark.sparkContext.broadcast(records)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, width = listed.value.files, listed.value.width
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, _, start = files[k]
                rows = []
                for entry, ids in read_indexed(path, width=width):
                    doc = int(entry["doc_id"]) if entry["has_id"] else None
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = len(records.files)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_records(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    return read_records(docs, write_records(docs, tokenizer, end_id))
