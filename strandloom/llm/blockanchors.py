"""Repeated runs of words, found by fixed blocks and cut out of all but the first document.

A word goes if a window of ``window`` words over it also starts in a document of smaller
doc_id.  Every such window of the earlier document holds one of its non-overlapping blocks
of ``(window + 1) // 2`` words whole, so:

1. all blocks are indexed and all rolling windows of a block's length probe them, by ranges
   of their hashes; what is met anywhere else is a candidate;
2. candidates are extended to whole windows on both sides, and the windows' hashes are met
   with the smallest doc_id that holds them;
3. windows that go are joined to maximal runs, and the words in them are cut out.

What is exchanged is packed by tasks: hashes, positions and documents of one range of
hashes in one binary value, and of equal hashes in a task only one, since those settle each
other where they are.  So a passage in a third of all documents is one entry a task.  The
first step drops all but 32 bits of a hash besides its range's; a wrong candidate costs a
second look and no more.  The second compares 64 bits.

Defined results: a null or empty text has no words and nothing removed; a null doc_id comes
after all others, and rows of one doc_id (null too) do not remove each other's words, so
repeated rows give equal rows; windows that overlap are one run; a very long text is read
whole, in chunks of documents; other columns are kept whatever their names (those of
``REPORT`` come last); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import textkernels as K
from .storage import fresh_names, written

REPORT = ("n_words", "n_removed", "kept_sha256", "kept")
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id


@dataclass(frozen=True)
class AnchorConfig:
    """``task_words`` are packed together in a task; ``range_words`` meet in one, ``slice_words`` of them at a time."""

    window: int = 13
    task_words: int = 4 << 20
    range_words: int = 32 << 20
    slice_words: int = 2 << 20
    least_ranges: int = 32

    @property
    def block(self) -> int:
        return (self.window + 1) // 2

    def range_bits(self, n_words: int) -> int:
        ranges = max(self.least_ranges, -(-n_words // self.range_words))
        return max(1, (ranges - 1).bit_length())


# ---- packed entries of one range


def _planes(x: np.ndarray) -> bytes:
    """Numbers of four bytes, all lowest bytes first, which Spark's compression likes better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


def pack(hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, keys: np.ndarray, ids: np.ndarray | None) -> bytes:
    """Hashes (of four or eight bytes) at positions of documents; ``doc`` ascends and indexes ``keys`` and ``ids``."""
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    own = doc[new]
    head = np.array([len(own), len(doc), hashes.dtype.itemsize if len(hashes) else 0, ids is not None], "<u4")
    parts = [head.tobytes(), keys[own].tobytes(), ids[own].tobytes() if ids is not None else b"", _planes(np.diff(np.append(new, len(doc))))]
    return b"".join([*parts, hashes.tobytes(), _planes(at)])


def unpack(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, document of each, keys, ids) of packed entries."""
    raw = np.frombuffer(blob, np.uint8)
    docs, n, size, has_ids = (int(x) for x in raw[:16].view("<u4"))
    at = 16

    def take(length: int) -> np.ndarray:
        nonlocal at
        at += length
        return raw[at - length : at]

    keys = take(8 * docs).view("<u8")
    ids = take(8 * docs).view("<i8") if has_ids else np.zeros(0, np.int64)
    counts = _from_planes(take(4 * docs), docs)
    hashes = take(size * n).view(f"<u{size}") if size else np.zeros(0, np.uint64)
    return hashes, _from_planes(take(4 * n), n), np.repeat(np.arange(docs), counts), keys, ids


_PACKED = StructType([StructField("range", LongType()), StructField("settled", LongType()), StructField("packed", BinaryType())])
_FOUND = StructType([StructField("key", LongType()), StructField("at", BinaryType())])


def _by_range(ranges: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The entries of each range, in their order."""
    order = np.argsort(ranges.astype(np.uint16) if len(ranges) and ranges.max() < 1 << 16 else ranges, kind="stable")
    edges = np.flatnonzero(np.diff(ranges[order], prepend=-1))
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
        yield int(ranges[order[lo]]), order[lo:hi]


def _packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, (pa.field("", pa.int64()), pa.field("", pa.int64()), pa.field("", pa.binary())))], _PACKED.names)


def _batches(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about 8 MB."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[2])
        if size > 8 << 20:
            yield _packed_rows(some)
            some, size = [], 0
    yield _packed_rows(some)


def _found_rows(at: np.ndarray, doc: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """A row for each document, with its positions in one binary value."""
    order = np.argsort(doc, kind="stable")
    at, doc = at[order].astype("<u4"), doc[order]
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    edges = (4 * np.append(new, len(doc))).astype(np.int32)
    binary = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(at.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(keys[doc[new]].view(np.int64)), binary], _FOUND.names)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the values, where runs of equal ones begin in it, and the run of each place."""
    order = np.argsort(values, kind="stable")
    first = np.ones(len(values), bool)
    first[1:] = values[order[1:]] != values[order[:-1]]
    return order, np.flatnonzero(first), np.cumsum(first) - 1


class _Pending:
    """What a task has read and not packed yet."""

    def __init__(self):
        self.hashes, self.at, self.doc, self.keys, self.ids, self.n, self.docs = [], [], [], [], [], 0, 0

    def add(self, hashes: np.ndarray, at: np.ndarray, doc: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.at.append(at)
        self.doc.append(doc + self.docs)
        self.keys.append(keys)
        self.ids.append(ids)
        self.n += len(hashes)
        self.docs += len(keys)

    def taken(self) -> tuple[np.ndarray, ...]:
        out = tuple(np.concatenate(x) for x in (self.hashes, self.at, self.doc, self.keys, self.ids))
        self.__init__()
        return out


def _settled(at: np.ndarray, doc: np.ndarray, keys: np.ndarray, bits: int) -> list[tuple[int, int, bytes]]:
    """Rows for positions that need no other task, dealt out by document."""
    ranges = (K.mix(keys.copy()) >> np.uint64(64 - bits)).astype(np.int64)[doc]
    return [(r, 1, pack(np.zeros(0, np.uint64), at[i], doc[i], keys, None)) for r, i in _by_range(ranges)] if len(at) else []


# ---- candidates


def _anchors(config: AnchorConfig, bits: int):
    """(key, text) to packed hashes of all windows of a block's length, blocks marked."""

    def packed(pending: _Pending) -> Iterator[pa.RecordBatch]:
        h, at, doc, keys, _ = pending.taken()
        order, first, run = _runs(h)
        several = np.diff(np.append(first, len(h))) > 1
        block = np.logical_or.reduceat((at % config.block == 0)[order], first) if len(h) else np.zeros(0, bool)
        again = np.zeros(len(h), bool)
        again[order] = several[run]
        chosen = np.zeros(len(h), bool)
        chosen[order[first]] = True
        marks = np.zeros(len(h), np.uint32)
        marks[order[first]] = 2 * block + several
        rows = _settled(at[again], doc[again], keys, bits)
        hh, marked, doc = h[chosen], (at[chosen].astype(np.uint32) << np.uint32(2)) | marks[chosen], doc[chosen]
        ranges, low = (hh >> np.uint64(64 - bits)).astype(np.int64), (hh >> np.uint64(32 - bits)).astype(np.uint32)
        rows += [(r, 0, pack(low[i], marked[i], doc[i], keys, None)) for r, i in _by_range(ranges)]
        yield from _batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = _Pending()
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            whole, offsets = K.utf8_column(batch.column(1))
            for lo, hi in K.chunks(offsets):
                buf, offs = whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, words = K.split_words(buf, offs)
                start, doc = K.windows_within(words, config.block)
                h = K.window_hashes(K.SpanHash(buf)(starts, ends), config.block)[start]
                pending.add(h, start - words[:-1][doc], doc, every[lo:hi], np.zeros(hi - lo, np.int64))
                if pending.n >= config.task_words:
                    yield from packed(pending)
        if pending.docs:
            yield from packed(pending)

    return run


def _sliced(rows: pa.Table, config: AnchorConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Packed entries of a range, a slice of its hashes at a time, and last the settled ones with no hashes."""
    settled, packed = rows["settled"].to_numpy(), rows["packed"]
    blobs = [unpack(packed[i].as_buffer()) for i in np.flatnonzero(settled == 0).tolist()]
    bits = max(0, (sum(len(b[0]) for b in blobs) // config.slice_words)).bit_length()
    for s in range(1 << bits if blobs else 0):
        h, at, doc, keys, ids, docs = [], [], [], [], [], 0
        for b in blobs:
            pick = np.flatnonzero((K.mix(b[0].astype(np.uint64)) >> np.uint64(64 - bits)) == s) if bits else np.arange(len(b[0]))
            own, place = np.unique(b[2][pick], return_inverse=True)
            for out, x in zip((h, at, doc, keys, ids), (b[0][pick], b[1][pick], place + docs, b[3][own], b[4][own] if len(b[4]) else b[4])):
                out.append(x)
            docs += len(own)
        yield tuple(np.concatenate(x) for x in (h, at, doc, keys, ids))
    for i in np.flatnonzero(settled == 1).tolist():
        yield unpack(packed[i].as_buffer())


def _met(config: AnchorConfig):
    """Of a range: positions whose hash is a block's and occurs in several places."""

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for h, at, doc, keys, _ in _sliced(rows, config):
            if len(h):
                order, first, which = _runs(h)
                several = (np.diff(np.append(first, len(h))) > 1) & np.logical_or.reduceat((at[order] & 2) > 0, first)
                hit = np.zeros(len(h), bool)
                hit[order] = several[which]
                hit &= (at & 1) == 0
                at, doc = at[hit] >> 2, doc[hit]
            out.append(_found_rows(at, doc, keys))
        return pa.Table.from_batches(out, schema=_found_rows(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)).schema)

    return run


# ---- windows


def _listed(at: pa.ListScalar) -> np.ndarray:
    """All positions of a document's binary values, each once."""
    if not at.is_valid:
        return np.zeros(0, np.int64)
    return np.unique(np.frombuffer(b"".join(x.as_py() for x in at.values), "<u4")).astype(np.int64)


def _around(at: np.ndarray, n_words: int, config: AnchorConfig) -> np.ndarray:
    """Starts of the windows of a document that hold a candidate."""
    last = n_words - config.window
    if last < 0 or not len(at):
        return np.zeros(0, np.int64)
    reach = config.window - config.block
    some = np.zeros(n_words + 1, np.int64)
    np.add.at(some, np.clip(at - reach, 0, n_words), 1)
    np.add.at(some, np.clip(at + 1, 0, n_words), -1)
    return np.flatnonzero(np.cumsum(some)[: last + 1] > 0)


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> str:
    """The words that stay, with one blank between each two."""
    stay = zip(starts[~gone].tolist(), ends[~gone].tolist())
    return b" ".join([text[a:b] for a, b in stay]).decode()


def _covered(at: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Words inside windows that start at the given places: maximal runs of them."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _texts(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of a batch: (lo, hi, bytes, their array, offsets, words' starts and ends, first word of each document)."""
    whole, offsets = K.utf8_column(batch.column(text_at))
    for lo, hi in K.chunks(offsets):
        buf, offs = whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, buf.tobytes(), buf, offs, *K.split_words(buf, offs)


def _looked_up(schema: StructType, text_at: int, at_at: int, config: AnchorConfig, texts: bool):
    """Documents with their candidates: those without a window to look at are finished, others get its starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, _, offs, starts, ends, words in _texts(batch, text_at):
                part, out = batch.slice(lo, hi - lo), []
                for i, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist())):
                    begin = _around(_listed(part.column(at_at)[i]), b - a, config)
                    if len(begin):
                        out.append((b - a, None, None, None, begin.astype("<u4").tobytes()))
                    else:
                        kept = _cut(data, starts[a:b], ends[a:b], np.zeros(b - a, bool))
                        out.append((b - a, 0, hashlib.sha256(kept.encode()).hexdigest(), kept if texts else None, None))
                columns = list(zip(*out)) or [[]] * 5
                made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()))]
                own = part.columns[:at_at]
                if not texts:  # a finished text is not needed any more
                    left = [data[x:y] if o[4] else None for x, y, o in zip(offs[:-1].tolist(), offs[1:].tolist(), out)]
                    own[text_at] = pa.array(left, pa.binary()).cast(own[text_at].type)
                yield pa.RecordBatch.from_arrays([*own, *made], schema.names)

    return run


def _windows(config: AnchorConfig, bits: int):
    """(key, doc_id, text, starts) to packed hashes of windows; of equal ones in a task those of the smallest doc_id."""

    def packed(pending: _Pending) -> Iterator[pa.RecordBatch]:
        h, at, doc, keys, ids = pending.taken()
        order, first, run = _runs(h)
        own = ids[doc]
        least = np.minimum.reduceat(own[order], first) if len(h) else own
        gone = np.zeros(len(h), bool)
        gone[order] = own[order] > least[run]
        rows = _settled(at[gone], doc[gone], keys, bits)
        h, at, doc = h[~gone], at[~gone], doc[~gone]
        ranges = (h >> np.uint64(64 - bits)).astype(np.int64)
        rows += [(r, 0, pack(h[i], at[i], doc[i], keys, ids)) for r, i in _by_range(ranges)]
        yield from _batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = _Pending()
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            ids = pc.fill_null(batch.column(1).cast(pa.int64()), _LAST).to_numpy()
            for lo, hi, _, buf, _, starts, ends, words in _texts(batch, 2):
                begin = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(3).slice(lo, hi - lo).to_pylist()]
                doc = np.repeat(np.arange(hi - lo), [len(x) for x in begin])
                at = np.concatenate(begin)
                h = K.window_hashes(K.SpanHash(buf)(starts, ends), config.window)[at + words[:-1][doc]]
                pending.add(h, at, doc, every[lo:hi], ids[lo:hi])
                if pending.n >= config.task_words:
                    yield from packed(pending)
        if pending.docs:
            yield from packed(pending)

    return run


def _later(config: AnchorConfig):
    """Of a range: windows whose hash a smaller doc_id has too."""

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for h, at, doc, keys, ids in _sliced(rows, config):
            if len(h):
                order, first, which = _runs(h)
                own = ids[doc]
                least = np.minimum.reduceat(own[order], first)
                gone = np.zeros(len(h), bool)
                gone[order] = own[order] > least[which]
                at, doc = at[gone], doc[gone]
            out.append(_found_rows(at, doc, keys))
        return pa.Table.from_batches(out, schema=_found_rows(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)).schema)

    return run


def _removed(schema: StructType, text_at: int, at_at: int, config: AnchorConfig, texts: bool):
    """Documents with the windows that go: their words are cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, _, _, starts, ends, words in _texts(batch, text_at):
                part, out = batch.slice(lo, hi - lo), []
                for i, (a, b) in enumerate(zip(words[:-1].tolist(), words[1:].tolist())):
                    at = _listed(part.column(at_at)[i])
                    gone = _covered(at[at <= b - a - config.window], b - a, config.window)
                    kept = _cut(data, starts[a:b], ends[a:b], gone)
                    out.append((b - a, int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept if texts else None))
                columns = list(zip(*out)) or [[]] * 4
                made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:at_at], *made], schema.names)

    return run


def without_repeats(docs: DataFrame, config: AnchorConfig = AnchorConfig(), texts: bool = True) -> DataFrame:
    """The documents with n_words, n_removed, kept_sha256 and kept, the words that stay; without ``texts`` text and kept are null."""
    n, removed, digest, kept, key, at, begin = fresh_names(docs, *REPORT, "key", "at", "begin")
    report = [StructField(n, LongType()), StructField(removed, LongType()), StructField(digest, StringType()), StructField(kept, StringType())]
    text_at = docs.columns.index("text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = config.range_bits(size // 6)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    packed = keyed.select(F.col(key).alias("key"), "text").mapInArrow(_anchors(config, bits), _PACKED)
    found = packed.repartition(1 << bits, "range").groupBy("range").applyInArrow(_met(config), _FOUND)
    gathered = found.groupBy("key").agg(F.collect_list("at").alias(at)).withColumnRenamed("key", key)
    joined = keyed.join(gathered.hint("shuffle_hash"), key, "left").select(*[f"`{c}`" for c in docs.columns], key, at)
    known = StructType([*docs.schema.fields, StructField(key, LongType())])
    schema = StructType([*known.fields, *report, StructField(begin, BinaryType())])
    looked = written(joined.mapInArrow(_looked_up(StructType([*known.fields, *schema.fields[len(known) :]]), text_at, len(known), config, texts), schema), "anchored")
    names = [f"`{c}`" for c in docs.columns]
    finished = looked.where(F.col(begin).isNull()).select(*names, n, removed, digest, kept)
    open_docs = looked.where(F.col(begin).isNotNull())
    windows = open_docs.select(F.col(key).alias("key"), "doc_id", "text", F.col(begin).alias("begin")).mapInArrow(_windows(config, bits), _PACKED)
    gone = windows.repartition(1 << bits, "range").groupBy("range").applyInArrow(_later(config), _FOUND)
    gone = gone.groupBy("key").agg(F.collect_list("at").alias(at)).withColumnRenamed("key", key)
    cut = open_docs.select(*names, key).join(gone.hint("shuffle_hash"), key, "left").select(*names, at)
    schema = StructType([*docs.schema.fields, *report])
    cut = cut.mapInArrow(_removed(schema, text_at, len(docs.columns), config, texts), schema)
    if not texts:
        cut = cut.withColumn("text", F.lit(None).cast("string"))
    return finished.unionByName(cut)


def removal_report(docs: DataFrame, config: AnchorConfig = AnchorConfig()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return without_repeats(docs.select("doc_id", "text"), config, texts=False).select("doc_id", *REPORT[:3])


REMOVAL_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT r, doc_id, unnest([{'i': i, 'word': w[i], 'run': CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END} FOR i IN range(1, len(w) + 1)], recursive := true)
  FROM d),
f AS (SELECT run, min(doc_id) AS least FROM x WHERE run IS NOT NULL GROUP BY run),
g AS (
  SELECT x.r, x.i, x.word, max(f.least IS NOT NULL AND f.least < x.doc_id) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM x LEFT JOIN f ON x.run = f.run),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r"""
