"""Removal of long repeated byte strings by a distributed sort of sampled suffixes.

A string of ``length`` bytes is repeated if it also starts elsewhere.  Of each such
string the leftmost minimum of k-gram hashes among its first ``window`` positions
is its anchor; equal strings have their anchors at equal places, so only suffixes
at anchors are sorted, each with the bytes before it that a string may hold.

1. Documents with equal texts are one class; a copied text is repeated throughout.
2. Anchors whose next bytes occur at no other anchor are dropped, by hash.
3. Each task sorts its suffixes and writes them as front-coded runs: the prefix
   shared with the run's previous suffix is a number, only the rest is stored.
   Runs are exchanged by ranges of suffixes, with bounds from a bounded sample.
4. A loser tree merges the runs of a range.  Contestants carry the length of the
   prefix they share with the last winner; the longer one wins unseen, and equal
   ones are compared from there on, so no known prefix is compared again.  Out come
   the order and the array of common prefixes.
5. Suffixes whose common prefix reaches far enough are grouped by the bytes before
   them; that tells for each anchor which strings over it are repeated.

A group of suffixes with one beginning stays in one range.  Of a group of more than
``hot`` suffixes, twice a range, those with wholly equal contexts are settled by an
aggregation, and one of each goes on.  If that leaves more than ``hot``, the strings
over an anchor are halved: those that reach less far before it keep its place, the
others count from ``window / 2`` bytes before it.  Each half has longer sure bytes, by
which the group splits, and goes through steps 2 to 5 again.

Defined results: a null or empty text has 0 bytes and nothing removed; so has one
shorter than ``length``; overlaps count; rows that repeat a text, with equal or
different doc_id, count as different places; other columns are kept, whatever their
names; an empty table gives no rows; a very long text gives as many anchors as its
length asks for, worked through ``run_rows`` at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from . import textkernels as K
from .storage import fresh_names, written


@dataclass(frozen=True)
class SuffixConfig:
    length: int = 200
    window: int = 100
    gram: int = 16
    run_rows: int = 20_000
    range_rows: int = 30_000
    sample_per_range: int = 40
    hot: int = 60_000
    broadcast_rows: int = 500_000

    @property
    def sure(self) -> int:
        """Bytes after an anchor that any string over it holds."""
        return self.length - self.window + 1

    @property
    def width(self) -> int:
        return self.length + self.window - 1


def anchors(buf: np.ndarray, offs: np.ndarray, config: SuffixConfig) -> np.ndarray:
    """Positions of the anchors of all strings of a chunk of documents."""
    n, w = len(buf), config.window
    starts = np.zeros(n + 1, np.int64)
    room = np.diff(offs) >= config.length
    np.add.at(starts, offs[:-1][room], 1)
    np.add.at(starts, offs[1:][room] - config.length + 1, -1)
    valid = np.flatnonzero(np.cumsum(starts[:n]) > 0)
    if not len(valid):
        return valid
    at = np.arange(n)
    h = K.SpanHash(buf)(at, np.minimum(at + config.gram, n))
    bits = max(1, int(n).bit_length())
    key = ((h >> np.uint64(bits)) << np.uint64(bits)) | at.astype(np.uint64)  # equal hashes: leftmost
    blocks = -(-(n + w) // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    return np.unique(least[valid] & np.uint64((1 << bits) - 1)).astype(np.int64)


def anchor_table(texts: DataFrame, config: SuffixConfig) -> DataFrame:
    """(hash of the sure bytes, class, pos) of all anchors of (class, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column(0).to_numpy()
            buf, offs = K.utf8_column(batch.column(1))
            for lo, hi in K.chunks(offs):
                part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                pos = anchors(part, at, config)
                doc = np.searchsorted(at, pos, side="right") - 1
                sure = K.SpanHash(part)(pos, pos + config.sure).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sure), pa.array(classes[lo:hi][doc]), pa.array(pos - at[doc])], ["start", "class", "pos"])

    return texts.select("class", "text").mapInArrow(run, "start long, class long, pos long")


def shared_anchors(table: DataFrame, config: SuffixConfig) -> DataFrame:
    """The anchors (class, pos, start, hot) whose sure bytes also stand at another anchor.

    Beginnings are counted in the tasks before they are dealt out, and the join by them
    can be split, so a frequent one is not the work of one task.
    """
    often = written(table.groupBy("start").agg(F.count("*").alias("n")).where("n > 1"), "shared-beginnings")
    return table.join(often, "start").select("class", "pos", "start", (F.col("n") > config.hot).alias("hot"))


def contexts(buf: np.ndarray, start: int, end: int, pos: np.ndarray, config: SuffixConfig) -> np.ndarray:
    """Rows of ``width`` bytes for anchors of one document: bytes from the anchor on, then those before it, backwards."""
    right = pos[:, None] + np.arange(config.length)
    left = pos[:, None] - 1 - np.arange(config.window - 1)
    rows = np.zeros((len(pos), config.width), np.uint8)
    top = len(buf) - 1
    rows[:, : config.length] = np.where(right < end, buf[np.minimum(right, top)], 0)
    rows[:, config.length :] = np.where(left >= start, buf[np.maximum(left, 0)], 0)
    return rows


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared lengths, remaining bytes) of sorted rows."""
    shared = common_prefix(rows)
    return shared, rows[np.arange(rows.shape[1]) >= shared[:, None]]


def front_decode(shared: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    own = np.arange(width) >= shared[:, None]
    rows = np.zeros((len(shared), width), np.uint8)
    rows[own] = rest
    source = np.where(own, np.arange(len(shared), dtype=np.int32)[:, None], np.int32(0))
    np.maximum.accumulate(source, axis=0, out=source)
    return np.take_along_axis(rows, source, axis=0)


class LoserTree:
    """Merge of sorted runs of byte strings with known common prefixes.

    ``runs`` are lists of equally long byte strings and ``shared`` the prefix each
    shares with the one before it in its run.  Iterating gives (run, index, prefix
    shared with the string given before).
    """

    def __init__(self, runs: list[list[bytes]], shared: list[list[int]]):
        self.runs, self.shared = runs, shared
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.at = [0] * len(runs)
        self.prefix = [0] * self.size  # of each run's head with the last winner; -1: run at its end
        for r in range(self.size):
            if r >= len(runs) or not runs[r]:
                self.prefix[r] = -1
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._match(self._build(2 * node), self._build(2 * node + 1), node)

    def _match(self, a: int, b: int, node: int) -> int:
        """The smaller of two heads; the other one stays at the node."""
        prefix = self.prefix
        p, q = prefix[a], prefix[b]
        if p < q:
            a, b = b, a
        elif p == q and p >= 0:
            x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
            u, v = x[p:], y[p:]
            if u == v:
                prefix[b] = len(x)
            else:
                differ = int.from_bytes(u) ^ int.from_bytes(v)
                same = p + len(u) - (differ.bit_length() + 7) // 8
                if u > v:
                    a, b = b, a
                prefix[b] = same
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        at, prefix, shared, loser = self.at, self.prefix, self.shared, self.loser
        while prefix[w := self.winner] >= 0:
            i = at[w]
            yield w, i, prefix[w]
            at[w] = i = i + 1
            prefix[w] = shared[w][i] if i < len(shared[w]) else -1
            node = (w + self.size) >> 1
            while node:
                w = self._match(w, loser[node], node)
                node >>= 1
            self.winner = w


def repeated_spans(rows: np.ndarray, shared: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: largest and smallest number of bytes before the anchor with which a string over it is repeated; -1 if none."""
    n, length = len(rows), config.length
    most, least = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return most, least
    whole = shared >= config.width
    ends = n_left != np.roll(n_left, 1)
    ends |= n_right != np.roll(n_right, 1)
    whole &= ~ends
    whole[0] = False
    copied = whole.copy()
    copied[:-1] |= whole[1:]
    low, high = np.maximum(0, length - n_right), np.minimum(config.window - 1, n_left)
    fine = copied & (low <= high)
    most[fine], least[fine] = high[fine], low[fine]
    # One row of each group of equal ones goes on, with those that no other equals.
    keep = np.flatnonzero(~whole)
    right = np.minimum(np.minimum(shared, length), np.minimum(n_right, np.roll(n_right, 1)))
    right[0] = 0
    right_of = right[keep]
    block = np.cumsum(right_of < config.sure)
    several = np.bincount(block, minlength=block[-1] + 1)[block] > 1
    keep, right_of = keep[several], right_of[several]
    if not len(keep):
        return most, least
    lefts, rights = n_left[keep], n_right[keep]
    done = copied[keep]
    h = np.zeros(len(keep), np.uint64)
    for size in range(config.window):
        if size:
            h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[keep, length + size - 1] + np.uint64(1))
        able = np.flatnonzero((lefts >= size) & (rights >= length - size))
        if len(able) < 2:
            continue
        group = np.cumsum(right_of < length - size)[able].astype(np.uint64)
        again, _ = K.repeated(K.mix(h[able] * np.uint64(0xD6E8FEB86659FD93) + K.mix(group + np.uint64(1 << 40))))
        hit = able[again & ~done[able]]
        most[keep[hit]] = size
        fresh = hit[least[keep[hit]] < 0]
        least[keep[fresh]] = size
    return most, least


def _with_texts(positions: DataFrame, texts: DataFrame, config: SuffixConfig) -> DataFrame:
    """(class, text, at): texts of the classes that have positions, with the positions."""
    grouped = positions.groupBy("class").agg(F.collect_list("pos").alias("at"))
    if positions.select("class").distinct().count() <= config.broadcast_rows:
        texts = texts.join(F.broadcast(positions.select("class").distinct()), "class", "left_semi")
    return texts.join(grouped, "class").select("class", "text", "at")


def _each_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int, int, np.ndarray]]:
    """(class, bytes of the batch, start, end, sorted distinct positions) of (class, text, at) rows."""
    for batch in batches:
        classes = batch.column(0).to_pylist()
        buf, offs = K.utf8_column(batch.column(1))
        lists = batch.column(2)
        flat, edges = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        edges = edges - edges[0]
        for i, c in enumerate(classes):
            yield c, buf, int(offs[i]), int(offs[i + 1]), np.unique(flat[edges[i] : edges[i + 1]])


def front_coded_runs(with_texts: DataFrame, bounds: np.ndarray, config: SuffixConfig) -> DataFrame:
    """Sorted runs of suffixes, cut at the bounds of the ranges: one row a run and range."""
    schema = "part int, class binary, pos binary, n_left binary, n_right binary, shared binary, rest binary"

    def pack(held) -> Iterator[pa.RecordBatch]:
        rows, classes, pos, n_left, n_right = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(rows.view(f"S{config.width}").ravel(), kind="stable")
        rows = rows[order]
        parts = np.searchsorted(bounds, rows[:, : config.sure].copy().view(f"S{config.sure}").ravel(), side="right")
        out = []
        for part in np.unique(parts):
            lo, hi = np.searchsorted(parts, [part, part + 1])
            shared, rest = front_code(rows[lo:hi])
            at = order[lo:hi]
            out.append(
                (int(part), classes[at].tobytes(), pos[at].tobytes(), n_left[at].astype(np.uint16).tobytes(), n_right[at].astype(np.uint16).tobytes(), shared.astype(np.uint16).tobytes(), rest.tobytes())
            )
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], ["part", "class", "pos", "n_left", "n_right", "shared", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for c, buf, start, end, pos in _each_document(batches):
            for lo in range(0, len(pos), config.run_rows):
                at = pos[lo : lo + config.run_rows]
                here = start + at
                held.append((contexts(buf, start, end, here, config), np.full(len(at), c), at, np.minimum(at, config.window - 1), np.minimum(end - here, config.length)))
                n += len(at)
                if n >= config.run_rows:
                    yield from pack(held)
                    held, n = [], 0
        if held:
            yield from pack(held)

    return with_texts.mapInArrow(run, schema)


def merge_ranges(runs: DataFrame, config: SuffixConfig) -> DataFrame:
    """(class, first, after): byte spans that repeated strings cover, one row an anchor at most."""

    def merge(table: pa.Table) -> pa.Table:
        rows, lists, shared, ids = [], [], [], []
        for r in table.to_pylist():
            s = np.frombuffer(r["shared"], np.uint16).astype(np.int64)
            m = front_decode(s, np.frombuffer(r["rest"], np.uint8), config.width)
            flat = m.tobytes()
            lists.append([flat[k : k + config.width] for k in range(0, len(flat), config.width)])
            shared.append(s.tolist())
            rows.append(m)
            ids.append([np.frombuffer(r[c], t) for c, t in (("class", np.int64), ("pos", np.int64), ("n_left", np.uint16), ("n_right", np.uint16))])
        base = np.concatenate(([0], np.cumsum([len(m) for m in rows])))
        merged = np.array([(base[r] + i, p) for r, i, p in LoserTree(lists, shared)], np.int64).reshape(-1, 2)
        del lists, shared
        order, prefix = merged[:, 0], merged[:, 1]
        classes, pos, n_left, n_right = (np.concatenate([x[j] for x in ids])[order] for j in range(4))
        whole = np.concatenate(rows)
        del rows
        most, least = repeated_spans(whole[order], prefix, n_left.astype(np.int64), n_right.astype(np.int64), config)
        hit = most >= 0
        first, after = pos[hit] - most[hit], pos[hit] - least[hit] + config.length
        return pa.table({"class": classes[hit], "first": first, "after": after})

    return runs.groupBy("part").applyInArrow(merge, "class long, first long, after long")


def starts_at(with_texts: DataFrame, config: SuffixConfig) -> DataFrame:
    """(start, class, pos): hashes of the sure bytes at given positions; those that the text's end cuts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, buf, start, end, pos in _each_document(batches):
            pos = pos[pos + config.sure <= end - start]
            sure = K.SpanHash(buf[start:end])(pos, pos + config.sure).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sure), pa.array(np.full(len(pos), c)), pa.array(pos)], ["start", "class", "pos"])

    return with_texts.mapInArrow(run, "start long, class long, pos long")


def equal_contexts(with_texts: DataFrame, config: SuffixConfig) -> DataFrame:
    """(context, start, class, pos, first, after): one anchor of each context of a text, with the span of the strings over it.

    A context is all that strings over the anchor may hold.  Where one stands several
    times in a text, the spans of all its places come too, without a context.
    """
    names = ["context", "start", "class", "pos", "first", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, buf, start, end, pos in _each_document(batches):
            span, n = K.SpanHash(buf[start:end]), end - start
            left, right = np.minimum(pos, config.window - 1), np.minimum(n - pos, config.length)
            context = K.mix(span(pos - left, pos + right) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sure = span(pos, pos + config.sure).view(np.int64)
            first, after = pos - left, pos - np.maximum(0, config.length - right) + config.length
            keys, pick, back, count = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
            own = _merged(np.stack([first, after], axis=1)[(count[back] > 1) & (after - first >= config.length)])
            none = [None] * len(own)
            columns = [none + keys.view(np.int64).tolist(), none + sure[pick].tolist(), [c] * (len(own) + len(pick)), none + pos[pick].tolist()]
            columns += [np.concatenate([own[:, i], x[pick]]) for i, x in enumerate((first, after))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return with_texts.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def settle_equal(hot: DataFrame, texts: DataFrame, config: SuffixConfig) -> tuple[DataFrame, DataFrame]:
    """Spans of the anchors whose context stands elsewhere too, and (start, class, pos) of one anchor of each context."""
    found = written(equal_contexts(_with_texts(hot, texts, config), config), "contexts")
    dealt = found.where("context IS NOT NULL")
    often = dealt.groupBy("context").agg(F.count("*").alias("n"), F.min(F.struct("class", "pos")).alias("one"))
    often = written(often.where("n > 1").select("context", F.col("one.class").alias("one_class"), F.col("one.pos").alias("one_pos")), "equal-contexts")
    dealt = written(dealt.join(often, "context", "left"), "dealt-contexts")
    own = found.where("context IS NULL").select("class", "first", "after")
    across = dealt.where(f"one_pos IS NOT NULL AND after - first >= {config.length}").select("class", "first", "after")
    one = dealt.where("one_pos IS NULL OR (one_class = class AND one_pos = pos)").select("start", "class", "pos")
    return own.unionByName(across), one


def _class() -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text, F.octet_length(text))


def repeated_bytes(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> tuple[DataFrame, DataFrame]:
    """Spans (class, spans) of the texts' classes, and the classes that several rows share."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", _class().alias("class"), "text")
    copied = written(rows.where(F.octet_length("text") >= config.length).groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1"), "copied-texts")
    # One text of each class; rows that repeat both doc_id and text may stay, they are the same place.
    spare = copied.select("class", F.col("doc_id").alias("first_id"))
    spare = F.broadcast(spare) if copied.count() <= config.broadcast_rows else spare
    texts = rows.where(F.octet_length("text") >= config.length).join(spare, "class", "left")
    texts = texts.where(F.col("first_id").isNull() | (F.col("doc_id") == F.col("first_id"))).select("class", "text")

    found = written(shared_anchors(written(anchor_table(texts, config), "anchors"), config), "shared-anchors")
    spans = _spans_of(found, texts, config)
    spans = written(spans.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("first", "after"))).alias("spans")), "repeated-spans")
    return spans, copied.select("class")


def _spans_of(found: DataFrame, texts: DataFrame, config: SuffixConfig) -> DataFrame:
    """(class, first, after) for all shared anchors: merges of ranges, with windows halved as long as a beginning is hot."""
    spans = []
    while True:
        hot, cold = (found.where(c).select("class", "pos") for c in ("hot", "NOT hot"))
        if hot.take(1):
            settled, one = settle_equal(hot, texts, config)
            found = written(shared_anchors(one, config), "shared-anchors")
            hot = found.where("hot").select("class", "pos")
            cold = cold.unionByName(found.where("NOT hot").select("class", "pos"))
            spans.append(settled)
        spans.append(merged_spans(cold, texts, config))
        if config.window == 1 or not hot.take(1):
            break
        config = replace(config, window=(config.window + 1) // 2)
        halves = hot.unionByName(hot.select("class", (F.col("pos") - config.window).alias("pos")).where("pos >= 0"))
        starts = written(starts_at(_with_texts(halves, texts, config), config), "anchors")
        found = written(shared_anchors(starts, config), "shared-anchors")
    return reduce(DataFrame.unionByName, spans)


def merged_spans(positions: DataFrame, texts: DataFrame, config: SuffixConfig) -> DataFrame:
    """(class, first, after) of the anchors (class, pos): runs, ranges with sampled bounds, merges."""
    n = positions.count()
    parts = max(1, -(-n // config.range_rows))
    bounds = np.zeros(0, f"S{config.sure}")
    if parts > 1:
        every = max(1, n // (parts * config.sample_per_range))
        sample = positions.where(F.pmod(F.xxhash64("class", "pos"), F.lit(every)) == 0)

        def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, buf, start, _end, pos in _each_document(batches):
                yield pa.RecordBatch.from_arrays([pa.array([buf[start + p : start + p + config.sure].tobytes() for p in pos.tolist()], pa.binary())], ["b"])

        got = np.sort(np.array([r["b"] for r in _with_texts(sample, texts, config).mapInArrow(beginnings, "b binary").collect()], f"S{config.sure}"))
        bounds = np.unique(got[np.linspace(0, len(got) - 1, parts + 1).astype(int)[1:-1]]) if len(got) else bounds
    return merge_ranges(front_coded_runs(_with_texts(positions, texts, config), bounds, config), config)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans (first, after) as maximal runs."""
    if not len(spans):
        return spans.reshape(0, 2)
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    at = np.flatnonzero(first)
    return np.stack([spans[at, 0], np.maximum.reduceat(spans[:, 1], at)], axis=1)


REPORT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "touched")


def without_repeats(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """All columns of ``docs``, then what is removed and what is left.

    The last six are those of ``REPORT``, under names that no column of ``docs`` has:
    ``kept`` is the remaining text, ``touched`` tells whether anything is removed.
    """
    of, cut_spans, copied_, *found = fresh_names(docs, "own_class", "cut_spans", "copied", *REPORT)
    spans, copied = repeated_bytes(docs, config)
    marks = spans.join(copied.withColumn("c", F.lit(True)), "class", "full")
    marks = marks.select(F.col("class").alias(of), F.col("spans").alias(cut_spans), F.coalesce("c", F.lit(False)).alias(copied_))
    rows = docs.withColumn(of, _class())
    names = [f.name for f in docs.schema.fields]
    empty = marks.schema[cut_spans].dataType
    if marks.count() <= config.broadcast_rows:  # only texts that lose something are shuffled
        touched = F.broadcast(marks.select(of))
        plain = rows.join(touched, of, "left_anti").withColumn(cut_spans, F.lit(None).cast(empty)).withColumn(copied_, F.lit(False))
        rows = rows.join(touched, of, "left_semi").join(marks, of).select(*names, cut_spans, copied_).unionByName(plain.select(*names, cut_spans, copied_))
    else:
        rows = rows.join(marks, of, "left").select(*names, cut_spans, F.coalesce(copied_, F.lit(False)).alias(copied_))
    schema = StructType(
        docs.schema.fields
        + [StructField(c, LongType()) for c in found[:3]]
        + [StructField(found[3], StringType()), StructField(found[4], StringType()), StructField(found[5], BooleanType())]
    )
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.utf8_column(batch.column(place))
            spans_of, copies = batch.column(len(names)), batch.column(len(names) + 1).to_pylist()
            flat, edges = spans_of.flatten(), spans_of.offsets.to_numpy()
            edges = edges - edges[0]
            pairs = np.stack([flat.field("first").to_numpy(), flat.field("after").to_numpy()], axis=1)
            out = []
            for i in range(len(batch)):
                text = buf[offs[i] : offs[i + 1]]
                runs = np.array([[0, len(text)]]) if copies[i] else _merged(pairs[edges[i] : edges[i + 1]])
                if len(runs):
                    keep = np.ones(len(text), dtype=bool)
                    for a, b in runs.tolist():
                        keep[a:b] = False
                    kept = text[keep].tobytes()
                else:
                    kept = text.tobytes()
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), len(runs) > 0))
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)] + [pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    return rows.mapInArrow(cut, schema)


def removal_report(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    out = without_repeats(docs.select("doc_id", "text"), config)
    return out.select("doc_id", *REPORT[:4])


def deduplicated(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """The documents without their repeated bytes; rows left empty by that go.

    Bytes of a character that a cut has split are dropped with it.
    """
    out = without_repeats(docs, config)
    kept, touched = (F.col(f"`{c}`") for c in out.columns[-2:])
    text = F.when(touched, kept).otherwise(F.col("text")).alias("text")
    return out.where(~touched | (F.length(F.trim(kept)) > 0)).select(*[text if c == "text" else c for c in docs.columns])
