"""k-mers as packed numbers, minimizers, and counting by runs of one minimizer.

Bases take two bits, A < C < T < G, the first base highest, so that the order of packed
keys is the order of digit strings: a LONG up to 31 bases, and big-endian bytes of one
length beyond.  Numpy works on whole Arrow batches inside Spark's tasks; exchanges and
final counts are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from strandloom.config import AssemblyConfig
from strandloom.functions import sequence as S

#: Minimizers up to this length have a dense table of ranks in every task (4**12 numbers, 64 MB).
LONGEST_MINIMIZER = 12
#: Letters that a task works on at a time, and rows that it hands on at a time.
LETTERS, ROWS = 1 << 20, 1 << 16
#: Packed keys are dealt out to 2**SHARE_BITS shares, of which a task holds one at a time.
SHARE_BITS = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNMIX = np.uint64(pow(int(_MIX), -1, 1 << 64))
#: Windows up to this length are counted in one dense table a task (8 MB at most).
LONGEST_DENSE = 10
_BAD = 255
_STRICT = np.full(256, _BAD, np.uint8)
for _digit, _bases in enumerate(("Aa", "Cc", "TtUu", "Gg")):
    _STRICT[[ord(b) for b in _bases]] = _digit
_IS_BASE = np.isin(np.arange(256), np.frombuffer(b"ACGTacgt", np.uint8))
#: The four digits of a packed byte, as one number.
_FOUR = np.ascontiguousarray((np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3).astype(np.uint8) + np.uint8(ord("0"))).view(np.uint32).ravel()
_COMPAT = (np.arange(256) >> 1 & 7).astype(np.uint8)


def clean(seq: Column) -> Column:
    """Sequences in which every character is one byte."""
    return F.regexp_replace(F.coalesce(seq, F.lit("")), r"[^\x01-\x7F]", "\x01")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of strings as (bytes, offsets)."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


class Bases:
    """The bases of many reads in one row: ``inner`` where a base is not the last of its window, ``last`` where it is."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, alphabet: str):
        n = len(buf)
        if alphabet == "strict":
            self.inner = self.last = _STRICT[buf]
            ends = np.union1d(np.flatnonzero(self.inner == _BAD), np.append(offs[1:], n))
        else:
            codes = _COMPAT[buf]
            self.last = codes & 3
            spill = np.zeros(n, np.uint8)
            spill[:-1] = codes[1:] >> 2  # only used inside a window, so never across two reads
            self.inner = self.last | spill
            ends = np.append(offs[1:], n)
        # The end of the stretch that a window may lie in.
        self.stretch_end = np.repeat(ends, np.diff(ends, prepend=0)) if n else np.zeros(0, np.int64)
        self.stretch_end[self.inner == _BAD] = 0
        self.n = n

    def starts(self, size: int) -> np.ndarray:
        """Places at which a whole window of ``size`` bases starts."""
        at = np.arange(max(self.n - size + 1, 0))
        return at[at + size <= self.stretch_end[: len(at)]]

    def _inner(self, size: int) -> np.ndarray:
        """Packed ``inner`` bases of all runs of up to 32, whatever they cross; by doubling."""
        out, have, block, width = np.zeros(self.n + 1, np.uint64), 0, (self.inner & 3).astype(np.uint64), 1
        out = out[: self.n]
        while size:
            if size & 1:
                out = _after(out, have, block, width)
                have += width
            size >>= 1
            if size:
                block = _after(block, width, block, width)
                width *= 2
        return out

    def packed(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(high, low): the first ``size`` - 32 bases and the last 32 of the window at each place; up to 32 bases are all low."""
        low_size = min(size, 32)
        low = _after(self._inner(low_size - 1), low_size - 1, (self.last & 3).astype(np.uint64), 1)
        if size <= 32:
            return np.zeros(0, np.uint64), low
        shift = size - 32
        moved = np.zeros_like(low)
        moved[: max(self.n - shift, 0)] = low[shift:]
        return self._inner(shift), moved


def _after(a: np.ndarray, width: int, b: np.ndarray, more: int) -> np.ndarray:
    """Runs of ``width`` bases at each place, and ``more`` bases behind them."""
    out = a << np.uint64(2 * more) if more < 32 else np.zeros_like(a)
    if width < len(b):
        out[: len(b) - width] |= b[width:]
    return out


def key_type(k: int) -> str:
    return "long" if k <= 31 else "binary"


def _keys(high: np.ndarray, low: np.ndarray, k: int) -> pa.Array:
    if k <= 31:
        return pa.array(low.view(np.int64))
    size = -(-k // 4)
    both = np.zeros((len(low), 16), np.uint8)
    both[:, 8:] = low.astype(">u8").view(np.uint8).reshape(-1, 8)
    if k > 32:
        both[:, :8] = high.astype(">u8").view(np.uint8).reshape(-1, 8)
    data = np.ascontiguousarray(both[:, 16 - size :])
    offsets = (np.arange(len(low) + 1) * size).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _only_bases(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The base letters of texts, as (bytes, offsets)."""
    if len(offs) == 2:
        kept = buf[_IS_BASE[buf]]
        return kept, np.array([0, len(kept)])
    at = np.flatnonzero(_IS_BASE[buf])
    return buf[at], np.searchsorted(at, offs)


def _slices(batches: Iterator[pa.RecordBatch], alphabet: str, n: int = 1, bases_only: bool = False) -> Iterator[Bases]:
    """The bases of the batches, about ``LETTERS`` at a time, so that a worker's memory does not follow the batches.

    Longer reads are cut into pieces that overlap by ``n`` - 1, each window of ``n`` bases whole in one
    of them.  With ``bases_only`` other letters are dropped before windows are made.
    """
    per_slice = LETTERS * 4 if bases_only else LETTERS
    for batch in batches:
        buf, offs = text_bytes(batch.column(0))
        lo = 0
        while lo < len(offs) - 1:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + per_slice, side="right")) - 1)
            part, ends = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            if bases_only:
                part, ends = _only_bases(part, ends)
            if hi > lo + 1 or len(part) < LETTERS + n:
                yield Bases(part, ends, alphabet)
            else:
                for at in range(0, len(part) - n + 1, LETTERS):
                    piece = part[at : at + LETTERS + n - 1]
                    yield Bases(piece, np.array([0, len(piece)]), alphabet)
            lo = hi


def _counted_keys(bases: Bases, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of up to 32 bases, ascending, and how often each occurs."""
    return np.unique(bases.packed(n)[1][bases.starts(n)], return_counts=True)


def packed_kmers(reads: DataFrame, config: AssemblyConfig, size: int | None = None, bases_only: bool = False) -> DataFrame:
    """(key, times): packed windows of ``size`` bases of the reads, k-mers if none is given, counted in each slice; short ones in each task."""
    k, alphabet = size or config.k, config.alphabet

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(4**k, np.int64)
        for bases in _slices(batches, alphabet, k, bases_only):
            times += np.bincount(bases.packed(k)[1][bases.starts(k)].view(np.int64), minlength=4**k)
        keys = np.flatnonzero(times)
        for i in range(0, len(keys), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + ROWS]), pa.array(times[keys[i : i + ROWS]])], ["key", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bases in _slices(batches, alphabet, k, bases_only):
            if k <= 32:
                low, times = _counted_keys(bases, k)
                high = np.zeros(0, np.uint64)
            else:
                at = bases.starts(k)
                high, low = (x[at] for x in bases.packed(k))
                order = np.lexsort((low, high))
                high, low = high[order], low[order]
                new = np.flatnonzero(np.r_[len(low) > 0, (high[1:] != high[:-1]) | (low[1:] != low[:-1])][: len(low)])
                times = np.diff(np.append(new, len(low)))
                high, low = high[new], low[new]
            yield pa.RecordBatch.from_arrays([_keys(high, low, k), pa.array(times, pa.int64())], ["key", "times"])

    return _pieces(reads, k, alphabet).mapInArrow(dense if k <= LONGEST_DENSE else count, f"key {key_type(k)}, times long")


def _pieces(reads: DataFrame, n: int, alphabet: str) -> DataFrame:
    """What ``_slices`` takes: the reads of the strict alphabet; else in overlapping pieces of one-byte letters."""
    if alphabet == "strict":  # other letters, of however many bytes, only end a stretch
        return reads.select(F.coalesce(F.col("seq"), F.lit("")).alias("seq"))
    return reads.select(F.explode(S.pieces(clean(F.col("seq")), n, 1 << 13)).alias("seq"))


def _runs_by_share(reads: DataFrame, config: AssemblyConfig, bases_only: bool) -> DataFrame:
    """(share, keys, times): a slice's distinct LONG keys of one share with their counts, in order of the shares in the task that holds all of one."""
    k, alphabet = config.k, config.alphabet

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1 << SHARE_BITS, dtype=np.uint64) << np.uint64(64 - SHARE_BITS)
        for bases in _slices(batches, alphabet, k, bases_only):
            mixed = bases.packed(k)[1][bases.starts(k)] * _MIX  # in this order the keys of a share lie together
            mixed.sort()
            new = np.flatnonzero(np.r_[len(mixed) > 0, mixed[1:] != mixed[:-1]][: len(mixed)])
            times = np.diff(np.append(new, len(mixed))).astype(np.uint32)
            mixed = mixed[new]
            ends = np.append(np.searchsorted(mixed, edges), len(mixed))
            share = np.flatnonzero(np.diff(ends))
            ends = np.append(ends[share], len(mixed))
            binary = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(share), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([pa.array(share.astype(np.int32)), binary(mixed * _UNMIX), binary(times)], ["share", "keys", "times"])

    runs = _pieces(reads, k, alphabet).mapInArrow(dealt, "share int, keys binary, times binary")
    return runs.repartition("share").sortWithinPartitions("share")


def packed_counts(reads: DataFrame, config: AssemblyConfig, bases_only: bool = False) -> DataFrame:
    """(key, cnt): the packed form of ``kmer_counts``.

    LONG keys are exchanged in runs: a slice's distinct keys of one share, with their
    counts.  A share's runs meet in one task and are summed together, share by share.
    """
    if config.k > 31:
        return packed_kmers(reads, config, bases_only=bases_only).groupBy("key").agg(F.sum("times").alias("cnt"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sums in _summed_runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["key", "cnt"])

    return _runs_by_share(reads, config, bases_only).mapInArrow(rows, "key long, cnt long")


def spelled_counts(reads: DataFrame, config: AssemblyConfig, bases_only: bool = False) -> DataFrame:
    """(kmer, cnt): ``packed_counts`` up to 31 bases, spelled in the task that sums them."""
    k = config.k

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sums in _summed_runs(batches):
            yield pa.RecordBatch.from_arrays([spelled(keys, k), pa.array(sums)], ["kmer", "cnt"])

    return _runs_by_share(reads, config, bases_only).mapInArrow(rows, "kmer string, cnt long")


def _summed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs in order of their shares: the keys of each share and their sums, at most ``ROWS`` at a time."""
    ready: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[bytes, bytes]] = []
    share = None

    def close() -> None:
        keys = np.frombuffer(b"".join(k for k, _ in held), np.uint64)
        times = np.frombuffer(b"".join(t for _, t in held), np.uint32)
        held.clear()
        order = np.argsort(keys)
        keys, times = keys[order], times[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ready.append((keys[first], np.add.reduceat(times, first)))

    def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, sums = (np.concatenate(x) for x in zip(*ready))
        ready.clear()
        for i in range(0, len(keys), ROWS):
            yield keys[i : i + ROWS], sums[i : i + ROWS]

    for batch in batches:
        for one, keys, times in zip(*(c.to_pylist() for c in batch.columns)):
            if held and one != share:
                close()
                if sum(len(k) for k, _ in ready) >= ROWS:
                    yield from rows()
            share = one
            held.append((keys, times))
    if held:
        close()
    if ready:
        yield from rows()


def _strings(digits: np.ndarray) -> pa.Array:
    """Rows of characters as strings of one length."""
    n, size = digits.shape
    offsets = (np.arange(n + 1) * size).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(digits)))


def spelled(keys: np.ndarray, k: int) -> pa.Array:
    """The digit strings of packed keys of up to 32 bases."""
    return _strings(_FOUR[keys.astype(">u8").view(np.uint8)].view(np.uint8).reshape(-1, 32)[:, 32 - k :])


def summed_runs(reads: DataFrame, config: AssemblyConfig, bases_only: bool = False) -> DataFrame:
    """(keys, cnts, n, total, few): ``packed_counts`` up to 31 bases with at most ``ROWS`` keys in a row, for tables that are written.

    ``few`` is how many of the row's keys occur once, twice, and so on below ``buckets``.
    """
    buckets = config.buckets

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sums in _summed_runs(batches):
            few = np.bincount(sums[sums < buckets], minlength=max(buckets, 1))[1:]
            columns = [pa.array([keys.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), pa.array([len(keys)]), pa.array([int(sums.sum())])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([few], pa.list_(pa.int64()))], ["keys", "cnts", "n", "total", "few"])

    return _runs_by_share(reads, config, bases_only).mapInArrow(rows, "keys binary, cnts binary, n long, total long, few array<long>")


def spelled_from(runs: DataFrame, least: int, k: int) -> DataFrame:
    """(kmer, cnt) of the keys in ``summed_runs`` that occur ``least`` times or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sums in zip(batch.column(0), batch.column(1)):
                keys, sums = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(sums.as_buffer(), np.int64)
                at = np.flatnonzero(sums >= least)
                if len(at):
                    yield pa.RecordBatch.from_arrays([spelled(keys[at], k), pa.array(sums[at])], ["kmer", "cnt"])

    return runs.select("keys", "cnts").mapInArrow(rows, "kmer string, cnt long")


def unpacked(key: Column, k: int) -> Column:
    """The digit string of a packed key."""
    digits = lambda hexed, n: F.lpad(F.conv(hexed, 16, 4), n, "0")
    if k <= 31:
        return F.lpad(F.conv(key.cast("string"), 10, 4), k, "0")
    hexed, size = F.hex(key), 2 * -(-k // 4)
    if k == 32:
        return digits(hexed, 32)
    return F.concat(digits(F.substring(hexed, 1, size - 16), k - 32), digits(F.substring(hexed, size - 15, 16), 32))


# ---- minimizers


def rank_table(lmers: DataFrame, size: int) -> np.ndarray:
    """Dense ranks of the frequencies of all l-mers, by packed l-mer; at most 4**``LONGEST_MINIMIZER`` numbers."""
    if size > LONGEST_MINIMIZER:
        raise ValueError(f"minimizers above {LONGEST_MINIMIZER} bases have no dense table")
    found = lmers.select(S.number(F.col("lmer")).alias("code"), "freq").toArrow()
    freq = np.zeros(4**size, np.int64)
    freq[found["code"].to_numpy()] = found["freq"].to_numpy()
    return np.unique(freq, return_inverse=True)[1].astype(np.int32)


def _rarest(ranks: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` l-mers: place of the leftmost of least rank; windows at the end are cut."""
    best = (ranks.astype(np.int64) << 40) + np.arange(len(ranks))
    have, last = 1, np.iinfo(np.int64).max
    while have < width:
        step = min(have, width - have)
        moved = np.full_like(best, last)
        if step < len(best):
            moved[:-step] = best[step:]
        best = np.minimum(best, moved)
        have += step
    return best & ((1 << 40) - 1)


def minimizers(kmers: DataFrame, lmers: DataFrame, config: AssemblyConfig) -> DataFrame:
    """``kmers`` of digits with minimizer and pos: leftmost of the rarest l-mers of each; no exchange."""
    k, size, at = config.k, config.minimizer, kmers.columns.index("kmer")
    schema = StructType([*kmers.schema.fields, StructField("minimizer", StringType()), StructField("pos", IntegerType())])
    table = kmers.sparkSession.sparkContext.broadcast(rank_table(lmers, size))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = (text_bytes(batch.column(at))[0] - np.uint8(ord("0"))).reshape(-1, k)
            codes = np.zeros((len(digits), k - size + 1), np.int32)
            for j in range(size):
                codes = codes * 4 + digits[:, j : j + k - size + 1]
            pos = np.argmin(table.value[codes], axis=1)
            taken = digits[np.arange(len(digits))[:, None], pos[:, None] + np.arange(size)] + np.uint8(ord("0"))
            offsets = (np.arange(len(digits) + 1) * size).astype(np.int32)
            chosen = pa.StringArray.from_buffers(len(digits), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(taken).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, chosen, pa.array(pos.astype(np.int32))], schema.names)

    return kmers.mapInArrow(choose, schema)


def counted_minimizers(reads: DataFrame, lmers: DataFrame, config: AssemblyConfig, bases_only: bool = False) -> DataFrame:
    """(kmer, cnt, minimizer, pos) of the reads' k-mers up to 31 bases, chosen on packed keys in the task that sums them."""
    k, size = config.k, config.minimizer
    names = ["kmer", "cnt", "minimizer", "pos"]
    table = reads.sparkSession.sparkContext.broadcast(rank_table(lmers, size))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, mask = table.value << 6, np.uint64(4**size - 1)  # below 2**24 before, and a place is below 2**6
        for keys, sums in _summed_runs(batches):
            best = ranks[keys >> np.uint64(2 * (k - size)) & mask]
            for j in range(1, k - size + 1):
                np.minimum(best, ranks[keys >> np.uint64(2 * (k - size - j)) & mask] | np.int32(j), out=best)
            pos = best & 63
            chosen = keys >> (2 * (k - size - pos)).astype(np.uint64) & mask
            yield pa.RecordBatch.from_arrays([spelled(keys, k), pa.array(sums), spelled(chosen, size), pa.array(pos)], names)

    return _runs_by_share(reads, config, bases_only).mapInArrow(rows, "kmer string, cnt long, minimizer string, pos int")


def runs_of_one_minimizer(reads: DataFrame, lmers: DataFrame, config: AssemblyConfig) -> DataFrame:
    """(minimizer, run, times): neighbouring k-mers with the same minimizer in the same place as one string of digits.

    Equal runs of a batch are one row with their number.
    """
    if config.alphabet != "strict":
        raise ValueError("runs need windows that share their bases, so the strict alphabet")
    k, size = config.k, config.minimizer
    table = reads.sparkSession.sparkContext.broadcast(rank_table(lmers, size))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bases in _slices(batches, "strict"):
            codes = bases.packed(size)[1].astype(np.int64) & (4**size - 1)
            at = bases.starts(k)
            if not len(at):
                continue
            best = _rarest(table.value[codes], k - size + 1)[at]
            # A window of one stretch never starts right after one of the stretch before.
            first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(best) != 0)])
            last = np.append(first[1:], len(at)) - 1
            begin, end = at[first], at[last] + k
            lengths = end - begin
            offsets = np.r_[0, np.cumsum(lengths)]
            data = bases.inner[np.repeat(begin - offsets[:-1], lengths) + np.arange(offsets[-1])] + np.uint8(ord("0"))
            run = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            rows = pa.table({"minimizer": pa.array(codes[best[first]].astype(np.int32)), "run": run}).group_by(["minimizer", "run"]).aggregate([([], "count_all")])
            rows = rows.select(["minimizer", "run", "count_all"]).rename_columns(["minimizer", "run", "times"])
            yield from rows.set_column(1, "run", rows["run"].cast(pa.string())).to_batches()

    pieces = reads.select(F.explode(S.pieces(clean(F.col("seq")), k, 1 << 13)).alias("seq"))
    return pieces.mapInArrow(split, "minimizer int, run string, times long")


def counts_by_runs(reads: DataFrame, lmers: DataFrame, config: AssemblyConfig) -> DataFrame:
    """(kmer, cnt): runs are exchanged by their minimizer, and taken apart where they arrive.

    A k-mer's minimizer follows from the k-mer, so all of its occurrences meet.
    """
    runs = runs_of_one_minimizer(reads, lmers, config).repartition("minimizer")
    rows = runs.select("minimizer", "times", F.explode(S.windows(F.col("run"), config.k)).alias("kmer"))
    return rows.groupBy("minimizer", "kmer").agg(F.sum("times").alias("cnt")).select("kmer", "cnt")
