"""Language-model scoring with an Elias-Fano n-gram trie.

All words, pairs and triples of the training documents are in the model, however rare.

1. Texts are tokenised once, into spans of many documents: the words of a span by
   64-bit hash, and its tokens as numbers of those, in a file of the shared folder.  A
   span holds training documents or held-out ones.
2. Words of all spans, with their training counts, are dealt by ranges of their hash.
   A task adds up the counts of its range and writes level 1: the sorted hashes as an
   Elias-Fano sequence, with exact counts.  The most frequent words of each range, up to
   ``numbered`` in all, also get numbers, which only make what follows shorter: other
   words go by their hash.
3. Distinct triples of each span are dealt by ranges of their first and second word's
   hashes, so that one frequent first word is spread over several tasks.  A task adds up
   its range and writes levels 2 and 3: Elias-Fano pointers from each context to its
   successors, the successors as a monotone Elias-Fano sequence relative to the last
   value of the context before, and a byte each for the quantised shares and weights.
4. In the same tasks the spans' words, pairs and triples are looked up in the files
   just written, memory-mapped: a context's range by its pointers, the word by successor
   search in that range.  Only the found bytes go back, to the spans, which add up.

So no task opens more of the model than its own range, and what is dealt are packed
blocks, one a span and range.  Smoothing, with counts c:

    p(w)      = (c(w) + 1) / (N + V + 1)
    p(w|v)    = (c(vw) + prior * p(w)) / (c(v) + prior)
    p(w|u,v)  = (c(uvw) - discount) / c(uv) + discount * kinds(uv) / c(uv) * p(w|v)

each of which sums to one over the words seen and one unseen word.  A token takes the
longest context that it has in its document and that was seen.  Stored values are
quantised to ``step`` in log10.

Defined results: a null or empty text is the end token alone; without any training
document, N = V = 0 and both scores are 0; words are compared by 64-bit hash;
repeated rows score alike; other columns are ignored; a very long text is a span of
its own, so a task's memory follows the longest text; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from . import textkernels as K
from .eliasfano import EliasFano
from .storage import shared_dir, written

#: Hash of the end token; hashes of words are never changed into it on purpose.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
NONE = 255  # code of what the model does not hold
BLOCK = "range long, span long, held boolean, block binary"
ANSWER = "span long, level int, range long, n long, tokens long, block binary"


@dataclass(frozen=True)
class LmConfig:
    discount: float = 0.75
    prior: float = 5.0
    step: float = 0.05  # of the quantised log10 values
    span_bytes: int = 12 << 20
    range_rows: int = 4_000_000  # tokens for each range of triples
    numbered: int = 1 << 20  # words that have short numbers: 8 MB in a task, at any size
    folds: int = 7
    held_out: int = 2


@dataclass
class NgramModel:
    """Where the files of a model lie, how its ranges are cut, and its totals."""

    config: LmConfig
    path: str
    first_bits: int
    second_bits: int
    n_tokens: int = 0
    n_words: int = 0

    def number_words(self, frequent: np.ndarray) -> None:
        """Keep hashes of words by falling frequency: word i gets number i + 1."""
        save_arrays(f"{self.path}/numbered", {"words": frequent, "order": np.argsort(frequent)})

    @contextmanager
    def numbered(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes by number, their ascending order)."""
        with mapped_arrays(f"{self.path}/numbered") as a:
            yield a["words"], a["order"]


# ---- packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays in their least width, by byte planes, compressed."""
    out = []
    for a in arrays:
        top = int(a.max(initial=0))
        kind = next(k for k in "BHIQ" if top < 1 << (8 * struct.calcsize("=" + k)))
        planes = np.ascontiguousarray(a.astype("=" + kind)).view(np.uint8).reshape(len(a), struct.calcsize("=" + kind)).T
        data = pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)
        out.append(struct.pack("=cqq", kind.encode(), len(a), len(data)) + data)
    return b"".join(out)


def unpack(block: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(block):
        kind, n, size = struct.unpack_from("=cqq", block, at)
        at += struct.calcsize("=cqq")
        width = struct.calcsize("=" + kind.decode())
        raw = pa.decompress(block[at : at + size], n * width, codec="zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view("=" + kind.decode()).ravel())
        at += size
    return out


# ---- files


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def save_bytes(path: str, *parts: bytes) -> None:
    """Write a file: to a temporary name first, then moved."""
    files, at = _open(path)
    files.create_dir(os.path.dirname(at), recursive=True)
    task = TaskContext.get()
    temporary = f"{at}.{task.taskAttemptId() if task else 0}"
    with files.open_output_stream(temporary) as f:
        for x in parts:
            f.write(x)
    files.move(temporary, at)


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one file, for mapping."""
    head, offset = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), offset)
        offset += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    save_bytes(path, struct.pack("=q", len(text)) + text, *(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 64) for a in arrays.values()))


@contextmanager
def mapped_arrays(path: str) -> Iterator[dict[str, np.ndarray]]:
    """Memory-mapped arrays of a file; a file of a remote store is fetched for as long as it is open."""
    files, at = _open(path)
    local = tempfile.TemporaryDirectory(prefix="strandloom-lm-")
    with local:
        if not isinstance(files, fs.LocalFileSystem):
            copy = os.path.join(local.name, "arrays")
            with files.open_input_stream(at) as f, open(copy, "wb") as g:
                shutil.copyfileobj(f, g)
            at = copy
        whole = np.memmap(at, np.uint8, "r").view(np.ndarray)
        n = 8 + int(whole[:8].view(np.int64)[0])
        yield {k: whole[n + o : n + o + size * np.dtype(d).itemsize].view(d) for k, (d, size, o) in json.loads(whole[8:n].tobytes()).items()}


def _saved(path: str) -> bool:
    files, at = _open(path)
    return files.get_file_info(at).type == fs.FileType.File


# ---- spans


def token_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with each document's end, and where documents begin."""
    hashes, bounds = [], [np.zeros(1, np.int64)]
    total = 0
    for lo, hi in K.chunks(offs):
        part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, word_offs = K.split_words(part, at)
        h = K.SpanHash(K.LOWER[part])(starts, ends)
        hashes.append(np.insert(h, word_offs[1:], END))
        bounds.append(total + word_offs[1:] + np.arange(1, hi - lo + 1))
        total += len(hashes[-1])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(bounds)


def token_spans(docs: DataFrame, config: LmConfig, folds: bool) -> DataFrame:
    """(span, held, tokens, docs, file) of many documents each; without ``folds`` all are held out."""
    path = shared_dir(docs.sparkSession, "token-spans")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(config.folds))
    rows = docs.select("doc_id", "text", (fold == config.held_out).alias("fold"), F.lit(not folds).alias("all"))
    kind = docs.schema["doc_id"].dataType
    doc = StructType([StructField("doc_id", kind), StructField("held_out", BooleanType())])
    schema = StructType([StructField("span", LongType()), StructField("held", BooleanType()), StructField("tokens", LongType()), StructField("docs", ArrayType(doc)), StructField("file", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().taskAttemptId() << 24  # a file belongs to one attempt
        for batch in batches:
            fold = batch.column(2)
            held = np.asarray(fold.to_numpy(zero_copy_only=False), bool) | np.asarray(batch.column(3).to_numpy(zero_copy_only=False), bool)
            for side in (False, True):
                own = batch.filter(pa.array(held == side))
                buf, offs = K.utf8_column(own.column(1))
                for lo, hi in K.chunks(offs, config.span_bytes):
                    hashes, bounds = token_hashes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    words, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
                    order = np.argsort(-n, kind="stable")  # frequent words get small numbers
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    of = pa.StructArray.from_arrays([own.column(0).slice(lo, hi - lo), own.column(2).slice(lo, hi - lo)], ["doc_id", "held_out"])
                    lists = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), of)
                    save_bytes(f"{path}/{number}", pack(np.diff(bounds), words[order], rank[at]))
                    columns = [pa.array([number]), pa.array([side]), pa.array([len(hashes)]), lists, pa.array([f"{path}/{number}"])]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
                    number += 1

    return rows.mapInArrow(run, schema)


class Span:
    """The distinct words of a span, by ascending hash, and its distinct pairs and triples."""

    def __init__(self, path: str):
        files, at = _open(path)
        with files.open_input_stream(at) as f:
            lengths, words, tokens = unpack(f.read())
        self.bounds = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.tokens = words[order].astype(np.uint64), rank[tokens]

    def triples(self, model: NgramModel, inverse: bool) -> None:
        """Sets first, second (of pairs), pair_range, size (triples a pair), third and count, ordered by range.

        A pair at a document's end has a triple with 0 as third; other thirds are word
        numbers plus 1.  With ``inverse``: at, pair_of and triple_of, the positions of
        pairs' first tokens and what stands there.
        """
        t, last = self.tokens, np.zeros(len(self.tokens), dtype=bool)
        last[self.bounds[1:] - 1] = True
        at = np.flatnonzero(~last)
        third = np.where(last[at + 1], 0, t[np.minimum(at + 2, len(t) - 1)] + 1).astype(np.uint64)
        bits = np.uint64(max(1, len(self.words).bit_length()))
        pair = (t[at].astype(np.uint64) << bits) | t[at + 1].astype(np.uint64)
        numbered = None
        if 3 * int(bits) > 64:  # very many words: number the pairs first
            numbered, pair = np.unique(pair, return_inverse=True)
            pair = pair.astype(np.uint64)
        key = (pair << bits) | third
        if inverse:
            key, triple_of, count = np.unique(key, return_inverse=True, return_counts=True)
        else:
            key, count = np.unique(key, return_counts=True)
        pair = key >> bits
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        own = pair[first] if numbered is None else numbered[pair[first].astype(np.int64)]
        a, b = (own >> bits).astype(np.int64), (own & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        in_range = _top(self.words[a], model.first_bits) << model.second_bits | _top(self.words[b], model.second_bits)
        by = np.argsort(in_range, kind="stable")
        moved = np.repeat(first[by], size[by]) + _within(size[by])
        self.first, self.second, self.pair_range, self.size = a[by], b[by], in_range[by], size[by]
        self.third, self.count = (key[moved] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), count[moved]
        if inverse:
            place = np.empty(len(moved), np.int64)
            place[moved] = np.arange(len(moved))
            self.at, self.triple_of = at, place[triple_of]
            self.pair_of = np.repeat(np.arange(len(size)), self.size)[self.triple_of]


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _slices(ranges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of ascending range numbers."""
    first = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(ranges) else np.zeros(0, np.int64)
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(ranges)).tolist()):
        yield int(ranges[lo]), lo, hi


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    of = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(columns, kinds)], list(names))


def _few(spans: DataFrame) -> DataFrame:
    """The rows of the spans' small table over as many tasks as there are."""
    return spans.repartition(max(1, min(spans.count(), 10_000)), "span")


def word_blocks(spans: DataFrame, model: NgramModel) -> DataFrame:
    """Blocks of the spans' words, by range of hash: steps between the hashes, and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held, file in zip(*(c.to_pylist() for c in batch.columns)):
                span = Span(file)
                count = np.bincount(span.tokens, minlength=len(span.words)) * (not held)
                found = _slices(_top(span.words, model.first_bits))
                yield _rows([(k, number, held, pack(np.diff(span.words[lo:hi], prepend=np.uint64(0)), count[lo:hi])) for k, lo, hi in found], BLOCK)

    return _few(spans).select("span", "held", "file").mapInArrow(run, BLOCK)


def triple_blocks(spans: DataFrame, model: NgramModel) -> DataFrame:
    """Blocks of the spans' distinct triples, by range: hashes of words without numbers, then pairs and triples.

    Word i of those hashes goes by the number of numbered words plus i + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model.numbered() as (frequent, order):
            for batch in batches:
                for number, held, file in zip(*(c.to_pylist() for c in batch.columns)):
                    span = Span(file)
                    span.triples(model, inverse=False)
                    edges = np.concatenate(([0], np.cumsum(span.size)))
                    code = np.zeros(len(span.words) + 1, np.int64)  # 0: no third word
                    if len(frequent):
                        at = order[np.minimum(np.searchsorted(frequent, span.words, sorter=order), len(order) - 1)]
                        code[1:] = np.where(frequent[at] == span.words, at + 1, 0)
                    rare, out = np.flatnonzero(code[1:] == 0), []
                    for k, lo, hi in _slices(span.pair_range):
                        first, second, third = span.first[lo:hi], span.second[lo:hi], span.third[edges[lo] : edges[hi]]
                        used = np.zeros(len(code), dtype=bool)
                        for x in (first + 1, second + 1, third):
                            used[x] = True
                        own = rare[used[rare + 1]]
                        code[own + 1] = len(frequent) + 1 + np.arange(len(own))
                        count = span.count[edges[lo] : edges[hi]] * (not held)
                        out.append((k, number, held, pack(span.words[own], code[first + 1], code[second + 1], span.size[lo:hi], code[third], count)))
                    yield _rows(out, BLOCK)

    return _few(spans).select("span", "held", "file").mapInArrow(run, BLOCK)


def _each_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(range, its blocks (span, held, block)) of batches that are sorted by range."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        for k, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if k != at and held:
                yield at, held
                held = []
            at = k
            held.append(tuple(rest))
    if held:
        yield at, held


# ---- levels


def _code(log10: np.ndarray, step: float) -> np.ndarray:
    return np.clip(np.rint(log10 / -step), 0, NONE - 1).astype(np.uint8)


def _shares(codes: np.ndarray, step: float) -> np.ndarray:
    return np.where(codes == NONE, 0.0, 10.0 ** (codes.astype(np.float64) * -step))


def _monotone(context: np.ndarray, word: np.ndarray, contexts: int) -> dict[str, np.ndarray]:
    """Pointers and successors of n-grams sorted by context and word, each context's from the last value of the one before."""
    first = np.searchsorted(context, np.arange(contexts + 1))
    starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(word)) - 1
    base = np.concatenate(([0], np.cumsum(word[ends] + 1)))[:-1] if len(word) else np.zeros(0, np.int64)
    return EliasFano.encode(first, "p_") | EliasFano.encode(np.repeat(base, np.diff(np.append(starts, len(word)))) + word + 1, "s_")


def _successor(arrays: dict[str, np.ndarray], level: str, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Index of each (context, word) in a level, or -1; contexts ascend, -1 is none."""
    view = {k[2:]: a for k, a in arrays.items() if k.startswith(level)}
    pointers, successors = EliasFano(view, "p_"), EliasFano(view, "s_")
    out = np.full(len(context), -1, np.int64)
    try_ = np.flatnonzero(context >= 0)
    if not len(try_) or not successors.n:
        return out
    own, of = np.unique(context[try_], return_inverse=True)
    edges = np.unique(np.concatenate((own, own + 1)))
    ends = pointers.values(edges).astype(np.int64)
    spot = np.searchsorted(edges, own)
    first, after = ends[spot], ends[spot + 1]
    base = np.zeros(len(own), np.uint64)
    later = first > 0
    base[later] = successors.values(first[later] - 1)
    some = (first < after)[of]
    try_, of = try_[some], of[some]
    out[try_] = successors.find(base[of] + word[try_].astype(np.uint64) + np.uint64(1), first[of], after[of])
    return out


def _renumbered(code: np.ndarray, numbered: int, rare: np.ndarray) -> np.ndarray:
    """Numbers of a block's words in its range: those beyond the numbered ones by ``rare``."""
    code = code.astype(np.int64)
    own = np.flatnonzero(code > numbered)
    code[own] = rare[code[own] - numbered - 1]
    return code


def word_answers(blocks: DataFrame, model: NgramModel, build: bool, answer: bool) -> DataFrame:
    """Level 1: training counts of the words of each block; files are written with ``build``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << (64 - model.first_bits)) - 1)
        top = max(1, model.config.numbered >> model.first_bits)
        for k, blocks in _each_range(batches):
            parts = [unpack(b) for *_, b in blocks]
            words = [np.cumsum(steps.astype(np.uint64), dtype=np.uint64) for steps, _ in parts]
            path, n, tokens = f"{model.path}/words/{k}", 0, 0
            if build:
                own, at = np.unique(np.concatenate(words), return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, at, np.concatenate([c for _, c in parts]).astype(np.int64))
                own, total = own[total > 0], total[total > 0]
                n, tokens = len(own), int(total.sum())
                save_arrays(path, EliasFano.encode(own & mask) | {"counts": total.astype(np.uint64)})
                often = np.sort(np.argpartition(total, -top)[-top:]) if top < n else np.arange(n)
                yield _rows([(-1, 1, k, n, tokens, pack(own[often], total[often]))], ANSWER)
            if answer and (build or _saved(path)):
                with mapped_arrays(path) as level:
                    sequence = EliasFano(level)
                    for (span, *_), w in zip(blocks, words):
                        at = sequence.find(w & mask)
                        count = np.where(at >= 0, level["counts"][np.maximum(at, 0)] if sequence.n else 0, 0)
                        yield _rows([(span, 1, k, None, None, pack(count))], ANSWER)
                    del sequence, level

    return _by_range(blocks, 1 << model.first_bits).mapInArrow(run, ANSWER)


def _by_range(blocks: DataFrame, ranges: int) -> DataFrame:
    return blocks.repartition(ranges, "range").sortWithinPartitions("range")


def triple_answers(blocks: DataFrame, model: NgramModel, build: bool, answer: bool) -> DataFrame:
    """Levels 2 and 3: codes of the pairs' shares and weights and the triples' shares of each block."""
    step, config = model.config.step, model.config

    def levels(parts: list[list[np.ndarray]], hashes: np.ndarray, k: int) -> dict[str, np.ndarray]:
        """Arrays of a range from (first, second, size, third, count) of its training blocks, and the hashes of words."""
        bits = np.uint64(max(1, len(hashes).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        pairs = [(p[0].astype(np.uint64) << bits) | p[1].astype(np.uint64) for p in parts]
        known = np.unique(np.concatenate(pairs))
        context = np.concatenate([np.repeat(np.searchsorted(known, x), p[2]) for x, p in zip(pairs, parts)]).astype(np.uint64)
        key = (context << bits) | np.concatenate([p[3] for p in parts]).astype(np.uint64)
        del pairs, context
        order = np.argsort(key)
        key, n = key[order], np.concatenate([p[4] for p in parts]).astype(np.int64)[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        n, key = np.add.reduceat(n, starts) if len(starts) else n, key[starts]
        context, third = (key >> bits).astype(np.int64), (key & low).astype(np.int64)
        kinds = np.bincount(context, minlength=len(known))
        total = np.add.reduceat(n, np.cumsum(kinds) - kinds) if len(n) else n
        first, second = (known >> bits).astype(np.int64), (known & low).astype(np.int64)
        own, of = np.unique(first, return_inverse=True)
        with mapped_arrays(f"{model.path}/words/{k >> model.second_bits}") as level:
            found = EliasFano(level).find(hashes[own - 1] & np.uint64((1 << (64 - model.first_bits)) - 1))
            count = level["counts"][found][of].astype(np.float64) if len(found) else np.zeros(0)
        out = {"2_" + a: v for a, v in _monotone(of, second, len(own)).items()} | {"3_" + a: v for a, v in _monotone(context, third, len(known)).items()}
        out |= {"share2": _code(np.log10(total / (count + config.prior)), step), "weight3": _code(np.log10(config.discount * kinds / total), step)}
        return out | EliasFano.encode(own, "f_") | {"share3": _code(np.log10((n - config.discount) / total[context]), step)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with model.numbered() as (frequent, _):
            for k, blocks in _each_range(batches):
                yield from answers(k, blocks, frequent)

    def answers(k: int, blocks: list[tuple], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
        path, n = f"{model.path}/triples/{k}", len(frequent)
        learn = [b for _, held, b in blocks if not held]
        if build and learn:
            parts = [unpack(b) for b in learn]
            rare = np.unique(np.concatenate([p[0] for p in parts])).astype(np.uint64)
            for p in parts:
                own = np.searchsorted(rare, p[0].astype(np.uint64)) + n + 1
                p[:] = _renumbered(p[1], n, own), _renumbered(p[2], n, own), p[3], _renumbered(p[4], n, own).astype(np.uint32), p[5]
            save_arrays(path, levels(parts, np.append(frequent, rare), k) | EliasFano.encode(rare, "w_"))
            del parts
        if not answer or not _saved(path):
            return
        with mapped_arrays(path) as level:
            words, firsts = EliasFano(level, "w_"), EliasFano(level, "f_")
            for span, _, block in blocks:
                own, first, second, size, third, _n = unpack(block)
                found = words.find(own.astype(np.uint64))
                number = np.where(found >= 0, found + n + 1, -1)
                u, v, w = (_renumbered(x, n, number) for x in (first, second, third))
                u = np.where((u > 0) & (v > 0), firsts.find(np.maximum(u, 0).astype(np.uint64)), -1)
                pair = _successor(level, "2_", u, np.maximum(v, 0))
                at = _successor(level, "3_", np.where(w >= 0, np.repeat(pair, size), -1), np.maximum(w, 0))
                codes = [np.where(i >= 0, level[c][np.maximum(i, 0)], NONE).astype(np.uint8) for c, i in (("share2", pair), ("weight3", pair), ("share3", at))]
                yield _rows([(span, 2, k, None, None, pack(*codes))], ANSWER)

    return _by_range(blocks, 1 << (model.first_bits + model.second_bits)).mapInArrow(run, ANSWER)


# ---- the operator


def _new_model(spans: DataFrame, config: LmConfig, path: str | None) -> NgramModel:
    tokens = spans.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bits = max(4, (-(-tokens // config.range_rows) - 1).bit_length())
    return NgramModel(config, path or shared_dir(spans.sparkSession, "ngram-model"), bits - bits // 3, bits // 3)


def _totals(model: NgramModel, answers: DataFrame) -> None:
    """Sums over the ranges, and the numbers of frequent words: a bounded part of each range."""
    found = answers.where("span < 0").select("n", "tokens", "block").collect()
    model.n_words, model.n_tokens = sum(r.n for r in found), sum(r.tokens for r in found)
    parts = [unpack(bytes(r.block)) for r in found]
    words, count = (np.concatenate([np.zeros(0, np.uint64), *(p[j].astype(np.uint64) for p in parts)]) for j in range(2))
    model.number_words(words[np.argsort(-count.astype(np.int64), kind="stable")])


def train_ngram_model(docs: DataFrame, config: LmConfig = LmConfig(), path: str | None = None) -> NgramModel:
    """Learn from all documents outside the held-out fold; files go to the shared folder."""
    spans = written(token_spans(docs, config, folds=True).where("NOT held"), "token-spans")
    model = _new_model(spans, config, path)
    _totals(model, written(word_answers(word_blocks(spans, model), model, build=True, answer=False), "word-counts"))
    triple_answers(triple_blocks(spans, model), model, build=True, answer=False).count()
    return model


def score_documents(docs: DataFrame, model: NgramModel) -> DataFrame:
    """Token counts, base score and model score of every document by a model that is there."""
    spans = written(token_spans(docs, model.config, folds=False), "token-spans")
    words = word_answers(word_blocks(spans, model), model, build=False, answer=True)
    return _scored(docs, spans, words.unionByName(triple_answers(triple_blocks(spans, model), model, build=False, answer=True)), model)


def train_and_score(docs: DataFrame, config: LmConfig = LmConfig()) -> DataFrame:
    """The same with a model of the documents outside the held-out fold, whose ranges are asked as they are made."""
    spans = written(token_spans(docs, config, folds=True), "token-spans")
    model = _new_model(spans, config, None)
    words = written(word_answers(word_blocks(spans, model), model, build=True, answer=True), "word-counts")
    _totals(model, words)
    return _scored(docs, spans, words.where("span >= 0").unionByName(triple_answers(triple_blocks(spans, model), model, build=True, answer=True)), model)


def _scored(docs: DataFrame, spans: DataFrame, answers: DataFrame, model: NgramModel) -> DataFrame:
    step, config = model.config.step, model.config
    schema = StructType(
        [StructField("doc_id", docs.schema["doc_id"].dataType), StructField("held_out", BooleanType())]
        + [StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
        + [StructField(c, DoubleType()) for c in ("base_score", "score")]
    )
    answered = answers.groupBy("span").agg(F.collect_list(F.struct("level", "range", "block")).alias("answers"))
    rows = spans.select("span", "docs", "file").join(answered, "span", "left")

    def logs(file: str, found: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of documents; count, base and score of each token."""
        span = Span(file)
        got = {(a["level"], a["range"]): unpack(a["block"]) for a in found}
        count = np.zeros(len(span.words))
        for k, lo, hi in _slices(_top(span.words, model.first_bits)):
            if (1, k) in got:
                count[lo:hi] = got[1, k][0]
        p = ((count + 1) / (model.n_tokens + model.n_words + 1))[span.tokens]
        base = np.log10(p) if model.n_tokens else np.zeros(len(p))
        if not model.n_tokens:
            return span.bounds, count[span.tokens], base, base
        span.triples(model, inverse=True)
        edges = np.concatenate(([0], np.cumsum(span.size)))
        share2, weight3 = (np.full(len(span.size), NONE, np.uint8) for _ in range(2))
        share3 = np.full(len(span.third), NONE, np.uint8)
        for k, lo, hi in _slices(span.pair_range):
            if (2, k) in got:
                share2[lo:hi], weight3[lo:hi], share3[edges[lo] : edges[hi]] = got[2, k]
        at, before = span.at, count[span.tokens[span.at]]
        p[at + 1] = _shares(share2, step)[span.pair_of] + config.prior / (before + config.prior) * p[at + 1]
        inner = span.third[span.triple_of] > 0
        at, pair = at[inner], span.pair_of[inner]
        weight = np.where(weight3 == NONE, 1.0, _shares(weight3, step))
        p[at + 2] = _shares(share3, step)[span.triple_of[inner]] + weight[pair] * p[at + 2]
        return span.bounds, count[span.tokens], base, np.log10(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, offs = lists.flatten(), lists.offsets.to_pylist()
            for i, (own, found) in enumerate(zip(batch.column(1), batch.column(2))):
                bounds, *values = logs(own.as_py(), found.as_py() or [])
                sums = np.zeros((3, bounds[-1] + 1))
                for row, x in zip(sums, (values[0] > 0, *values[1:])):
                    np.cumsum(x, out=row[1:])
                known, base, score = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                doc = flat.slice(offs[i] - offs[0], len(bounds) - 1)
                n = pa.array(np.full(len(bounds) - 1, model.n_tokens, np.int64))
                columns = [doc.field(0), doc.field(1), pa.array(np.diff(bounds)), pa.array(known.astype(np.int64)), n, pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.select("docs", "file", "answers").mapInArrow(run, schema)
