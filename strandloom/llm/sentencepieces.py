"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

Texts are cut before each run of blanks (no piece crosses such a place), distinct
words are encoded once, and a worker keeps their ids.  Words that are new are
grouped by length: words of one length advance together, position by position;
hashes of all substrings that end there probe the sorted keys of the pieces, and a
vectorised maximum over the piece lengths stores score and backpointer.

The best path has the highest sum of piece scores; of equal paths the one whose
last piece is longest.  Characters without a piece become byte pieces.  That is
right for unigram models.  A model trained for merges has ranks for scores, and
its ids follow the order of merges, which no sum of scores gives; for such models
``MergeCoder`` lets the words of one length advance together in the same way,
probes the same keys with the hashes of adjacent pairs, and takes the vectorised
maximum as the next merge.  ``search="auto"`` goes by the model's own type.

Defined results: a null or empty text has no ids and decodes to an empty text;
U+2581 in a text decodes to a blank, as with the library; repeated rows give equal
ids; other columns are ignored; a very long text is worked through whole, and an
unbroken word in it takes n log n steps; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from . import textkernels as K
from .wordpieces import CHUNK, SpanCache

BLANK = 0x2581
LONG_WORD = 512  # longer words are merged one by one
_cache: dict = {}


class PieceTable:
    """Pieces of a model: sorted hashes with ids and scores, byte pieces and texts."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        normal = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        names = [sp.id_to_piece(i) for i in normal]
        lengths = np.array([len(x) for x in names])
        offs = np.concatenate(([0], np.cumsum(lengths)))
        codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        keys = K.SpanHash(codes)(offs[:-1], offs[1:])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, np.uint32)[order]
        self.scores = np.array([sp.get_score(i) for i in normal])[order]
        self.longest = int(lengths.max())
        self.unknown_score = self.scores.min() - 10.0
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        texts = [b""] * n
        for i, name in zip(normal, names):
            texts[i] = name.replace(chr(BLANK), " ").encode()
        for b, i in enumerate(self.byte_ids):
            texts[i] = bytes([b])
        self.text_size = np.array([len(x) for x in texts], np.int64)
        self.text_first = np.cumsum(self.text_size) - self.text_size
        self.text = np.frombuffer(b"".join(texts), np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the sorted keys, or -1."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code matrix) for the words of each length, in blocks."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths[lengths > 0]):
        where = np.flatnonzero(lengths == n)
        step = max(1, 400_000 // int(n))
        for lo in range(0, len(where), step):
            at = where[lo : lo + step]
            codes = np.frombuffer("".join(words[i] for i in at.tolist()).encode("utf-32-le"), np.uint32)
            yield at, codes.reshape(len(at), n)


def _spread(table: PieceTable, words: list[str], found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    """Ids end to end, in word order, from (word, position, id, code) of single pieces; id 0 marks bytes to come."""
    if not found:
        return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
    word, position, ids, codes = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((position, word))
    word, ids, codes = word[order], ids[order], codes[order]
    size = np.ones(len(ids), np.int64)
    odd = ids == 0
    if odd.any():
        size[odd] = 1 + (codes[odd] >= 0x80) + (codes[odd] >= 0x800) + (codes[odd] >= 0x10000).astype(np.int64)
    out = np.repeat(ids, size)
    if odd.any():
        raw = np.frombuffer(codes[odd].tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(odd, size)] = table.byte_ids[raw]
    return out, np.bincount(word, size, len(words)).astype(np.int64)


class ViterbiCoder(SpanCache):
    """Best paths of new words over the pieces' scores."""

    def __init__(self, table: PieceTable, limit: int = 1_000_000):
        self.table = table
        super().__init__(limit)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for at, codes in _by_length(words):
            ids, start = self.best_paths(codes)
            end = np.full(len(at), codes.shape[1])
            live = np.arange(len(at))
            while len(live):
                e = end[live]
                s = start[live, e]
                found.append((at[live], s, ids[live, e], codes[live, s]))
                end[live] = s
                live = live[s > 0]
        return _spread(self.table, words, found)

    def best_paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word and end position: id of the best path's last piece (0: bytes) and its start."""
        table = self.table
        n, length = codes.shape
        span = K.SpanHash(np.ascontiguousarray(codes).ravel())
        row = np.arange(n) * length
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        start = np.zeros((n, length + 1), np.int64)
        last = np.zeros((n, length + 1), np.uint32)
        for end in range(1, length + 1):
            for size in range(min(table.longest, end), 0, -1):
                piece = table.find(span(row + end - size, row + end))
                known = piece >= 0
                score = np.where(known, table.scores[piece], -np.inf if size > 1 else table.unknown_score) + best[:, end - size]
                better = score > best[:, end]
                best[better, end] = score[better]
                start[better, end] = end - size
                last[better, end] = np.where(known, table.ids[piece], 0)[better]
        return last, start


class MergeCoder(SpanCache):
    """Merge order of the model: in each word the adjacent pair of highest score joins, leftmost first."""

    def __init__(self, table: PieceTable, limit: int = 1_000_000):
        self.table = table
        super().__init__(limit)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        for i in long:
            codes = np.frombuffer(words[i].encode("utf-32-le"), np.uint32)
            first, piece = self._merged(codes)
            found.append((np.full(len(first), i), first, np.where(piece >= 0, self.table.ids[piece], 0), codes[first]))
        if long:
            words_here = ["" if len(w) > LONG_WORD else w for w in words]
        for at, codes in _by_length(words_here if long else words):
            n, length = codes.shape
            flat = np.ascontiguousarray(codes).ravel()
            span = K.SpanHash(flat)
            row = np.arange(n)[:, None] * length
            edge = np.arange(length + 1) + np.zeros((n, 1), np.int64)  # symbol i spans edge[i]..edge[i+1]
            count = np.full(n, length)
            live = np.arange(n)
            pair = self._scores(span, row + edge[:, :-2], row + edge[:, 2:]) if length > 1 else np.zeros((n, 0))
            while len(live) and pair.shape[1]:
                top = pair[live].argmax(axis=1)
                live, top = live[pair[live, top] > -np.inf], top[pair[live, top] > -np.inf]
                if not len(live):
                    break
                wide = np.arange(length + 1)
                moved = wide + (wide > top[:, None])
                edge[live] = np.take_along_axis(edge[live], np.minimum(moved, length), axis=1)
                wide = np.arange(length - 1)
                moved = np.minimum(wide + (wide > top[:, None]), length - 2)
                shifted = np.take_along_axis(pair[live], moved, axis=1)
                count[live] -= 1
                shifted[wide >= (count[live] - 1)[:, None]] = -np.inf
                pair[live] = shifted
                for side in (top - 1, top):
                    ok = (side >= 0) & (side < count[live] - 1)
                    w, s = live[ok], side[ok]
                    pair[w, s] = self._scores(span, w * length + edge[w, s], w * length + edge[w, s + 2])
            inside = np.arange(length) < count[:, None]
            w, s = np.nonzero(inside)
            first, after = edge[w, s], edge[w, s + 1]
            piece = self.table.find(span(w * length + first, w * length + after))
            found.append((at[w], first, np.where(piece >= 0, self.table.ids[piece], 0), flat[w * length + first]))
        return _spread(self.table, words, found)

    def _merged(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, rows of pieces) of one long word: pairs wait in a heap, so the work is n log n in its length."""
        n, span, find, scores = len(codes), K.SpanHash(codes), self.table.find, self.table.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at = np.arange(n - 1)
        piece = find(span(at, at + 2))
        waiting = [(-float(scores[p]), i, i + 2) for i, p in zip(at[piece >= 0].tolist(), piece[piece >= 0].tolist())]
        heapq.heapify(waiting)
        here = [True] * n
        while waiting:
            _, i, end = heapq.heappop(waiting)
            if not here[i] or after[i] >= n or after[after[i]] != end:  # a part has joined another since
                continue
            middle = after[i]
            here[middle], after[i] = False, end
            if end < n:
                before[end] = i
            pairs = [(s, after[e]) for s, e in ((before[i], i), (i, end)) if s >= 0 and e < n and after[e] - s <= self.table.longest]
            if pairs:
                starts, ends = np.array(pairs).T
                piece = find(span(starts, ends))
                for (s, e), p in zip(pairs, piece.tolist()):
                    if p >= 0:
                        heapq.heappush(waiting, (-float(scores[p]), s, e))
        first = np.flatnonzero(here)
        return first, find(span(first, np.array(after)[first]))

    def _scores(self, span, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        short = end - start <= self.table.longest
        out = np.full(start.shape, -np.inf)
        piece = self.table.find(span(start[short], end[short]))
        out[short] = np.where(piece >= 0, self.table.scores[piece], -np.inf)
        return out


def model_search(path: str) -> str:
    """The search that gives a model's own ids."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        return "viterbi" if sentencepiece_model_pb2.ModelProto.FromString(f.read()).trainer_spec.model_type == 1 else "merges"


def coder(path: str, search: str) -> SpanCache:
    key = (path, search)
    if key not in _cache:
        table = _cache.setdefault(path, PieceTable(path))
        kind = model_search(path) if search == "auto" else search
        _cache[key] = {"viterbi": ViterbiCoder, "merges": MergeCoder}[kind](table)
    return _cache[key]


def encode_column(column, path: str, search: str) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(row, ids, decoded bytes) of each text of an Arrow string column, in order."""
    words = coder(path, search)
    buf, byte_offs = K.utf8_column(column)
    for lo, hi in K.chunks(byte_offs, CHUNK):
        part = buf[byte_offs[lo] : byte_offs[hi]]
        at = byte_offs[lo : hi + 1] - byte_offs[lo]
        plain = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=lead[1:])
        offs = lead[at]
        full = np.diff(offs) > 0
        codes = np.insert(plain, offs[:-1][full], np.uint32(BLANK))  # the blank before each text
        codes[codes == 32] = BLANK
        offs = offs + np.concatenate(([0], np.cumsum(full)))
        blank = codes == BLANK
        first = np.zeros(len(codes) + 1, dtype=bool)
        first[offs] = True
        start = first[:-1].copy()
        start[1:] |= blank[1:] & ~blank[:-1]
        starts = np.flatnonzero(start)
        ids, total = words.lookup(codes.tobytes().decode("utf-32-le"), codes, starts)
        bounds = total[np.searchsorted(starts, offs)]
        decoded, ends = decode(words.table, ids)
        ends = np.concatenate(([0], ends))[bounds]
        for i in range(hi - lo):
            yield lo + i, ids[bounds[i] : bounds[i + 1]], decoded[ends[i] + 1 : ends[i + 1]].tobytes() if full[i] else b""


def decode(table: PieceTable, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the pieces end to end, and where each piece's bytes end."""
    size = table.text_size[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return table.text[np.repeat(table.text_first[ids] - (ends - size), size) + np.arange(total)], ends


def encode_documents(docs: DataFrame, path: str, search: str = "auto") -> DataFrame:
    """(doc_id, ids, n_pieces, ids_crc32, decoded_sha256, round_trip) of every text.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit numbers.
    """
    schema = StructType(
        [
            StructField("doc_id", docs.schema["doc_id"].dataType),
            StructField("ids", ArrayType(IntegerType())),
            StructField("n_pieces", LongType()),
            StructField("ids_crc32", LongType()),
            StructField("decoded_sha256", StringType()),
            StructField("round_trip", BooleanType()),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.utf8_column(batch.column(1))
            rows, first = [], 0
            for i, ids, text in encode_column(batch.column(1), path, search):
                original = buf[offs[i] : offs[i + 1]].tobytes()
                rows.append((ids.astype(np.int32), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(text).hexdigest(), text == original))
                if len(rows) >= 1000 or i + 1 == len(batch):
                    ids_, n, crc, sha, same = zip(*rows)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate(ids_)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(rows)), lists, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)],
                        schema.names,
                    )
                    rows, first = [], i + 1

    return docs.select("doc_id", "text").mapInArrow(encode, schema)
