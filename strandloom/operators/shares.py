"""Rounds of contraction, share by share.

Nodes are dealt out to ``SHARES`` shares by a hash of their keys.  A share's nodes lie in
pieces of files of the shared folder, each a map of nodes; a later piece goes before an
earlier one.  A round is one exchange of what contracted nodes tell their neighbours: a
task reads the shares that are told something, writes the nodes that it changed as a piece
more, and tells on what those of them do that have no greater neighbour now.  So a round's
work goes by the nodes that it reaches, and its plan is the same whatever came before.

Here a node is (prefixes, suffixes), lists in order of idx of extensions (seq, cnt, visit,
terminal), all texts as bytes.  A node that the next round contracts is kept as (round, node).
"""

from __future__ import annotations

import marshal
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

SHARES = 4096
#: Messages that a task holds before it hands them on.
HELD = 100_000
#: Later pieces of a share before they are put together.
PIECES = 8


def share_of(node: bytes) -> int:
    return crc32(node) % SHARES


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Pieces:
    """A file that a task appends pieces to; it is made with the first."""

    def __init__(self, folder: str):
        self.folder, self.name, self.out, self.at = folder, uuid.uuid4().hex, None, 0

    def add(self, value) -> tuple[str, int, int]:
        if self.out is None:
            system, path = opened(self.folder)
            system.create_dir(path, recursive=True)
            self.out = system.open_output_stream(f"{path}/{self.name}")
        data = compress(marshal.dumps(value, 2), 1)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class Reader:
    """Reads pieces; a file is opened once a task, and the last few stay open."""

    def __init__(self, folder: str):
        self.system, self.folder = opened(folder)
        self.files: dict[str, pa.NativeFile] = {}

    def get(self, piece: tuple[str, int, int]):
        name, at, size = piece
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.system.open_input_file(f"{self.folder}/{name}")
        return marshal.loads(decompress(self.files[name].read_at(size, at)))


#: Columns of an extension as tasks get it, its texts as bytes.
EXTENSION = ("node", "suffix", "seq", "cnt", "visit", "terminal")


def values(column: pa.Array) -> list:
    """The values of a column without nulls, as ``to_pylist`` gives them, in a fraction of its time."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not len(column):
        return []
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).tolist()
    data = column.buffers()[2].to_pybytes() if column.buffers()[2] is not None else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def dealt(ext: DataFrame, by: Column, name: str, parts: int) -> DataFrame:
    """Extensions as tasks get them, dealt out by a column and sorted by it, node, side and idx."""
    text = lambda c: F.col(c).cast("binary").alias(c)
    rows = ext.select(by.alias(name), text("node"), (F.col("side") == "S").alias("suffix"), "idx", text("seq"), "cnt", "visit", "terminal")
    return rows.repartition(parts, name).sortWithinPartitions(name, "node", "suffix", "idx").select(name, *EXTENSION)


def is_chosen(node: bytes, state) -> bool:
    """Whether no live extension leads to a greater node."""
    n, (prefixes, suffixes) = len(node), state
    for seq, _, _, terminal in prefixes:
        if not terminal and (seq + node)[:n] > node:
            return False
    return all(terminal or (node + seq)[-n:] <= node for seq, _, _, terminal in suffixes)


def ranked(side: list) -> list[int]:
    """Places of the extensions with flow, in order of visits, counts and idx."""
    flow = [i for i, e in enumerate(side) if e[2] > 0]
    return flow if len(flow) < 2 else sorted(flow, key=lambda i: (-side[i][2], -side[i][1], i))


def contracted(node: bytes, state, tell, partial: list) -> None:
    """What a contracted node tells its neighbours, as messages of ``tell``, and the contigs that it completes."""
    n, (prefixes, suffixes) = len(node), state
    order_p, order_s = ranked(prefixes), ranked(suffixes)
    i = j = at = p_from = s_from = 0
    while i < len(order_p) and j < len(order_s):
        p_idx = order_p[i]
        p_seq, p_cnt, p_visit, p_end = prefixes[p_idx]
        s_seq, s_cnt, s_visit, s_end = suffixes[order_s[j]]
        until = min(p_from + p_visit, s_from + s_visit)
        off_p, flow = at - p_from, until - at
        if p_end and s_end:
            partial.append(p_seq + node + s_seq)
        else:
            before, after, cnt = p_seq + node, node + s_seq, min(p_cnt, s_cnt)
            pred, succ = before[:n], after[-n:]
            if not p_end and pred != node:
                tell((pred, 1, node, p_idx, off_p, before[n:], s_seq, cnt, flow, s_end or succ == node))
            if not s_end and succ != node:
                tell((succ, 0, node, p_idx, off_p, after[: len(s_seq)], p_seq, cnt, flow, p_end or pred == node))
        at = until
        if until == p_from + p_visit:
            i, p_from = i + 1, until
        if until == s_from + s_visit:
            j, s_from = j + 1, until


def told(state, messages: list[tuple]) -> None:
    """Change a node by its messages, in order of side and arrival.

    The first of those for one live extension replaces it in place; all others are appended.
    """
    live: list[dict | None] = [None, None]
    for _, side, _, _, _, back, rest, cnt, visit, terminal in messages:
        rows = state[side]
        if live[side] is None:
            live[side] = {e[0]: i for i, e in enumerate(rows) if not e[3]}
        at = live[side].pop(back, None)
        new = (back + rest if side else rest + back, cnt, visit, terminal)
        if at is None:
            rows.append(new)
        else:
            rows[at] = new


class Outbox:
    """Messages by share; handed on as (share, bytes) when there are many."""

    def __init__(self):
        self.of, self.n, self.told = defaultdict(list), 0, 0

    def tell(self, message: tuple) -> None:
        self.of[share_of(message[0])].append(message)
        self.n += 1
        self.told += 1

    def handed_on(self, least: int = 0) -> Iterator[tuple[int, bytes]]:
        if self.n > least:
            for share, messages in self.of.items():
                yield share, compress(marshal.dumps(messages, 2), 1)
            self.of, self.n = defaultdict(list), 0


def settled(now: int, node: bytes, state, outbox: Outbox, partial: list):
    """A node as it is kept, after it has told its neighbours what follows if it is chosen."""
    kept = marshal.dumps(state, 2)
    if not is_chosen(node, state):
        return kept
    contracted(node, state, outbox.tell, partial)
    return now, kept


#: The key of a task's figures among its messages.
FIGURES = -1


def figures(partial: list, file: Pieces, outbox: Outbox, index: dict, **counts: int) -> tuple[int, bytes]:
    """What a task found: counts, its shares' pieces, and where the contigs that the round after it completes are."""
    where = file.add(partial) if partial else None
    file.close()
    return FIGURES, marshal.dumps(counts | {"index": index, "partial": where, "told": outbox.told}, 2)


def first_round(folder: str):
    """A function for ``mapInArrow`` over extensions sorted by share, node, side and idx."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, outbox, partial, index = Pieces(folder), Outbox(), [], {}
        share, node, states, rows, nodes, chosen = None, None, {}, 0, 0, 0
        state: tuple[list, list] = ([], [])

        def node_done() -> None:
            nonlocal chosen, nodes
            if node is not None:
                nodes += 1
                states[node] = kept = settled(0, node, state, outbox, partial)
                chosen += type(kept) is tuple

        def share_done() -> None:
            if states:
                index.setdefault(share, []).append(file.add(states))

        for batch in batches:
            rows += batch.num_rows
            for s, key, suffix, seq, cnt, visit, terminal in zip(*(values(batch.column(c)) for c in ("share", *EXTENSION))):
                if key != node:
                    node_done()
                    if s != share:
                        share_done()
                        share, states = s, {}
                    node, state = key, ([], [])
                state[suffix].append((seq, cnt, visit, terminal))
            yield _batch(outbox.handed_on(HELD))
        node_done()
        share_done()
        yield _batch(outbox.handed_on())
        yield _batch([figures(partial, file, outbox, index, nodes=nodes, rows=rows, chosen=chosen)])

    return run


def _batch(rows: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["share", "told"])


def next_round(folder: str, now: int, index, pieces: int):
    """A function for ``mapPartitions`` over (share, messages); ``index`` is a broadcast of each share's pieces."""

    def run(rows: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        inbox: dict[int, list[bytes]] = defaultdict(list)
        for share, data in rows:
            inbox[share].append(data)
        file, outbox, reader, partial, fresh = Pieces(folder), Outbox(), Reader(folder), [], {}
        nodes = written = chosen = 0
        for share, parts in inbox.items():
            messages = [m for data in parts for m in marshal.loads(decompress(data))]
            messages.sort()
            parts.clear()
            old = index.value.get(share, [])
            states: dict = {}
            for piece in old:
                states.update(reader.get(piece))
            changed, i = {}, 0
            while i < len(messages):
                node, j = messages[i][0], i + 1
                while j < len(messages) and messages[j][0] == node:
                    j += 1
                kept = states.get(node)
                if type(kept) is not bytes:
                    raise ValueError(f"no node for a transfer to {node.decode()}")
                state = marshal.loads(kept)
                told(state, messages[i:j])
                changed[node] = kept = settled(now, node, state, outbox, partial)
                nodes, written, chosen, i = nodes + 1, written + len(state[0]) + len(state[1]), chosen + (type(kept) is tuple), j
            fresh[share] = _pieces_after(old, states, changed, file, reader, now, pieces)
            yield from outbox.handed_on(HELD)
        yield from outbox.handed_on()
        yield figures(partial, file, outbox, fresh, nodes=nodes, rows=written, chosen=chosen)

    return run


def _pieces_after(old: list, states: dict, changed: dict, file: Pieces, reader: Reader, now: int, pieces: int) -> list:
    """A share's pieces with the changed nodes as one more.

    Later pieces are put together when they are many, and with the first, without the nodes
    that are gone, when they have grown as large as it is.
    """
    if old and sum(p[2] for p in old[1:]) > old[0][2]:
        states.update(changed)
        return [file.add({k: v for k, v in states.items() if type(v) is bytes or v[0] == now})]
    if len(old) > pieces:
        later: dict = {}
        for piece in old[1:]:
            later.update(reader.get(piece))
        for k, v in later.items():
            if type(v) is tuple:
                later[k] = (v[0], b"")
        later.update(changed)
        return [old[0], file.add(later)]
    return [*old, file.add(changed)]


def extensions(folder: str, now: int):
    """A function for ``mapInArrow`` over (pieces) of shares: the extensions of their nodes; of chosen ones only those of round ``now``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for pieces in batch.column(0).to_pylist():
                states: dict = {}
                for piece in marshal.loads(pieces):
                    states.update(reader.get(piece))
                rows = []
                for node, kept in states.items():
                    if type(kept) is tuple:
                        if kept[0] != now:
                            continue
                        kept = kept[1]
                    for side, of in zip("PS", marshal.loads(kept)):
                        rows += [(node, side, i, *e) for i, e in enumerate(of)]
                columns = list(zip(*rows)) if rows else [[]] * 7
                types = (pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.bool_())
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                arrays = [a.cast(pa.string()) if t == pa.binary() else a for a, t in zip(arrays, types)]
                yield pa.record_batch(arrays, ["node", "side", "idx", "seq", "cnt", "visit", "terminal"])

    return run


def texts(folder: str):
    """A function for ``mapInArrow`` over places of contigs: the contigs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for place in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(reader.get(marshal.loads(place)), pa.binary()).cast(pa.string())], ["seq"])

    return run
