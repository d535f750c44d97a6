"""Steps of walks taken together where neighbouring nodes are in one task.

Nodes are dealt out by the least hash of their l-mers, which most neighbours share, and a
task works on blocks of them.  It follows the places of a block's seeds and of the ports that
other blocks lead to, until they leave the block or end.  What it gives is a map of places as
``walk`` has it, whose pieces stand for several steps; what is composed, exchanged and filled
in after that are these pieces alone.  Any cut of the nodes into blocks gives the same walks.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, functions as F

from strandloom.config import AssemblyConfig
from strandloom.operators import shares, walk
from strandloom.operators.shares import ranked
from strandloom.session import written

#: Extensions in a block, steps of a piece, and rows that a task hands on together.
BLOCK, LONGEST, ROWS = 200_000, 1024, 50_000

SCHEMA = "port long, node string, seq string, visit int, begins boolean, lo int, hi int, to_node string, to_seq string, moved int, steps int, split int, adds string"
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def region(node: Column, size: int, l: int) -> Column:
    """The least hash of the l-mers of a node of ``size`` letters."""
    l = min(l, size)
    hashes = [F.xxhash64(F.substring(node, i, l)) for i in range(1, size - l + 2)]
    return F.least(*hashes) if len(hashes) > 1 else hashes[0]


def mapped(ext: DataFrame, config: AssemblyConfig) -> walk.FlowMap:
    """The map of places whose pieces are stretches.  A step to a prefix that is not there is an error."""
    most = int(ext.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shares.dealt(ext, region(F.col("node"), config.node, config.minimizer), "region", most).drop("region")
    found = written(dealt.mapInArrow(blocks, SCHEMA), "walk-stretches")
    ports, pieces = found.where("lo IS NULL").select("port", "node", "seq", "visit", "begins"), found.where("lo IS NOT NULL")
    inner = ports.where("NOT begins").select(F.col("node").alias("to_node"), F.col("seq").alias("to_seq"), F.col("port").alias("to"))
    live, ended = pieces.where("to_node IS NOT NULL").drop("node", "seq"), pieces.where("to_node IS NULL")
    lost = F.raise_error(F.concat(F.lit("no prefix for a step to "), "to_node")).cast("long")
    columns = ("port", "lo", "hi", "to", "moved", "adds", "steps", "split")
    out = live.join(inner, ["to_node", "to_seq"], "left").withColumn("to", F.coalesce("to", lost)).select(*columns)
    seen = Observation()
    out = out.unionByName(ended.withColumn("to", F.lit(None).cast("long")).select(*columns)).observe(seen, F.count("*").alias("n"))
    wires = written(out, "walk-wires")
    return walk.FlowMap(ports, wires, ports.count(), seen.get["n"], "port < 0")


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ports and pieces of blocks of extensions, which are sorted by node, side and idx."""
    gc.disable()  # no cycles are made, and looking for some among a block's tuples takes a quarter of the time
    try:
        yield from _blocks(batches)
    finally:
        gc.enable()


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    nodes: dict[bytes, tuple[list, list]] = {}
    held, node, state = 0, None, None
    for batch in batches:
        for key, suffix, seq, cnt, visit, terminal in zip(*(shares.values(batch.column(c)) for c in shares.EXTENSION)):
            if key != node:
                if held >= BLOCK:
                    for out in _batches(followed(nodes, number)):
                        number += out[1]
                        yield out[0]
                    nodes, held = {}, 0
                node = key
                nodes[key] = state = ([], [])
            state[suffix].append((seq, cnt, visit, terminal))
            held += 1
    for out in _batches(followed(nodes, number)):
        yield out[0]


def _batches(rows: Iterator[tuple]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Batches of rows, and the ports in each."""
    some: list[tuple] = []

    def batch() -> tuple[pa.RecordBatch, int]:
        arrays = [pa.array(c, t) for c, t in zip(zip(*some), _TYPES)]
        return pa.record_batch([a.cast(pa.string()) if t == pa.binary() else a for a, t in zip(arrays, _TYPES)], _NAMES), sum(r[5] is None for r in some)

    for row in rows:
        some.append(row)
        if len(some) >= ROWS:
            yield batch()
            some = []
    if some:
        yield batch()


def wires_of(node: bytes, state: tuple[list, list]) -> dict[int, list[tuple]]:
    """(lo, hi, moved, adds, to) by idx of the prefix; ``to`` is (node, seq), or None where a contig ends."""
    n, (prefixes, suffixes) = len(node), state
    order_p, order_s = ranked(prefixes), ranked(suffixes)
    out: dict[int, list[tuple]] = {p: [] for p in order_p}
    i = j = at = p_from = s_from = 0
    while i < len(order_p) and j < len(order_s):
        seq, _, s_visit, terminal = suffixes[order_s[j]]
        p_until, s_until = p_from + prefixes[order_p[i]][2], s_from + s_visit
        until = min(p_until, s_until)
        whole = node + seq
        out[order_p[i]].append((at - p_from, until - p_from, p_from - s_from, seq, None if terminal else (whole[-n:], whole[: len(seq)])))
        at = until
        if until == p_until:
            i, p_from = i + 1, until
        if until == s_until:
            j, s_from = j + 1, until
    return out


def followed(nodes: dict[bytes, tuple[list, list]], number: int) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` of a block: each port that is a seed or led to from elsewhere, then its pieces; seeds have numbers below 0."""
    inner: dict[tuple[bytes, bytes], list[tuple]] = {}
    entries: list[tuple] = []
    for node, state in nodes.items():
        n, prefixes = len(node), state[0]
        for idx, wires in wires_of(node, state).items():
            seq, _, visit, terminal = prefixes[idx]
            if not terminal:
                inner[node, seq] = wires
            if terminal or (seq + node)[:n] not in nodes:
                entries.append((node, seq, visit, terminal, wires))
    known = {(e[0], e[1]) for e in entries if not e[3]}
    while entries:
        node, seq, visit, begins, wires = entries.pop()
        port = ~number if begins else number
        yield port, node, seq, visit, begins, None, None, None, None, None, None, None, None
        open_pieces = [(0, visit, 0, 0, None, b"", wires)]
        while open_pieces:
            a, b, moved, steps, split, adds, wires = open_pieces.pop()
            first, last = a + moved, b + moved
            for lo, hi, further, letters, to in wires:
                if hi <= first or lo >= last:
                    continue
                start, end = max(lo, first) - moved, min(hi, last) - moved
                parted = steps if lo > first else split
                piece = start, end, moved + further, steps + 1, parted, adds + letters
                if to is None:
                    yield port, None, None, None, None, start, end, None, None, moved + further, steps + 1, parted, piece[5]
                elif to[0] not in nodes:
                    yield port, None, None, None, None, start, end, *to, moved + further, steps + 1, parted, piece[5]
                else:
                    onward = inner.get(to)
                    if onward is None:
                        raise ValueError(f"no prefix for a step to {to[0].decode()}")
                    if steps + 1 < LONGEST:
                        open_pieces.append((*piece, onward))
                        continue
                    if to not in known:
                        known.add(to)
                        entries.append((*to, onward_visit(nodes, to), False, onward))
                    yield port, None, None, None, None, start, end, *to, moved + further, steps + 1, parted, piece[5]
        number += 1


def onward_visit(nodes: dict[bytes, tuple[list, list]], port: tuple[bytes, bytes]) -> int:
    """The flow of a live prefix."""
    return next(visit for seq, _, visit, terminal in nodes[port[0]][0] if seq == port[1] and not terminal)
