"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles.  Documents with equal sets are
one node.  Two nodes link when ``100 * intersection >= percent * union``.

1. A filter by prefixes in hash order: of its first ``allowance + extra`` tokens a
   linked node shares ``extra`` with its partner, so a node of which other nodes hold
   fewer has no link.  The rest are the candidates.
2. Tokens of candidates are ordered by how many candidates hold them: tokens with
   ``frequent`` holders or fewer are rare and come first, the others are frequent.
   Rare tokens are indexed singly.  Frequent tokens fall into classes by hash and
   are indexed by pairs of one class.  A node's prefix is extended until no choice
   of as many tokens as a linked node may lack could hit every combination in it:
   rare tokens + sum over classes of (tokens - 1) > size - least overlap.  So two
   linked nodes share a combination.
3. In each bucket the node whose tokens have the most holders, the leader, is compared
   with the others, exactly.  Members of a large group of near copies are so compared
   with its centre, and most link with it.
4. A node that does not link with its leader can link with others of the bucket only
   by tokens outside the leader, or where it nearly links and they are smaller.  So
   compared nodes are indexed again under the leader, by a prefix of those tokens that
   is as long as the gap to a link needs; its first common token bounds what a pair
   can share.  The pairs that meet there are compared, or, where they are too many,
   get leaders once more.  Nodes that link with the same leader are never paired.

Number of classes: it grows with the size of the sets, so that classes hold a few
tokens each; nodes emit for every class number that a partner's size may give.

Defined results: a null text or one without words has an empty set, links with
nothing and is its own component, whatever other empty ones there are; fewer words
than a shingle make one shingle of all; rows that repeat a doc_id link by their
texts; a null doc_id takes part, and a component of nulls only has a null id;
a very long text is one set as any other; other columns are ignored; an empty table
gives no rows.  Tokens are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import textkernels as K
from .components import connected_components
from .storage import written


@dataclass(frozen=True)
class JaccardConfig:
    words: int = 5
    percent: int = 75
    #: Tokens that more candidates hold are frequent.
    frequent: int = 16
    #: Pairs are compared without another leader where they are at most so many a row of the buckets,
    pairs_per_row: int = 8
    #: or after so many rounds of leaders.
    rounds: int = 3
    #: Tables of candidate ids up to this many rows are broadcast, larger ones are joined by shuffle.
    broadcast_rows: int = 500_000


BUCKET = ["combination", "node", "n", "cap", "score", "linked"]
BUCKET_SCHEMA = "combination long, node long, n long, cap long, score double, linked boolean"


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk."""
    starts, ends, word_offs = K.split_words(buf, offs)
    hashes = K.SpanHash(K.LOWER[buf])(starts, ends)
    windows = K.window_hashes(hashes, words)
    for lo, hi in zip(word_offs[:-1].tolist(), word_offs[1:].tolist()):
        if hi - lo >= words:
            yield np.unique(windows[lo : hi - words + 1])
        elif hi > lo:
            yield K.window_hashes(hashes[lo:hi], hi - lo) ^ np.uint64(hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def set_hash(tokens: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit number."""
    total = K.mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(K.mix(np.array([total], np.uint64)).view(np.int64)[0])


def allowance(size, percent: int):
    """Tokens that a linked node may lack: size - ceil(size * percent / 100)."""
    return size - (size * percent + 99) // 100


def extra(size: int) -> int:
    """Tokens that linked nodes must share within the filter's prefixes."""
    return 1 + size // 8


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def set_summaries(docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, prefix): node is null for an empty set; prefix is in hash order."""
    schema = StructType(
        [StructField("doc_id", docs.schema["doc_id"].dataType), StructField("text_hash", LongType()), StructField("n_shingles", LongType())]
        + [StructField("node", LongType()), StructField("prefix", ArrayType(LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.utf8_column(batch.column(2))
            for lo, hi in K.chunks(offs):
                n, node, prefix = [], [], []
                for s in shingle_sets(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], config.words):
                    n.append(len(s))
                    node.append(set_hash(s) if len(s) else None)
                    prefix.append(s[: allowance(len(s), config.percent) + extra(len(s))] if len(s) else s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(node, pa.int64()), _lists(prefix)], schema.names
                )

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text), "text").mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(token, node) arrays of sorted batches, without repeated rows; True at the end of a batch's own runs.

    The last token of a batch is held back until the next batch shows where it ends.
    """
    token, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        token = np.concatenate([token, batch.column(0).to_numpy()])
        node = np.concatenate([node, batch.column(1).to_numpy()])
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
        if cut:
            yield token[:cut], node[:cut], True
            token, node = token[cut:], node[cut:]
        elif len(token) > 1_000_000:  # one very frequent token: pass on all but its last rows
            yield token[:-100], node[:-100], False
            token, node = token[-100:], node[-100:]
    if len(token):
        yield token, node, True


def _run_bounds(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    return first, np.diff(np.append(first, len(token)))


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token, node, number of distinct nodes of the token, at least 2 where it has several)."""
    carried = 0
    for token, node, ended in _runs(batches):
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node = token[new], node[new]
        first, size = _run_bounds(token)
        size = size.copy()
        size[0] += carried
        carried = 0 if ended else int(size[-1])
        yield token, node, np.repeat(size, np.diff(np.append(first, len(token))))


def candidate_nodes(summaries: DataFrame) -> DataFrame:
    """(node, held): how many prefix tokens of each node other nodes hold too, where they are any."""
    tokens = summaries.where("node IS NOT NULL").select(F.explode("prefix").alias("token"), "node")
    dealt = tokens.repartition("token").sortWithinPartitions("token", "node")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, node, holders in _holders(batches):
            nodes, held = np.unique(node[holders > 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(held.astype(np.int64))], ["node", "held"])

    return dealt.mapInArrow(shared, "node long, held long").groupBy("node").agg(F.sum("held").alias("held"))


def candidate_tokens(docs: DataFrame, candidates: DataFrame, config: JaccardConfig) -> DataFrame:
    """(token, node) of candidates (node, doc_id, text_hash), computed again from their texts."""
    ids = F.broadcast(candidates) if candidates.count() <= config.broadcast_rows else candidates
    ids = ids.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    own = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_own"))
    # Many rows may have one doc_id, or none; with the text's hash each meets its own candidate only.
    texts = own.join(ids, (F.col("_own") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            buf, offs = K.utf8_column(batch.column(1))
            for lo, hi in K.chunks(offs):
                tokens, nodes = [], []
                for i, s in enumerate(shingle_sets(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], config.words), lo):
                    if len(s) and set_hash(s) == wanted[i]:  # a doc_id may be repeated with other texts
                        tokens.append(s)
                        nodes.append(np.full(len(s), wanted[i]))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])

    return texts.mapInArrow(run, "token long, node long")


def shared_tokens(tokens: DataFrame, config: JaccardConfig) -> DataFrame:
    """(node, score, tokens): the tokens of each candidate that other candidates hold too.

    ``tokens`` are structs (holders, token) in ascending order, with holders counted up
    to one more than rare tokens have; ``score`` is the sum of all holders.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, node, holders in _holders(batches):
            several = holders > 1
            yield pa.RecordBatch.from_arrays([pa.array(node[several]), pa.array(token[several]), pa.array(holders[several].astype(np.int32))], ["node", "token", "holders"])

    counted = tokens.repartition("token").sortWithinPartitions("token", "node").mapInArrow(count, "node long, token long, holders int")
    own = F.struct(F.least("holders", F.lit(config.frequent + 1)).alias("holders"), "token")
    return counted.groupBy("node").agg(F.sum("holders").cast("double").alias("score"), F.sort_array(F.collect_list(own)).alias("tokens"))


def class_numbers(size: int, percent: int) -> list[int]:
    """Numbers of classes that nodes of this size take part in."""

    def own(n: int) -> int:
        return 1 << max(0, (n // 8).bit_length() - 1)

    return sorted({own(size * percent // 100), own(size), own(-(-size * 100 // percent))})


def combinations(tokens: np.ndarray, holders: np.ndarray, size: int, config: JaccardConfig) -> np.ndarray:
    """Hashes of the combinations that a node is indexed by.

    ``tokens`` are those with other holders, ascending by (holders, token); the
    ``size - len(tokens)`` others come before them and need no index.
    """
    rare = int(np.searchsorted(holders, config.frequent, side="right"))
    need = allowance(size, config.percent) + 1 - (size - len(tokens))
    if need <= 0:
        return np.zeros(0, np.uint64)
    single = tokens[: min(rare, need)].view(np.uint64)
    out = [K.mix(single)]
    need -= rare
    if need > 0:
        often = tokens[rare:].view(np.uint64)
        for classes in class_numbers(size, config.percent):
            kind = (K.mix(often ^ np.uint64(0xC1A55)) % np.uint64(classes)).astype(np.int64)
            order = np.argsort(kind, kind="stable")
            seen = np.empty(len(often), np.int64)  # tokens of the same class before each token
            first, count = _run_bounds(kind[order]) if len(order) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            seen[order] = np.arange(len(often)) - np.repeat(first, count)
            gained = np.cumsum(seen > 0)
            stop = int(np.searchsorted(gained, need)) + 1
            kind, seen = kind[:stop], seen[:stop]
            order = np.argsort(kind, kind="stable")
            for back in range(1, int(seen.max(initial=0)) + 1):
                later = order[seen[order] >= back]
                position = np.empty(len(kind), np.int64)
                position[order] = np.arange(len(kind))
                earlier = order[position[later] - back]
                out.append(K.mix(often[earlier] * np.uint64(0x9FB21C651E98DF25) ^ K.mix(often[later] + np.uint64(classes))))
    return np.concatenate(out)


def index_combinations(shared: DataFrame, config: JaccardConfig) -> DataFrame:
    """Bucket rows of all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, scores, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            flat, offs = lists.flatten(), lists.offsets.to_numpy()
            offs = offs - offs[0]
            token, holders = flat.field("token").to_numpy(), flat.field("holders").to_numpy()
            found = [combinations(token[a:b], holders[a:b], int(n), config) for a, b, n in zip(offs[:-1], offs[1:], sizes)]
            count = [len(x) for x in found]
            if sum(count):
                columns = [np.concatenate(found).view(np.int64)] + [np.repeat(x, count) for x in (nodes, sizes, room(np.diff(offs), sizes, config.percent), scores)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns] + [pa.array(np.zeros(sum(count), dtype=bool))], BUCKET)

    return shared.select("node", "n", "score", "tokens").mapInArrow(run, BUCKET_SCHEMA)


def room(overlap, size, percent: int):
    """Largest partner that a set can link with if they share at most ``overlap`` tokens."""
    return overlap * (100 + percent) // percent - size


def least_overlap(a, b, percent: int):
    """Tokens that linked sets of sizes a and b share at least."""
    return -(-(percent * (a + b)) // (100 + percent))


def star_pairs(buckets: DataFrame, config: JaccardConfig) -> DataFrame:
    """Distinct pairs (a, b) of each bucket's leader and the others that may link with anyone there."""
    best = buckets.groupBy("combination").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max_by("node", "score").alias("a"))
    met = buckets.join(best.where("k > 1").drop("k"), "combination").where("node <> a")
    met = met.where(F.col("cap") >= F.greatest(F.col("least"), F.ceil(config.percent * F.col("n") / 100)))
    return met.select("a", F.col("node").alias("b")).distinct()


def open_pairs(buckets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that share a bucket, may link by their sizes, and do not both link with its earlier leader."""
    x = buckets.where("NOT linked").select("combination", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("cap").alias("cap_x"))
    y = buckets.select("combination", F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("cap").alias("cap_y"), "linked")
    met = x.join(y, "combination").where("(linked AND x <> y) OR x < y").where("n_y <= cap_x AND n_x <= cap_y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def compared(pairs: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """(a, b, n, score, overlap, linked, rest) of pairs: sizes and score are of b, ``rest`` are its tokens outside a."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = sets.join(F.broadcast(ends) if ends.count() <= config.broadcast_rows else ends, "node")
    held = held.select("node", "n", "score", F.col("tokens.token").alias("t"))
    left = held.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("t").alias("t_a"))
    met = pairs.join(left, "a").join(held.withColumnRenamed("node", "b"), "b").select("a", "b", "n_a", "n", "score", "t_a", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            flat, offs = zip(*((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(5), batch.column(6))))
            overlap, rest = np.zeros(len(n), np.int64), []
            for i in range(len(n)):
                t = flat[1][offs[1][i] : offs[1][i + 1]]
                common = np.isin(t, flat[0][offs[0][i] : offs[0][i + 1]])
                overlap[i] = common.sum()
                rest.append(t[~common].view(np.uint64))
            linked = 100 * overlap >= config.percent * (n_a + n - overlap)
            columns = [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(overlap), pa.array(linked), _lists(rest)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n", "score", "overlap", "linked", "rest"])

    return met.mapInArrow(run, "a long, b long, n long, score double, overlap long, linked boolean, rest array<long>")


def _around_leader(leader: int, n: int, overlap: int, linked: bool, low: int, rest: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, caps) by which a node that was compared with a leader meets the others that were.

    A partner shares ``g`` or more tokens outside the leader with it: what their overlap
    must be, less what either shares with the leader.  Where g is positive they meet
    in one of the first ``len(rest) - g + 1`` of those tokens; the first one they share
    bounds their overlap.  Else what each shares with the leader is enough for a link,
    and they meet in one bucket of such nodes.
    """
    least = max(low, (percent * n + 99) // 100)
    gap = least_overlap(n, least, percent) - overlap
    first = max(0, len(rest) - (1 if linked else max(1, gap)) + 1)
    own = K.mix(np.array([leader], np.int64).view(np.uint64))
    keys = K.mix(own * np.uint64(0x9FB21C651E98DF25) ^ K.mix(rest[:first].view(np.uint64) + np.uint64(3)))
    caps = room(overlap + len(rest) - np.arange(first), n, percent)
    if gap <= 0:
        keys, caps = np.append(keys, own ^ np.uint64(0x0EA4)), np.append(caps, room(overlap, n, percent))
    return keys, caps


def buckets_around_leaders(found: DataFrame, config: JaccardConfig) -> DataFrame:
    """Buckets in which nodes compared with one leader meet again, unless all of them link with it."""
    near = found.groupBy("a").agg(F.min("n").alias("low"), F.bool_and("linked").alias("every")).where("NOT every").select("a", "low")
    rows = found.join(F.broadcast(near) if near.count() <= config.broadcast_rows else near, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
            flat, offs = batch.column(7).flatten().to_numpy(), batch.column(7).offsets.to_numpy()
            offs = offs - offs[0]
            made = [_around_leader(a, n, o, k, low, flat[i:j], config.percent) for a, _, n, _, o, k, low, i, j in zip(*columns, offs[:-1], offs[1:])]
            if count := [len(k) for k, _ in made]:
                out = [np.concatenate([k for k, _ in made]).view(np.int64)] + [np.repeat(columns[j], count) for j in (1, 2)]
                out += [np.concatenate([c for _, c in made]).astype(np.int64)] + [np.repeat(columns[j], count) for j in (3, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], BUCKET)

    return rows.select("a", "b", "n", "score", "overlap", "linked", "low", "rest").mapInArrow(run, BUCKET_SCHEMA)


def linked_pairs(index: DataFrame, sets: DataFrame, config: JaccardConfig) -> DataFrame:
    """Links (a, b) that connect all linked nodes; ``index`` has bucket rows."""
    buckets, links = index, None
    for step in range(config.rounds + 1):
        if step:
            rows, pairs = buckets.groupBy("combination").agg(F.count("*").alias("k"), F.count_if(~F.col("linked")).alias("u")).agg(F.sum("k"), F.sum(F.col("k") * F.col("u"))).first()
            if not pairs:
                break
        last = step and (step == config.rounds or pairs <= config.pairs_per_row * rows)
        pairs = written(open_pairs(buckets) if last else star_pairs(buckets, config), "pairs")
        found = written(compared(pairs, sets, config), "compared")
        fresh = found.where("linked").select("a", "b")
        links = fresh if links is None else links.unionByName(fresh)
        if last:
            break
        buckets = written(buckets_around_leaders(found, config), "buckets")
    return links


def _rooted_sets(docs: DataFrame, config: JaccardConfig) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, root) of every row; root is null for an empty set."""
    summaries = written(set_summaries(docs, config), "shingle-sets")
    nodes = summaries.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"), F.first("n_shingles").alias("n"))
    nodes = nodes.select("node", "k.doc_id", "k.text_hash", "n")
    met = nodes.join(candidate_nodes(summaries), "node").where(F.col("held") >= 1 + F.floor(F.col("n") / 8))  # extra(n)
    candidates = written(met.drop("held"), "candidates")
    tokens = candidate_tokens(docs, candidates.select("node", "doc_id", "text_hash"), config)
    scored = shared_tokens(tokens, config).join(candidates.select("node", "n"), "node").withColumn("score", F.col("score") / F.col("n"))
    sets = written(scored.select("node", "n", "score", "tokens"), "shared-tokens")
    links = linked_pairs(written(index_combinations(sets, config), "combinations"), sets, config)
    rows = summaries.drop("prefix").join(connected_components(links), "node", "left")
    return rows.withColumn("root", F.coalesce("root", "node"))


def jaccard_components(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    rows = _rooted_sets(docs, config)
    rooted = rows.where("root IS NOT NULL")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = rows.where("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rooted.join(smallest, "root").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One row of each component: of smallest doc_id, any id before none, then of smallest text hash.

    Rows that repeat both doc_id and text are one document and leave one row, whatever
    their other columns; rows without words are linked with nothing and all stay.
    """
    rows = _rooted_sets(docs, config).where("root IS NOT NULL").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    rows = written(rows, "rooted")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")).alias("k"))
    stays = F.col("k.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("k.text_hash") == F.col("text_hash"))
    judged = rows.join(best, "root").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "copies", stays.alias("stays"))
    marked = written(judged.where("NOT stays OR copies > 1"), "marked")
    few = marked.count() <= config.broadcast_rows
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))

    def joined(keys: DataFrame, how: str) -> DataFrame:
        return docs.join(F.broadcast(keys) if few else keys, docs["doc_id"].eqNullSafe(keys["id_"]) & (hashed == keys["hash_"]), how)

    # Only where the row that stays is repeated do its copies have to meet.
    repeated = joined(marked.where("stays"), "left_semi").dropDuplicates(["doc_id", "text"])
    return joined(marked, "left_anti").unionByName(repeated)
