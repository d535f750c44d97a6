"""Contraction of the graph by independent sets."""

from __future__ import annotations

import marshal
import sys
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.config import AssemblyConfig
from strandloom.functions import sequence as S
from strandloom.operators import shares, wiring
from strandloom.session import shared_path, written

ARRIVAL = ("src", "p_idx", "off_p")


def neighbours(ext: DataFrame, config: AssemblyConfig) -> DataFrame:
    """(node, side, idx, nbr, back): neighbour of each live extension, and its extension that points back."""
    node, seq = F.col("node"), F.col("seq")
    (pn, pb), (sn, sb) = S.before(node, seq, config.node), S.after(node, seq, config.node)
    left = F.col("side") == "P"
    return ext.where("NOT terminal").select("node", "side", "idx", F.when(left, pn).otherwise(sn).alias("nbr"), F.when(left, pb).otherwise(sb).alias("back"))


def self_loops(ext: DataFrame, config: AssemblyConfig) -> DataFrame:
    return neighbours(ext, config).where("nbr = node").select("node", "side", "idx")


def neighbour(config: AssemblyConfig):
    """The neighbour that an extension leads to, terminal or not."""
    node, seq = F.col("node"), F.col("seq")
    return F.when(F.col("side") == "P", S.before(node, seq, config.node)[0]).otherwise(S.after(node, seq, config.node)[0])


def independent_set(ext: DataFrame, config: AssemblyConfig) -> DataFrame:
    """Nodes without a greater neighbour; neighbours follow from a node's own rows, so one grouping is enough."""
    nbr = F.when(~F.col("terminal"), neighbour(config))
    return ext.groupBy("node").agg(F.max(nbr).alias("most")).where("most IS NULL OR most <= node").select("node")


def wired_pairs(ext: DataFrame) -> DataFrame:
    """Wires with both extensions, (node, p_idx, off_p, flow, p_seq, p_cnt, p_end, s_seq, s_cnt, s_end)."""
    both = wiring.paired(ext, "seq", "cnt", "terminal")
    side = lambda c: [F.col(f"{c}.seq").alias(f"{c}_seq"), F.col(f"{c}.cnt").alias(f"{c}_cnt"), F.col(f"{c}.terminal").alias(f"{c}_end")]
    return both.select("node", F.col("p.idx").alias("p_idx"), (F.col("at") - F.col("p.start")).alias("off_p"), F.col("cnt").alias("flow"), *side("p"), *side("s"))


def transfers(pairs: DataFrame, config: AssemblyConfig) -> DataFrame:
    """What contracted nodes tell their neighbours: which extension becomes which longer one."""
    node, p, s = F.col("node"), F.col("p_seq"), F.col("s_seq")
    (pred, p_back), (succ, s_back) = S.before(node, p, config.node), S.after(node, s, config.node)
    common = [F.least("p_cnt", "s_cnt").alias("cnt"), F.col("flow").alias("visit")]
    from_p = F.struct(pred.alias("target"), F.lit("S").alias("side"), p_back.alias("search_ext"), F.concat(p_back, s).alias("new_ext"), *common, (F.col("s_end") | (succ == node)).alias("terminal"))
    from_s = F.struct(succ.alias("target"), F.lit("P").alias("side"), s_back.alias("search_ext"), F.concat(p, s_back).alias("new_ext"), *common, (F.col("p_end") | (pred == node)).alias("terminal"))
    sent = F.filter(
        F.array(F.when(~F.col("p_end") & (pred != node), from_p), F.when(~F.col("s_end") & (succ != node), from_s)), lambda x: x.isNotNull()
    )
    return pairs.select(F.explode(sent).alias("t"), F.col("node").alias("src"), "p_idx", "off_p").select("t.*", *ARRIVAL)


def partial_contigs(pairs: DataFrame) -> DataFrame:
    return pairs.where("p_end AND s_end").select(F.concat("p_seq", "node", "s_seq").alias("seq"))


#: Where the rows that come together in a round are from.
ACTIVE, SENT = 0, 2
#: Messages that a task of a round has about, and at least; pieces of a share that are read side by side before the later ones are put together.
ROWS_A_TASK, MESSAGES_AT_LEAST, SETTLED_TABLES = 25_000, 100, 8
#: A node has one empty prefix, so these rows count nodes.
ONE_A_NODE = "side = 'P' AND seq = ''"


def edited(rows: DataFrame, sent: DataFrame, tasks: int | None = None) -> DataFrame:
    """Extensions ``rows`` (with ``origin``) after the transfers.

    Of the transfers for one live extension the first to arrive replaces it in
    place; all others, and those without a live extension, are appended in order of
    arrival.  A transfer to a node that is not there is an error.  One exchange by
    node and two sorts serve all of it: each window below reads what the one before
    has made, and its rows in the order that is there.

    ``rows`` with a ``round`` may hold several versions of a node: its last one counts,
    and a node whose last version is ``chosen`` is gone.
    """
    versions = [c for c in ("round", "chosen") if c in rows.columns]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(ARRIVAL, ("string", "int", "int"))]
    own = rows.select("node", "side", F.when(~F.col("terminal"), F.col("seq")).alias("key"), "idx", "seq", "cnt", "visit", "terminal", "origin", *versions, *nothing)
    new = sent.select(
        F.col("target").alias("node"), "side", F.col("search_ext").alias("key"), F.lit(None).cast("int").alias("idx"), F.col("new_ext").alias("seq"),
        "cnt", "visit", "terminal", F.lit(SENT).alias("origin"), "src", "p_idx", F.col("off_p").cast("int").alias("off_p"),
    )
    both = own.unionByName(new, allowMissingColumns=True).withColumn("is_new", F.col("origin") == SENT)
    both = both.repartition("node") if tasks is None else both.repartition(tasks, "node")
    old, is_new = ~F.col("is_new"), F.col("is_new")
    if versions:
        both = latest(both).where(is_new | ~F.col("chosen")).drop(*versions)
    both = both.withColumn("rn", F.row_number().over(Window.partitionBy("node", "side", "key", "is_new").orderBy(*ARRIVAL)))
    match = Window.partitionBy("node", "side", "key")
    both = both.withColumns({
        "at": F.max(F.when(old & (F.col("rn") > 0) & F.col("key").isNotNull(), F.col("idx"))).over(match),
        "arrivals": F.coalesce(F.max(F.when(is_new, F.col("rn"))).over(match), F.lit(0)),
    })
    replaces = F.when(is_new & (F.col("rn") == 1), F.col("at"))
    both = both.withColumns({"n": F.count(F.when(old & (F.col("arrivals") >= 0), 1)).over(Window.partitionBy("node", "side")), "replaces": replaces, "appends": is_new & replaces.isNull()})
    both = both.withColumn("later", F.row_number().over(Window.partitionBy("node", "side", "appends").orderBy(*ARRIVAL)) - 1)
    replaced = old & F.col("key").isNotNull() & (F.col("arrivals") > 0) & (F.col("idx") == F.col("at"))
    lost = F.raise_error(F.concat(F.lit("no node for a transfer to "), "node")).cast("int")
    idx = F.when(old, F.col("idx")).when(F.col("n") == 0, lost).otherwise(F.coalesce("replaces", (F.col("n") + F.col("later")).cast("int")))
    return both.where(~replaced).select(*EXT[:2], idx.alias("idx"), *EXT[3:], "origin")


EXT = ("node", "side", "idx", "seq", "cnt", "visit", "terminal")


def latest(rows: DataFrame) -> DataFrame:
    """The rows of each node's last ``round``, and those without one."""
    return rows.withColumn("last", F.max("round").over(Window.partitionBy("node"))).where("round IS NULL OR round = last").drop("last")


def applied(flagged: DataFrame, sent: DataFrame) -> DataFrame:
    """All extensions after the ``chosen`` nodes are gone and their transfers are in."""
    rest = flagged.where("NOT chosen").select(*EXT, F.lit(ACTIVE).alias("origin"))
    return edited(rest, sent).select(*EXT)


def chosen_first(ext: DataFrame, config: AssemblyConfig) -> DataFrame:
    """The extensions and whether their node is ``chosen``: has no greater neighbour."""
    most = F.max(F.when(~F.col("terminal"), neighbour(config))).over(Window.partitionBy("node"))
    return ext.withColumn("chosen", F.coalesce(most <= F.col("node"), F.lit(True)))


@dataclass
class Round:
    """Figures of a round: nodes before it, nodes contracted, nodes touched, rows written."""

    nodes: int
    contracted: int
    touched: int
    rows: int


@dataclass
class Contracted:
    ext: DataFrame
    partial: DataFrame
    rounds: list[Round] = field(default_factory=list)

    @property
    def statistics(self) -> list[tuple[int, int, int]]:
        """(round, nodes before it, nodes contracted)"""
        return [(i, r.nodes, r.contracted) for i, r in enumerate(self.rounds)]


def contract(ext: DataFrame, config: AssemblyConfig) -> Contracted:
    """Rounds until at most ``node_limit`` nodes are left; None contracts nothing.

    A round works on the nodes that the one before touched, all nodes at first: only
    they can have lost their greater neighbours.  Its plan is one exchange of what the
    contracted nodes tell their neighbours, by the shares of ``operators/shares.py``, where
    the nodes are; the driver keeps where each share's pieces are, and counts.
    """
    spark = ext.sparkSession
    if config.node_limit is None:
        return Contracted(written(ext.select(*EXT), "graph"), spark.createDataFrame([], "seq string"))
    context, folder = spark.sparkContext, shared_path(spark, "contraction")
    most, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), context.defaultParallelism
    share = F.pmod(F.crc32(F.col("node").cast("binary")), F.lit(shares.SHARES)).cast("int")
    dealt = shares.dealt(ext, share, "share", most)
    first = written(dealt.mapInArrow(shares.first_round(folder), "share int, told binary"), "contraction-told")
    index: dict[int, list[tuple[str, int, int]]] = {}
    partial: list[tuple[str, int, int]] = []
    waiting: list[tuple[str, int, int]] = []

    def taken(found: list[bytes]) -> dict[str, int]:
        """Add up the tasks' figures; their shares are where they say from now on."""
        nonlocal waiting
        every = [marshal.loads(f) for f in found]
        for f in every:
            index.update((s, [(sys.intern(name), at, size) for name, at, size in of]) for s, of in f["index"].items())
        waiting = [f["partial"] for f in every if f["partial"]]
        return {c: sum(f[c] for f in every) for c in ("nodes", "rows", "chosen", "told")}

    figures = taken([bytes(r[0]) for r in first.where(F.col("share") == shares.FIGURES).select("told").collect()])
    sent, before = first.where(F.col("share") >= 0).rdd.map(tuple), None
    left, rounds = figures["nodes"], []
    while left > config.node_limit:
        partial += waiting
        tasks = max(min(cores, figures["told"] // MESSAGES_AT_LEAST + 1), figures["told"] // ROWS_A_TASK + 1)
        known = context.broadcast(index)
        told = sent.partitionBy(tasks, int).mapPartitions(shares.next_round(folder, len(rounds) + 1, known, SETTLED_TABLES)).persist(StorageLevel.DISK_ONLY)
        contracted, figures = figures["chosen"], taken(told.filter(lambda row: row[0] == shares.FIGURES).values().collect())
        rounds.append(Round(left, contracted, figures["nodes"], figures["rows"]))
        left -= contracted
        if before is not None:
            before.unpersist()
        sent, before = told.filter(lambda row: row[0] != shares.FIGURES), told
    packed = lambda rows: spark.createDataFrame([(bytearray(marshal.dumps(r, 2)),) for r in rows], "at binary").repartition(max(min(most, len(rows)), 1))
    end = packed(list(index.values())).mapInArrow(shares.extensions(folder, len(rounds)), "node string, side string, idx int, seq string, cnt long, visit int, terminal boolean")
    texts = packed(partial).mapInArrow(shares.texts(folder), "seq string") if partial else spark.createDataFrame([], "seq string")
    return Contracted(written(end, "graph"), texts, rounds)
