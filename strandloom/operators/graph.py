"""Nodes and extensions of the graph of (k-1)-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.config import AssemblyConfig
from strandloom.functions import sequence as S


def pred_succ(kmers: DataFrame, config: AssemblyConfig) -> DataFrame:
    return kmers.select("kmer", S.first(F.col("kmer"), config.node).alias("pred"), S.last(F.col("kmer"), config.node).alias("succ"), "cnt")


def nodes(kmers: DataFrame, config: AssemblyConfig) -> DataFrame:
    both = pred_succ(kmers, config)
    return both.select(F.explode(F.array("pred", "succ")).alias("node")).distinct()


def extensions(kmers: DataFrame, config: AssemblyConfig) -> DataFrame:
    """(node, side, idx, seq, cnt, visit, terminal): S rows extend a node to the right, P rows to the left.

    Each k-mer is a suffix of its first node and a prefix of its last one; both are
    made in one pass, and one exchange by node serves numbering and all that follows.
    """
    sides = F.array(
        F.struct(S.first(F.col("kmer"), config.node).alias("node"), F.lit("S").alias("side"), S.last(F.col("kmer"), 1).alias("seq")),
        F.struct(S.last(F.col("kmer"), config.node).alias("node"), F.lit("P").alias("side"), S.first(F.col("kmer"), 1).alias("seq")),
    )
    rows = kmers.select(F.explode(sides).alias("e"), "cnt").select("e.node", "e.side", "e.seq", "cnt").repartition("node")
    order = Window.partitionBy("node", "side").orderBy("seq")
    return rows.select(
        "node",
        "side",
        (F.row_number().over(order) - 1).alias("idx"),
        "seq",
        "cnt",
        S.visits(F.col("cnt"), config.coverage).alias("visit"),
        F.lit(False).alias("terminal"),
    )


def macro_nodes(ext: DataFrame, wires: DataFrame | None = None) -> DataFrame:
    """Nested view: one row a node with its prefixes, suffixes and wires as arrays."""

    def side(which: str):
        row = F.struct("idx", "seq", "cnt", "visit", "terminal")
        return F.array_sort(F.collect_list(F.when(F.col("side") == which, row)))

    out = ext.groupBy("node").agg(side("P").alias("prefixes"), side("S").alias("suffixes"))
    if wires is None:
        return out
    nested = wires.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("p_idx", "off_p", "s_idx", "off_s", "cnt"))).alias("wires"))
    return out.join(nested, "node", "left")
