"""The whole assembly, from reads to contigs, and its metrics."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, functions as F

from strandloom.config import AssemblyConfig
from strandloom.functions import sequence as S
from strandloom.operators import compaction, graph, histogram, kmers, packed, walk, wiring
from strandloom.session import checkpointed, written
from strandloom.sources import fasta


@dataclass
class Assembly:
    """Contigs as chunks (contig, origin, chunk, text) in letters, the graph behind them, and figures of the run.

    ``figures`` are row counts by phase, observed in the passes that make the tables.
    """

    chunks: DataFrame
    ext: DataFrame
    cutoff: int
    rounds: list[compaction.Round] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    figures: dict[str, int] = field(default_factory=dict)

    @property
    def contigs(self) -> DataFrame:
        """(seq, origin) of whole contigs."""
        return walk.whole(self.chunks).select("seq", "origin")

    @property
    def statistics(self) -> list[tuple[int, int, int]]:
        return [(i, r.nodes, r.contracted) for i, r in enumerate(self.rounds)]


def valid(reads: DataFrame, config: AssemblyConfig, bases_only: bool = False) -> tuple[DataFrame, int]:
    """k-mers at or above the cut-off, and the cut-off; raises if none is left.  ``bases_only`` drops other letters of the reads first."""
    return _kept(_found(reads, config, bases_only), config)


def counted(reads: DataFrame, config: AssemblyConfig) -> tuple[DataFrame, int, dict[str, int]]:
    """Valid k-mers, the cut-off, and what was read and counted on the way."""
    read, seen = Observation(), Observation()
    rows = reads.observe(read, F.count("*").alias("reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))
    found = _found(rows, config)
    n, total = (F.sum("n"), F.sum("total")) if "n" in found.columns else (F.count("*"), F.sum("cnt"))
    kept, cutoff = _kept(found.observe(seen, F.coalesce(n, F.lit(0)).alias("distinct"), F.coalesce(total, F.lit(0)).alias("total")), config)
    return kept, cutoff, {"reads": read.get["reads"], "bases": read.get["bases"], "kmers": seen.get["total"], "distinct_kmers": seen.get["distinct"]}


def _found(reads: DataFrame, config: AssemblyConfig, bases_only: bool = False) -> DataFrame:
    """Counts of all k-mers; up to 31 bases they stay packed in runs."""
    return packed.summed_runs(reads, config, bases_only) if config.k <= 31 else kmers.spelled_counts(reads, config, bases_only)


def _kept(found: DataFrame, config: AssemblyConfig) -> tuple[DataFrame, int]:
    """The counts, written once, from the cut-off on; of runs, only these become rows."""
    counts = written(found, "kmer-counts")
    if config.k > 31:
        cutoff = histogram.min_bucket(counts, config.buckets)
        kept = counts.where(F.col("cnt") >= cutoff)
        some = kept.take(1)
    else:
        cutoff = 1 if config.buckets <= 1 else histogram.least_bucket(histogram.histogram_of_runs(counts, config.buckets))
        kept = packed.spelled_from(counts, cutoff, config.k)
        below = F.coalesce(F.aggregate(F.slice("few", 1, cutoff - 1), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
        some = counts.where(F.col("n") > below).take(1)
    if not some:
        raise histogram.NothingLeft(f"no k-mer occurs {cutoff} times")
    return kept, cutoff


def assemble(reads: DataFrame, config: AssemblyConfig) -> Assembly:
    """All phases; each has its seconds, and its rows as they are observed."""
    seconds: dict[str, float] = {}
    began = time.time()

    def lap(name: str) -> None:
        nonlocal began
        seconds[name] = time.time() - began
        began = time.time()

    kept, cutoff, figures = counted(reads, config)
    lap("count")
    survived, built = Observation(), Observation()
    rows = graph.extensions(kept.observe(survived, F.count("*").alias("n")), config)
    nodes = F.count(F.when(F.expr(compaction.ONE_A_NODE), 1))
    ext = written(wiring.balanced(rows).observe(built, nodes.alias("nodes"), F.count("*").alias("rows")), "graph")
    figures |= {"valid_kmers": survived.get["n"], "nodes": built.get["nodes"], "extensions": built.get["rows"]}
    lap("nodes")
    done = compaction.contract(ext, config)
    figures |= {"rounds": len(done.rounds), "contracted": sum(r.contracted for r in done.rounds)}
    lap("contract")
    flow = walk.flow_map(done.ext, config)
    figures |= {"ports": flow.n_ports, "wires": flow.n_wires}
    lap("wire")
    maps = walk.powers(flow)
    figures["doublings"] = len(maps) - 1
    lap("map")
    found = walk.walks(flow, maps, config.walk)
    lap("walk")
    spelled = walk.spelled(flow, maps, found).withColumn("origin", F.lit("walk"))
    partial = fasta.chunks_of(done.partial.withColumn("origin", F.lit("partial")))
    seen = Observation()
    first = F.col("chunk") == 0
    both = spelled.unionByName(partial).withColumn("text", S.decode(F.col("text")))
    of = lambda origin: F.count(F.when(first & (F.col("origin") == origin), 1)).alias(origin)
    chunks = checkpointed(both.observe(seen, of("walk"), of("partial"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("letters")))
    figures |= {"walk_contigs": seen.get["walk"], "partial_contigs": seen.get["partial"], "letters": seen.get["letters"]}
    lap("spell")
    return Assembly(chunks, done.ext, cutoff, done.rounds, seconds, figures)


def figures_table(spark, figures: dict[str, int]) -> DataFrame:
    """(figure, n) of an assembly."""
    return spark.createDataFrame(list(figures.items()), "figure string, n long")


def statistics_table(spark, statistics: list[tuple[int, int, int]]) -> DataFrame:
    """(iter, n_nodes, id_set_size) of the rounds of a contraction."""
    return spark.createDataFrame(statistics, "iter int, n_nodes long, id_set_size long")


def lost_flow(ext: DataFrame, config: AssemblyConfig) -> DataFrame:
    """(node, flow) of wires between two self-loops, which a contraction drops; the loops are seen in a node's own rows."""
    looped = ext.withColumn("loop", ~F.col("terminal") & (compaction.neighbour(config) == F.col("node")))
    return wiring.paired(looped, "loop").where("p.loop AND s.loop").groupBy("node").agg(F.sum("cnt").alias("flow"))
