"""k-mer and l-mer extraction, counting, minimizers and owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.config import AssemblyConfig
from strandloom.functions import sequence as S
from strandloom.operators import packed


def extracted(reads: DataFrame, n: int, name: str, alphabet: str = "strict") -> DataFrame:
    """One row for each window of ``n`` bases of each read; strict windows hold bases only.

    Long reads are cut into overlapping pieces first, so that no row holds all windows of a read.
    """
    codes, windows = (S.compat_codes, S.compat_windows) if alphabet == "compat" else (S.encode, S.windows)
    piece = reads.select(F.explode(S.pieces(codes(F.col("seq")), n)).alias("piece"))
    return piece.select(F.explode(windows(F.col("piece"), n)).alias(name))


def kmer_counts(reads: DataFrame, config: AssemblyConfig) -> DataFrame:
    """(kmer, cnt); counts are combined in the tasks before the exchange."""
    return extracted(reads, config.k, "kmer", config.alphabet).groupBy("kmer").agg(F.count("*").alias("cnt"))


def spelled_counts(reads: DataFrame, config: AssemblyConfig, bases_only: bool = False) -> DataFrame:
    """The rows of ``kmer_counts``, counted as packed keys up to 31 bases; ``bases_only`` drops other letters of the reads first."""
    if config.k > 31:
        return kmer_counts(_bases(reads) if bases_only else reads, config)
    return packed.spelled_counts(reads, config, bases_only)


def _bases(reads: DataFrame) -> DataFrame:
    return reads.withColumn("seq", F.regexp_replace(F.coalesce("seq", F.lit("")), "[^ACGTacgt]+", ""))


def lmer_frequencies(reads: DataFrame, config: AssemblyConfig, bases_only: bool = False) -> DataFrame:
    size = config.minimizer
    if size <= packed.LONGEST_MINIMIZER:
        found = packed.packed_kmers(reads, config, size, bases_only).groupBy("key").agg(F.sum("times").alias("freq"))
        return found.select(packed.unpacked(F.col("key"), size).alias("lmer"), "freq")
    return extracted(_bases(reads) if bases_only else reads, size, "lmer", config.alphabet).groupBy("lmer").agg(F.count("*").alias("freq"))


def counted_minimizers(reads: DataFrame, config: AssemblyConfig, bases_only: bool = False) -> DataFrame:
    """(kmer, cnt, minimizer, pos) of the reads' k-mers."""
    lmers = lmer_frequencies(reads, config, bases_only)
    if config.k <= 31 and config.minimizer <= packed.LONGEST_MINIMIZER:
        return packed.counted_minimizers(reads, lmers, config, bases_only)
    return minimizers(spelled_counts(reads, config, bases_only), lmers, config)


def minimizers(kmers: DataFrame, lmers: DataFrame, config: AssemblyConfig) -> DataFrame:
    """``kmers`` with minimizer and pos: leftmost of the rarest l-mers of each k-mer.

    Up to ``packed.LONGEST_MINIMIZER`` bases the ranks of all l-mers fit in a bounded
    table and nothing is exchanged; longer ones are joined.
    """
    size = config.minimizer
    if size <= packed.LONGEST_MINIMIZER:
        return packed.minimizers(kmers, lmers, config)
    at = kmers.select("*", F.posexplode(S.windows(F.col("kmer"), size)).alias("pos", "lmer"))
    best = at.join(lmers, "lmer").groupBy(*kmers.columns).agg(F.min(F.struct("freq", "pos", "lmer")).alias("b"))
    return best.select(*kmers.columns, F.col("b.lmer").alias("minimizer"), F.col("b.pos").alias("pos"))


def owner_of_lmer(lmer, owners: int):
    return F.pmod(S.hash31(S.number(lmer)), F.lit(owners))


def owner_load(owned: DataFrame, config: AssemblyConfig) -> DataFrame:
    """(owner, distinct_kmers, total): what each owner of minimizers holds."""
    owned = owned.withColumn("owner", owner_of_lmer(F.col("minimizer"), config.owners))
    return owned.groupBy("owner").agg(F.count("*").alias("distinct_kmers"), F.sum("cnt").alias("total"))
