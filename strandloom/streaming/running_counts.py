"""Running k-mer counts with a cut-off that moves as reads arrive.

Each micro-batch is counted on its own; its k-mers meet their earlier counts, which
gives the histogram's differences and the k-mers that cross the cut-off.  Counts are
kept as segments, tables bucketed by k-mer, so a batch is exchanged but its segments
are not.  As in a binary counter, segments that cover equally many batches are put
together: there are at most log2(batches) of them and a k-mer is rewritten as often.
Only when the cut-off itself moves is the whole state read, for the k-mers between
the old and the new one.

Everything a batch writes is named by its number and follows from the record of the
batch before it, so a batch that is run again after a failure writes the same again.

Defined results: after any batching, counts, histogram and k-mers at or above the
cut-off are those of one batch query over all reads; a batch without k-mers changes
nothing; before the first one the histogram is 0 and no k-mer is valid.  Segments
that were put together stay in the folder until it is removed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from strandloom.config import AssemblyConfig
from strandloom.operators.kmers import spelled_counts

COUNTS = "kmer STRING, cnt BIGINT"
CHANGES = "kmer STRING, cnt BIGINT, valid BOOLEAN, batch INT"
RECORD = "cutoff BIGINT, histogram ARRAY<BIGINT>, segments ARRAY<STRUCT<first: BIGINT, last: BIGINT>>, parts INT"


@dataclass(frozen=True)
class Running:
    """The record of a batch; ``histogram`` has the counts 1 to buckets-1, ``parts`` the buckets of a segment."""

    cutoff: int | None
    histogram: list[int]
    segments: list[tuple[int, int]]
    parts: int


def updates(reads: DataFrame, config: AssemblyConfig, state: str, parts: int | None = None) -> DataStreamWriter:
    """The stream that keeps ``state``, a folder of its own on shared storage; start it with any trigger."""
    return reads.writeStream.foreachBatch(lambda batch, number: _update(batch, number, config, state, parts)).option("checkpointLocation", f"{state}/checkpoint")


def _update(batch: DataFrame, number: int, config: AssemblyConfig, state: str, parts: int | None) -> None:
    spark = batch.sparkSession
    before = _record(spark, state, number - 1) if number else _nothing(config, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = spelled_counts(batch, config).withColumnRenamed("cnt", "more").withColumn("old", F.lit(0).cast("long"))
    for segment in before.segments:
        earlier = _segment(spark, state, segment, before.parts).withColumnRenamed("cnt", "earlier")
        met = met.join(earlier, "kmer", "left").withColumn("old", F.col("old") + F.coalesce("earlier", F.lit(0))).drop("earlier")
    met = met.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        histogram = _moved(met, before.histogram)
        some = before.cutoff is not None or bool(met.take(1))
        cutoff = _first_least(histogram) if some else None
        segments = _written_segments(met, number, state, before)
        now = Running(cutoff, histogram, segments, before.parts)
        _crossing(met, state, before, now).write.mode("overwrite").parquet(f"{state}/changes/batch={number}")
    finally:
        met.unpersist()
    row = [(now.cutoff, now.histogram, now.segments, now.parts)]
    spark.createDataFrame(row, RECORD).coalesce(1).write.mode("overwrite").parquet(f"{state}/records/batch={number}")


def _nothing(config: AssemblyConfig, parts: int) -> Running:
    return Running(None, [0] * max(0, config.buckets - 1), [], parts)


def _record(spark: SparkSession, state: str, number: int) -> Running:
    r = spark.read.schema(RECORD).parquet(f"{state}/records/batch={number}").first()
    return Running(r.cutoff, list(r.histogram), [(s.first, s.last) for s in r.segments], r.parts)


def _first_least(histogram: list[int]) -> int:
    return 1 + histogram.index(min(histogram)) if histogram else 1


def _moved(met: DataFrame, histogram: list[int]) -> list[int]:
    """The histogram after the batch: each k-mer leaves its old bucket for its new one."""
    steps = F.array(F.struct((F.col("old") + F.col("more")).alias("bucket"), F.lit(1).alias("n")), F.struct(F.col("old").alias("bucket"), F.lit(-1).alias("n")))
    moves = met.select(F.inline(steps)).where(F.col("bucket").between(1, len(histogram)))
    out = list(histogram)
    for r in moves.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r.bucket - 1] += r.n
    return out


def _table_of(state: str, segment: tuple[int, int]) -> tuple[str, str]:
    path = f"{state}/segments/{segment[0]}-{segment[1]}"
    return path, "kmer_segment_" + hashlib.md5(path.encode()).hexdigest()


def _segment(spark: SparkSession, state: str, segment: tuple[int, int], parts: int) -> DataFrame:
    path, name = _table_of(state, segment)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COUNTS}) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {parts} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _summed(spark: SparkSession, state: str, segments: list[tuple[int, int]], *more: DataFrame) -> DataFrame:
    """(kmer, cnt) over segments and other tables.

    Segments are read as plain files here: a union of bucketed scans says that it is
    partitioned by k-mer, but its partitions are only strung together.
    """
    tables = [spark.read.schema(COUNTS).parquet(_table_of(state, s)[0]) for s in segments] + list(more)
    return reduce(DataFrame.unionByName, tables).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def _written_segments(met: DataFrame, number: int, state: str, before: Running) -> list[tuple[int, int]]:
    """Write the batch's counts, together with the segments that a binary counter would carry over."""
    kept, first = list(before.segments), number
    while kept and kept[-1][1] - kept[-1][0] == number - first:
        first = kept.pop()[0]
    counts = _summed(met.sparkSession, state, before.segments[len(kept) :], met.select("kmer", F.col("more").alias("cnt")))
    path, name = _table_of(state, (first, number))
    rows = counts.repartition(before.parts, "kmer").write.mode("overwrite").format("parquet")
    rows.bucketBy(before.parts, "kmer").sortBy("kmer").option("path", path).saveAsTable(name)
    return [*kept, (first, number)]


def _crossing(met: DataFrame, state: str, before: Running, now: Running) -> DataFrame:
    """k-mers that are valid now and were not, or were and are not."""
    rows = met.select("kmer", "old", (F.col("old") + F.col("more")).alias("cnt"))
    if before.cutoff not in (None, now.cutoff):
        rows = _summed(met.sparkSession, state, now.segments).join(rows.select("kmer", "old"), "kmer", "left").select("kmer", F.coalesce("old", "cnt").alias("old"), "cnt")
    was = F.lit(False) if before.cutoff is None else F.col("old") >= before.cutoff
    valid = F.lit(False) if now.cutoff is None else F.col("cnt") >= now.cutoff
    return rows.select("kmer", "cnt", valid.alias("valid"), was.alias("was")).where("valid != was").drop("was")


def latest(spark: SparkSession, state: str, config: AssemblyConfig) -> tuple[int, Running]:
    """Number and record of the last batch that was finished; -1 before the first."""
    try:
        number = spark.read.schema(f"{RECORD}, batch INT").parquet(f"{state}/records").agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        number = None
    return (-1, _nothing(config, 1)) if number is None else (number, _record(spark, state, number))


def running_counts(spark: SparkSession, state: str, config: AssemblyConfig) -> DataFrame:
    """(kmer, cnt) of all batches so far."""
    _, now = latest(spark, state, config)
    return _summed(spark, state, now.segments) if now.segments else spark.createDataFrame([], COUNTS)


def running_histogram(spark: SparkSession, state: str, config: AssemblyConfig) -> DataFrame:
    """(bucket, n), as ``operators.histogram.count_histogram`` would give it for all batches so far."""
    _, now = latest(spark, state, config)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(now.histogram)], "bucket BIGINT, n BIGINT")


def changes(spark: SparkSession, state: str, config: AssemblyConfig) -> DataFrame:
    """(kmer, cnt, valid, batch): each crossing of the cut-off, with the count it happened at."""
    number, _ = latest(spark, state, config)
    if number < 0:
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(CHANGES).parquet(f"{state}/changes").where(F.col("batch") <= number)


def running_valid(spark: SparkSession, state: str, config: AssemblyConfig) -> DataFrame:
    """(kmer, cnt) of the k-mers whose last crossing made them valid."""
    last = changes(spark, state, config).groupBy("kmer").agg(F.max_by("valid", "batch").alias("valid")).where("valid")
    return running_counts(spark, state, config).join(last.select("kmer"), "kmer", "left_semi")
