"""Count histogram, automatic cut-off and frequency filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def count_histogram(kmers: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) for counts 1 to buckets-1; empty buckets are 0."""
    found = kmers.where(F.col("cnt") < buckets).groupBy(F.col("cnt").alias("bucket")).agg(F.count("*").alias("n"))
    return _filled(found, buckets)


def histogram_of_runs(runs: DataFrame, buckets: int) -> DataFrame:
    """``count_histogram`` of ``packed.summed_runs``, whose rows hold their own figures."""
    found = runs.select(F.posexplode("few").alias("at", "n")).groupBy((F.col("at") + 1).cast("long").alias("bucket")).agg(F.sum("n").alias("n"))
    return _filled(found, buckets)


def _filled(found: DataFrame, buckets: int) -> DataFrame:
    every = found.sparkSession.range(1, max(1, buckets), 1, 1).select(F.col("id").alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def min_bucket(kmers: DataFrame, buckets: int) -> int:
    """First bucket of least count; 1 if there is only one."""
    return 1 if buckets <= 1 else least_bucket(count_histogram(kmers, buckets))


def least_bucket(counts: DataFrame) -> int:
    return counts.orderBy("n", "bucket").first()["bucket"]


def valid_kmers(kmers: DataFrame, buckets: int) -> DataFrame:
    return kmers.where(F.col("cnt") >= min_bucket(kmers, buckets))


class NothingLeft(ValueError):
    """No k-mer reached the cut-off."""
