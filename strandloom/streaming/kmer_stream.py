"""Running k-mer counts over a folder of FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.config import AssemblyConfig
from strandloom.operators.kmers import extracted


def read_fasta_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    rows = spark.readStream.option("lineSep", ">").option("maxFilesPerTrigger", files_per_trigger).text(path)
    body = F.coalesce(F.try_element_at(F.split("value", "\n", 2), F.lit(2)), F.lit(""))
    return rows.select(F.regexp_replace(body, r"\s", "").alias("seq")).where("seq <> ''")


def kmer_count_stream(reads: DataFrame, config: AssemblyConfig) -> DataFrame:
    """(kmer, cnt) to be written in ``update`` or ``complete`` mode; counting is associative."""
    return extracted(reads, config.k, "kmer", config.alphabet).groupBy("kmer").agg(F.count("*").alias("cnt"))
