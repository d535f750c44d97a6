"""Shared working folders and small helpers for writing and rereading tables.

Executors can be lost, so lineage is cut with written tables in the folder that
``spark.checkpoint.dir`` names.  Only where that setting is absent (small local
tests) a temporary folder is set up.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the session's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def fresh_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``docs`` has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
