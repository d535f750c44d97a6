"""A training-data pipeline over ``documents``, from raw texts to token ids.

Stages, each on all that the one before kept:

1. quality rules: documents that the rules reject go;
2. n-gram Jaccard join: of each group of linked documents the one of smallest id stays;
3. suffix-array dedup: repeated passages are cut out of the texts;
4. mixing to target weights: rows are repeated or dropped to meet the sources' shares;
5. SentencePiece encoding: the ids of every text that is left.

All but the last return the columns of ``documents``.

Defined results: null and empty texts and rows with a null source, language or doc_id
are judged as each stage says (quality rules reject texts without ten words); of rows
that repeat a doc_id and its text one stays; equal texts are one group, of which the
smallest doc_id stays; an empty table passes through all stages; extra columns are
kept up to the last stage, whatever their names; very long texts are kept whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm import jaccard, mixing, quality, sentencepieces, suffixdedup
from strandloom.llm.queries import tokenizer_file
from strandloom.llm.storage import written
from strandloom.session import ship_package


def ready(spark: SparkSession) -> None:
    """Ship the package, and send texts to Python in batches of 8 MB, which bounds a worker's memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    out = suffixdedup.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return sentencepieces.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: SQL cannot express the merges of pieces; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
