"""FASTA in and out, and reads from tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandloom.session import checkpointed

#: Letters in a chunk of a contig, and on a line of a file.
CHUNK = 1 << 16


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, header, seq) of every record; a record may have several lines.

    Files are split by Spark at record marks, so ids are unique but not dense.  A
    mark inside a header starts a record of its own.
    """
    records = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\n", 2)
    body = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s", "")
    return records.select(F.monotonically_increasing_id().alias("read_id"), F.rtrim(F.regexp_replace(parts[0], "\r", "")).alias("header"), body.alias("seq"))


def reads_from_table(table: DataFrame, read_id: str, text: str) -> DataFrame:
    """Reads made of the base letters of a text column, in upper case."""
    seq = F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^ACGTacgt]+", ""))
    return table.select(F.col(read_id).cast("long").alias("read_id"), F.col(read_id).cast("string").alias("header"), seq.alias("seq"))


def numbered(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows with their number ``n`` in the order of ``keys``.

    Rows are sorted by ranges, and a range begins where the one before it ends, so
    that no single task sorts all of them.
    """
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    # The id is the range's number, then 33 bits of the row's place in it.
    ranged = checkpointed(ranged.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    sizes = sizes.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(sizes), "range").withColumn("n", F.col("before") + F.col("at")).drop("range", "before", "at")


def chunks_of(contigs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(contig, origin, chunk, text) of whole contigs (seq, origin)."""
    rows = checkpointed(contigs.withColumn("contig", F.monotonically_increasing_id()))
    text = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return rows.select("contig", "origin", F.posexplode(text).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


def contig_names(chunks: DataFrame, min_length: int) -> DataFrame:
    """(contig, origin, n, name) of the contigs longer than ``min_length``, numbered by length, digest and origin.

    A contig's digest is the hash of its chunks' hashes, so order asks for no whole contig.
    """
    own = chunks.select("contig", "origin", "chunk", F.length("text").cast("long").alias("letters"), F.sha2("text", 256).alias("h"))
    hashes = F.array_sort(F.collect_list(F.struct("chunk", "h")))
    digest = F.sha2(F.array_join(F.transform(hashes, lambda x: x["h"]), ""), 256)
    kept = own.groupBy("contig", "origin").agg(F.sum("letters").alias("len"), digest.alias("digest")).where(F.col("len") > min_length)
    rows = numbered(kept, [F.desc("len"), F.asc("digest"), F.asc("origin"), F.asc("contig")])
    return rows.select("contig", "origin", "n", F.concat(F.lit("contig_"), "n", F.lit("_l_"), "len", F.lit("_r_0")).alias("name"))


def named_chunks(chunks: DataFrame, min_length: int) -> DataFrame:
    """(n, name, origin, chunk, text) of the contigs longer than ``min_length``."""
    return chunks.join(contig_names(chunks, min_length), ["contig", "origin"]).select("n", "name", "origin", "chunk", "text")


def write_chunks(chunks: DataFrame, path: str, min_length: int = 400, parts: int | None = None) -> None:
    """Write contigs as FASTA text: a name and a line a chunk, in order, a contig in one file.

    Contigs are dealt out by ranges of their numbers and sorted there, so a task streams
    lines and holds one chunk at a time.
    """
    named = named_chunks(chunks, min_length)
    head = named.where("chunk = 0").select("n", F.lit(-1).cast("long").alias("chunk"), F.concat(F.lit(">"), "name").alias("value"))
    lines = head.unionByName(named.select("n", "chunk", F.col("text").alias("value")))
    dealt = lines.repartitionByRange("n") if parts is None else lines.repartitionByRange(parts, "n")
    dealt.sortWithinPartitions("n", "chunk").select("value").write.text(path)


def numbered_contigs(contigs: DataFrame, min_length: int) -> DataFrame:
    """(name, seq, len, origin) of whole contigs longer than ``min_length``, by length, sequence and origin."""
    kept = contigs.where(F.length("seq") > min_length).select("seq", F.length("seq").alias("len"), "origin")
    rows = numbered(kept, [F.desc("len"), F.asc("seq"), F.asc("origin")])
    return rows.select(F.concat(F.lit("contig_"), "n", F.lit("_l_"), "len", F.lit("_r_0")).alias("name"), "seq", "len", "origin")


def write_fasta(contigs: DataFrame, path: str, min_length: int = 400, parts: int | None = None) -> None:
    """Write whole contigs (seq, origin) as FASTA text."""
    write_chunks(chunks_of(contigs), path, min_length, parts)
