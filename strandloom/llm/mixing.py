"""Mixing sources to target weights.

Every document gets a hash-random key.  Keys are uniform, so equal slices of the
key space are a range partition whose bounds are known beforehand: each
(source, slice) is summed on its own, the sums are scanned in slice order, and
documents are then placed by a running sum inside their slice.  A hot source is
thus spread over all slices, and slices grow in number with the documents.  A source's budget is met by whole epochs plus a cut
in the key order.

Defined results: a null text has size 0; a null source is a source of its own and
comes last; rows without a doc_id are in the order of their texts' hashes; rows with equal keys are ordered by doc_id and size, and rows that
agree in all of these are interchangeable; sources without words have target 0;
an empty table gives no rows; other columns are kept, whatever their names; a very
long text counts by its words like any other.  Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import fresh_names, written

WORD = r"[^\x20\x09-\x0D]+"


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform in the ids; rows without an id go by their text."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), text), F.lit(""))))


def digits_for(rows: int, slice_rows: int) -> int:
    """Hexadecimal digits of the key that make slices of at most ``slice_rows`` rows on average; at least 3."""
    digits = 3
    while rows > slice_rows * 16**digits:
        digits += 1
    return digits


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """Targets of (source, source_size) rows: weights cycle in code-point order.

    Shares are of the total size.  A target stops at ``limit`` times its source;
    the excess goes to the others by weight.  With sources in order of
    limit/weight, that is one level: the first source from which on nobody is
    above.  The table has one row a source, so its windows need no partitions.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    fill = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("rank", F.row_number().over(order) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("most", F.col("source_size") * limit).withColumn("ratio", F.col("most") / F.col("weight"))
    out = out.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(fill), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0))),
    )
    chosen = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(
        Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    out = out.withColumn("chosen", chosen)
    target = F.when(F.col("chosen").isNull() | (F.col("level") > F.col("ratio")), F.col("most").cast("double"))
    return out.select("source", "source_size", target.otherwise(F.col("chosen") * F.col("weight")).alias("target"))


def _placed(docs: DataFrame, weights, limit, seed, slice_rows) -> DataFrame:
    """Documents with size, target, epochs, rest of the budget and words before them."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    rows = written(rows, "mixing-sizes")
    rows = rows.withColumn("slice", F.substring("key", 1, digits_for(rows.count(), slice_rows)))

    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, limit)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "slice", F.coalesce(before, F.lit(0)).alias("slice_before"))
    plan = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    plan = plan.select("s.source", "slice", "slice_before", "source_size", "target")
    budget = F.floor(F.col("target") + 0.5)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))

    placed = rows.alias("d").join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.slice") == F.col("p.slice"))
    )
    placed = placed.select("d.doc_id", "d.source", "size", "key", "d.slice", "slice_before", "source_size", "target", "epochs", "rest")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("before", F.col("slice_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: str = "mix", slice_rows: int = 20_000
) -> DataFrame:
    """Words that the mix takes from each document; the last one of a source may be taken in part."""
    placed = _placed(docs, weights, limit, seed, slice_rows)
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3, seed: str = "mix", slice_rows: int = 20_000
) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it.

    Only whole documents go out, so the cut lies at the document nearest to the
    budget.  Texts are not shuffled: a source's cut is one (key, doc_id, size).
    """
    placed = _placed(docs, weights, limit, seed, slice_rows)
    once_more = (F.col("before") < F.col("rest")) & (2 * (F.col("rest") - F.col("before")) >= F.col("size"))
    at = F.struct("key", "doc_id", "size")
    own, epochs, cut, place, copy = fresh_names(docs, "own_source", "epochs", "cut", "place", "copy")
    cuts = placed.groupBy("source").agg(F.max("epochs").alias(epochs), F.max(F.when(once_more, at)).alias(cut))
    cuts = written(cuts.withColumnRenamed("source", own), "mixing-cuts")
    here = F.struct(random_key(F.col("doc_id"), F.col("text"), seed).alias("key"), F.col("doc_id"), word_count(F.col("text")).alias("size"))
    joined = docs.withColumn(place, here).join(cuts, F.col("source").cast("string").eqNullSafe(F.col(own)))
    copies = F.col(epochs) + F.when(F.col(place) <= F.col(cut), 1).otherwise(0)
    joined = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return joined.select(*docs.columns)


#: The same results in SQL, over the view ``documents``.
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '-' || text, '')) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sizes),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM ranked),
levels AS (
  SELECT *, most / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN (SELECT level FROM chosen) IS NULL OR level > ratio THEN most::DOUBLE
         ELSE (SELECT level FROM chosen) * weight END AS target
  FROM levels),
budgets AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs
  FROM targets),
placed AS (
  SELECT r.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed
"""
