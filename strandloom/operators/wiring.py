"""Flow balancing and the pairing of incoming with outgoing flow in each node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def node_flow(ext: DataFrame) -> DataFrame:
    """(node, pc, sc): visits of the non-empty prefixes and suffixes."""
    own = lambda side: F.coalesce(F.sum(F.when((F.col("side") == side) & (F.col("seq") != ""), F.col("visit"))), F.lit(0))
    return ext.groupBy("node").agg(own("P").alias("pc"), own("S").alias("sc"))


def ends(ext: DataFrame) -> DataFrame:
    """The terminal extensions alone that ``balanced`` adds to extensions without any."""
    of = lambda side: F.count(F.when(F.col("side") == side, 1)).cast("int")
    own = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("visit"))), F.lit(0))
    flow = ext.groupBy("node").agg(own("P").alias("pc"), own("S").alias("sc"), of("P").alias("np"), of("S").alias("ns"))
    both = F.array(
        F.struct(F.lit("P").alias("side"), F.col("np").alias("idx"), F.greatest(F.col("sc") - F.col("pc"), F.lit(0)).cast("int").alias("visit")),
        F.struct(F.lit("S").alias("side"), F.col("ns").alias("idx"), F.greatest(F.col("pc") - F.col("sc"), F.lit(0)).cast("int").alias("visit")),
    )
    return flow.select("node", F.explode(both).alias("e")).select("node", "e.side", "e.idx", "e.visit", F.lit(True).alias("terminal"))


def balanced(ext: DataFrame) -> DataFrame:
    """Extensions with one empty terminal extension more on each side, which takes up the missing flow.

    One pass: a node's sums stand beside its rows, and its first row brings both ends along.
    """
    node = Window.partitionBy("node")
    of = lambda side: F.count(F.when(F.col("side") == side, 1)).over(node).cast("int")
    own = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("visit"))).over(node), F.lit(0))
    fields = [f for f in ext.schema if f.name != "node"]
    row = lambda **given: F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    end = lambda side, idx, flow: row(side=F.lit(side), idx=F.col(idx), seq=F.lit(""), cnt=F.lit(1), visit=F.greatest(flow, F.lit(0)), terminal=F.lit(True))
    itself, place = row(**{f.name: F.col(f.name) for f in fields}), F.struct("side", "idx")
    flow = ext.withColumns({"pc": own("P"), "sc": own("S"), "np": of("P"), "ns": of("S"), "is_first": F.min(place).over(node) == place})
    ends = F.array(itself, end("P", "np", F.col("sc") - F.col("pc")), end("S", "ns", F.col("pc") - F.col("sc")))
    return flow.select("node", F.explode(F.when(F.col("is_first"), ends).otherwise(F.array(itself))).alias("e")).select("node", "e.*").select(*ext.columns)


def ranked(ext: DataFrame) -> DataFrame:
    """Extensions with flow, their rank by (visit, cnt, idx) and the flow before them on their side."""
    order = Window.partitionBy("node", "side").orderBy(F.desc("visit"), F.desc("cnt"), "idx")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    out = ext.withColumn("rank", F.row_number().over(order) - 1)
    return out.withColumn("start", F.coalesce(F.sum("visit").over(running), F.lit(0)).cast("int"))


def paired(ext: DataFrame, *fields: str) -> DataFrame:
    """(node, at, p, s, cnt): overlaps of prefix and suffix flow intervals of a node, with both extensions.

    ``p`` and ``s`` hold idx, start and visit of the extensions, and the other ``fields``.
    The intervals of a side follow each other without gaps, so each overlap begins where
    an interval of either side does: the starts of both are sorted once a node, and the
    open prefix and suffix are carried along, which is linear in a node's extensions.
    """
    flow = ranked(ext).where("visit > 0")
    row = F.struct("start", "visit", "idx", *fields)
    own = lambda side: F.max(F.when(F.col("side") == side, row))
    cuts = flow.groupBy("node", F.col("start").alias("at")).agg(own("P").alias("p"), own("S").alias("s"))
    along = Window.partitionBy("node").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    cuts = cuts.select("node", "at", *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in "ps"], F.lead("at").over(along).alias("next"))
    end = F.least(F.col("p.start") + F.col("p.visit"), F.col("s.start") + F.col("s.visit"))
    end = F.least(F.coalesce("next", end), end)
    return cuts.where("p IS NOT NULL AND s IS NOT NULL").withColumn("cnt", end - F.col("at")).where("cnt > 0").drop("next")


def wires(ext: DataFrame) -> DataFrame:
    """(node, p_idx, s_idx, off_p, off_s, cnt) of all nodes."""
    off = lambda c: (F.col("at") - F.col(f"{c}.start")).alias(f"off_{c}")
    return paired(ext).select("node", F.col("p.idx").alias("p_idx"), F.col("s.idx").alias("s_idx"), off("p"), off("s"), "cnt")
