"""A Merkle manifest of a dataset: leaf digests, one tree a language, one root, and proofs.

Leaves ascend by doc_id in their language.  A level is a window over (group, parent's
number) whose ordered whole frame lists the run: joined, it is the parent's preimage, and
without a row's own place its siblings.  One row of each run goes on as the parent.
``STOREY`` levels are built between two exchanges: their windows are also partitioned by
the number of the subtree they lie in, by which the rows were dealt out, and each parent
carries what its leaves have gathered so far.

Defined results: null columns are written as ``-`` in a leaf; a null doc_id comes before
all others of its language and is never tampered with; rows of equal doc_id are ordered by
their leaf, and equal rows are leaves of their own; an empty text is a leaf as any other; a
very long text is only hashed, where it is read; columns besides the five are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import written

STOREY = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def framed(c: Column) -> Column:
    """A value with its length in front; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, lang, leaf, tampered): the digest of every row, and the one it has after tampering, or null."""
    own = [framed(F.col(f"`{c}`")) for c in FIELDS]
    changed = [framed(F.col("n_chars") + 1) if c == "n_chars" else v for c, v in zip(FIELDS, own)]
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return docs.select(
        framed(F.col("lang")).alias("grp"), "lang", "doc_id", digest(F.concat(*own)).alias("leaf"), F.when(hit, digest(F.concat(*changed))).alias("tampered")
    )


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with their number ``i`` in their group, and the group's size ``m``.

    Rows are sorted by ranges of (group, order); a range begins where the one before
    it ends, so no task sorts a whole group.
    """
    keys = [F.asc_nulls_first(c) for c in (*group, *order)]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    # The id is the range's number, then 33 bits of the row's place in it.
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    sizes = ranged.groupBy("grp", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    along = Window.partitionBy("grp").orderBy("part")
    before = F.coalesce(F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("grp", "part", "first", before.alias("before"), F.sum("rows").over(Window.partitionBy("grp")).alias("m"))
    return ranged.join(sizes, ["grp", "part"]).withColumn("i", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before", "rows")


def storey(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """``levels`` levels above nodes (grp, i, m, h): the nodes at the top, and the digests beside each node's way up.

    A group of one node stays as it is.  Returns (grp, i, m, h) and (grp, i, up, beside),
    where ``up`` is the number of the node above at the top.
    """
    rows = nodes.withColumn("tree", F.shiftright("i", levels)).repartition("grp", "tree")
    rows = rows.select("grp", "tree", "i", "m", "h", F.array(F.struct(F.col("i").alias("i"), F.lit("").alias("beside"))).alias("below"))
    for _ in range(levels):
        whole = Window.partitionBy("grp", "tree", F.shiftright("i", 1)).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("run", F.collect_list(F.struct("h", "below")).over(whole))
        # One row of each run goes on as the parent.
        rows = rows.where(F.col("i").bitwiseAND(F.lit(1)) == 0)
        joined = F.array_join(F.transform("run", lambda x: x["h"]), "")
        siblings = lambda k: F.array_join(F.transform(F.filter("run", lambda x, j: j != k), lambda x: x["h"]), "")
        gathered = F.flatten(
            F.transform("run", lambda x, k: F.transform(x["below"], lambda y: F.struct(y["i"].alias("i"), F.concat(y["beside"], siblings(k)).alias("beside"))))
        )
        alone = F.col("m") == 1
        rows = rows.select(
            "grp", "tree", F.shiftright("i", 1).alias("i"), F.shiftright(F.col("m") + 1, 1).alias("m"),
            F.when(alone, F.col("h")).otherwise(digest(joined)).alias("h"), F.when(alone, F.col("below")).otherwise(gathered).alias("below"),
        )
    rows = written(rows, "merkle-storey")
    ways = rows.select("grp", F.col("i").alias("up"), F.explode("below").alias("b")).select("grp", "b.i", "up", "b.beside")
    return rows.select("grp", "i", "m", "h"), ways


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (grp, i, m, h): (grp, top) and (grp, i, beside), the digests beside each node's way to the top."""
    deep = int(nodes.agg(F.coalesce(F.max("m"), F.lit(1)).alias("m")).first()["m"] - 1).bit_length()
    floors = []
    while deep > 0:
        levels = min(STOREY, deep)
        nodes, ways = storey(nodes, levels)
        floors.append(ways)
        deep -= levels
    top = nodes.select("grp", F.col("h").alias("top"))
    if not floors:
        return top, nodes.select("grp", "i", F.lit("").alias("beside"))
    beside = floors.pop()
    while floors:  # from the top down: what lies beside a storey's top goes behind what lies beside its nodes
        above = beside.select("grp", F.col("i").alias("up"), F.col("beside").alias("above"))
        beside = floors.pop().join(above, ["grp", "up"]).select("grp", "i", F.concat("beside", "above").alias("beside"))
    return top, beside


def folded(h: Column, beside: Column, i: Column, m: Column) -> Column:
    """The digest at the top of a way up from ``h``, the ``i``-th of ``m`` nodes, with the digests beside it."""

    def up(state: Column, _: Column) -> Column:
        alone, last = state["m"] == 1, (state["i"] + 1 == state["m"]) & (state["i"].bitwiseAND(F.lit(1)) == 0)
        other = F.substr(beside, state["at"] + 1, F.lit(64))
        joined = F.when(last, state["h"]).when(state["i"].bitwiseAND(F.lit(1)) == 0, F.concat(state["h"], other)).otherwise(F.concat(other, state["h"]))
        return F.struct(
            F.when(alone, state["h"]).otherwise(digest(joined)).alias("h"),
            F.shiftright(state["i"], 1).alias("i"),
            F.shiftright(state["m"] + 1, 1).alias("m"),
            (state["at"] + F.when(alone | last, 0).otherwise(64)).alias("at"),
        )

    levels = F.ceil(F.log2(F.greatest(m, F.lit(1)).cast("double"))) + 1  # one more does nothing
    first = F.struct(h.alias("h"), i.cast("long").alias("i"), m.cast("long").alias("m"), F.lit(0).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), levels), first, up)["h"]


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    rows = numbered(written(leaves(docs), "merkle-leaves"), ["grp", "lang"], ["doc_id", "leaf"])
    rows = written(rows, "merkle-leaves")
    subroots, beside = tree(rows.select("grp", "i", "m", F.col("leaf").alias("h")))
    # One node a language: these are few, and ordered as the languages are.
    langs = rows.groupBy("grp", "lang").agg(F.max("m").alias("m")).select(F.lit(0).alias("of"), "grp", "lang")
    nodes = numbered(langs.join(subroots, "grp").select(F.col("grp").alias("key"), F.lit("").alias("grp"), "lang", F.col("top").alias("subroot")), ["grp"], ["lang"])
    nodes = written(nodes, "merkle-subroots")
    root, above = tree(nodes.select("grp", "i", "m", F.col("subroot").alias("h")))
    nodes = nodes.join(above.select("i", F.col("beside").alias("above")), "i").join(root.select("grp", F.col("top").alias("root")), "grp")
    nodes = nodes.select(F.col("key").alias("grp"), "subroot", "root", "above", F.col("i").alias("j"), F.col("m").alias("n"))
    out = rows.join(beside, ["grp", "i"]).join(nodes, "grp")
    start = F.coalesce("tampered", "leaf")
    refolded = folded(folded(start, F.col("beside"), F.col("i"), F.col("m")), F.col("above"), F.col("j"), F.col("n"))
    out = out.withColumn("folded_root", refolded)
    return out.select(
        "doc_id", "leaf", "subroot", "root", digest(F.concat("beside", "above")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: CRC-32 of a short string, a bit at a time from the lowest bit of each byte.
_CRC_SQL = """(list_reduce(list_prepend(4294967295::BIGINT, flatten([[((ascii(c) >> b) & 1)::BIGINT FOR b IN range(0, 8)] FOR c IN string_split(doc_id::VARCHAR, '')])),
    lambda s, b: CASE WHEN (xor(s, b) & 1) = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))"""


def _framed_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_framed_sql(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


def _tree_sql(nodes: str) -> str:
    return f"SELECT grp, 0 AS lvl, i, m, h FROM {nodes}"


def _next_level_sql(name: str) -> str:
    return f"SELECT grp, lvl + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE m > 1 GROUP BY grp, lvl, i // 2, m"


def _way_sql(ways: str, tree: str) -> str:
    return f"""
      SELECT w.id, w.grp, w.lvl + 1, w.i // 2, (w.m + 1) // 2, w.beside || coalesce(s.h, ''),
        sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.i % 2 = 0 THEN w.h || s.h ELSE s.h || w.h END)
      FROM {ways} w LEFT JOIN {tree} s ON s.grp = w.grp AND s.lvl = w.lvl AND s.i = xor(w.i, 1) WHERE w.m > 1"""


MANIFEST_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_framed_sql("lang")} AS grp, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN xor({_CRC_SQL}, 4294967295) % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY grp, doc_id, leaf) AS id, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY grp) AS m, leaf AS h
  FROM hashed),
low AS ({_tree_sql("leaves")} UNION ALL {_next_level_sql("low")}),
langs AS (
  SELECT '' AS grp, n.grp AS own, n.h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS m
  FROM low n JOIN (SELECT DISTINCT grp, lang FROM leaves) l ON n.grp = l.grp WHERE n.m = 1),
high AS ({_tree_sql("langs")} UNION ALL {_next_level_sql("high")}),
low_ways AS (SELECT id, grp, 0 AS lvl, i, m, '' AS beside, coalesce(tampered, leaf) AS h FROM leaves UNION ALL {_way_sql("low_ways", "low")}),
high_ways AS (
  SELECT w.id, l.grp, 0 AS lvl, l.i, l.m, w.beside, w.h FROM low_ways w JOIN langs l ON l.own = w.grp WHERE w.m = 1
  UNION ALL {_way_sql("high_ways", "high")})
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(w.beside) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM leaves l JOIN langs s ON s.own = l.grp JOIN (SELECT h FROM high WHERE m = 1) r ON true JOIN (SELECT * FROM high_ways WHERE m = 1) w ON w.id = l.id"""
