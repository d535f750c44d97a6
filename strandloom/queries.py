"""The registered assembly queries, over reads made of ``documents``, and their SQL.

Sequences are shown as digits in key order (A=0 C=1 T=2 G=3) unless a query says
otherwise.  Queries that need the graph count k-mers once, by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.config import AssemblyConfig
from strandloom.functions import sequence as S
from strandloom.operators import compaction, cycles, graph, histogram, kmers, packed, walk, wiring
from strandloom.plans import assembly
from strandloom.session import shared_path, spread, written
from strandloom.sources import fasta
from strandloom.streaming import running_counts

CONFIG = AssemblyConfig(k=21, minimizer=8, coverage=1, buckets=3, node_limit=None)
#: For queries that contract: nodes at which they stop, at every size.
NODE_LIMIT = 20_000
MIN_CONTIG = 100
#: Letters a chunk of the contigs' files.
CHUNK = 64
#: Micro-batches of the registered streams.
STREAM_FILES = 5


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(fasta.reads_from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").select("read_id", "seq"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that ``reads`` are made of; counting drops what is no base."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("seq")))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.spelled_counts(_texts(spark, sf_dir), CONFIG, bases_only=True)


def _packed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.packed_counts(_texts(spark, sf_dir), CONFIG, bases_only=True)


def _lmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.lmer_frequencies(_texts(spark, sf_dir), CONFIG, bases_only=True)


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.valid(_texts(spark, sf_dir), CONFIG, bases_only=True)[0]


def _ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.extensions(_valid(spark, sf_dir), CONFIG)


def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiring.balanced(_ext(spark, sf_dir))


def read_count(spark, sf_dir):
    return reads(spark, sf_dir).agg(F.count("*").alias("n"))


def base_encode(spark, sf_dir):
    return reads(spark, sf_dir).select("read_id", S.encode(F.col("seq")).alias("code"))


def kmer_total_distinct(spark, sf_dir):
    return _packed_counts(spark, sf_dir).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"), F.count("*").alias("distinct_kmers"))


def minimizer(spark, sf_dir):
    return kmers.counted_minimizers(_texts(spark, sf_dir), CONFIG, bases_only=True).select("kmer", "minimizer", "pos")


def kmer_count_packed(spark, sf_dir):
    """The counts by packed keys, unpacked at the end."""
    return _packed_counts(spark, sf_dir).select(packed.unpacked(F.col("key"), CONFIG.k).alias("kmer"), "cnt")


def kmer_count_by_runs(spark, sf_dir):
    """The counts by runs of one minimizer."""
    return packed.counts_by_runs(reads(spark, sf_dir), _lmers(spark, sf_dir), CONFIG)


def owner_hash(spark, sf_dir):
    h = S.hash31(S.number(F.col("lmer")))
    return _lmers(spark, sf_dir).select("lmer", h.alias("h31"), F.pmod(h, F.lit(CONFIG.owners)).alias("owner"))


def owner_load(spark, sf_dir):
    return kmers.owner_load(kmers.counted_minimizers(_texts(spark, sf_dir), CONFIG, bases_only=True), CONFIG)


def count_histogram(spark, sf_dir):
    return histogram.count_histogram(_packed_counts(spark, sf_dir), CONFIG.buckets)


def min_bucket(spark, sf_dir):
    return histogram.count_histogram(_packed_counts(spark, sf_dir), CONFIG.buckets).orderBy("n", "bucket").limit(1).select("bucket")


def pred_succ(spark, sf_dir):
    return graph.pred_succ(_valid(spark, sf_dir), CONFIG)


def nodes(spark, sf_dir):
    return graph.nodes(_valid(spark, sf_dir), CONFIG)


def suffix_ext(spark, sf_dir):
    return _ext(spark, sf_dir).where("side = 'S'").select("node", "idx", "seq", "cnt", "visit")


def prefix_ext(spark, sf_dir):
    return _ext(spark, sf_dir).where("side = 'P'").select("node", "idx", "seq", "cnt", "visit")


def macro_nodes(spark, sf_dir):
    nested = graph.macro_nodes(_balanced(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["seq"], x["cnt"].cast("string"), x["visit"].cast("string"))), ",")
    return nested.select("node", text("prefixes").alias("prefixes"), text("suffixes").alias("suffixes"))


def node_flow(spark, sf_dir):
    return wiring.node_flow(_ext(spark, sf_dir))


def ext_rank(spark, sf_dir):
    return wiring.ranked(_balanced(spark, sf_dir)).select("node", "side", "idx", "rank", "start")


def wires(spark, sf_dir):
    return wiring.wires(_balanced(spark, sf_dir))


def neighbours(spark, sf_dir):
    return compaction.neighbours(_balanced(spark, sf_dir), CONFIG)


def id_set(spark, sf_dir):
    return compaction.independent_set(_balanced(spark, sf_dir), CONFIG)


def self_loops(spark, sf_dir):
    return compaction.self_loops(_balanced(spark, sf_dir), CONFIG)


def _round_one(spark, sf_dir):
    """The flagged extensions and the wires of the chosen nodes; both go on from one exchange by node."""
    flagged = compaction.chosen_first(_balanced(spark, sf_dir), CONFIG)
    return flagged, compaction.wired_pairs(flagged.where("chosen").drop("chosen"))


def transfers_r1(spark, sf_dir):
    return compaction.transfers(_round_one(spark, sf_dir)[1], CONFIG)


def partial_contigs_r1(spark, sf_dir):
    return compaction.partial_contigs(_round_one(spark, sf_dir)[1])


def ext_after_r1(spark, sf_dir):
    flagged, pairs = _round_one(spark, sf_dir)
    return compaction.applied(flagged, compaction.transfers(pairs, CONFIG))


def nodes_after_r1(spark, sf_dir):
    return ext_after_r1(spark, sf_dir).select("node").distinct()


def rewired_r1(spark, sf_dir):
    return wiring.wires(ext_after_r1(spark, sf_dir))


def _contracted(spark, sf_dir):
    config = AssemblyConfig(k=CONFIG.k, minimizer=CONFIG.minimizer, buckets=CONFIG.buckets, node_limit=NODE_LIMIT)
    return compaction.contract(_balanced(spark, sf_dir), config)


def compaction_stats(spark, sf_dir):
    return assembly.statistics_table(spark, _contracted(spark, sf_dir).statistics)


def begin_nodes(spark, sf_dir):
    return walk.begin_nodes(wiring.ends(_ext(spark, sf_dir)))


def _walked(spark, sf_dir, mode):
    config = AssemblyConfig(k=CONFIG.k, minimizer=CONFIG.minimizer, buckets=CONFIG.buckets, node_limit=None, walk=mode)
    return walk.walk_contigs(_balanced(spark, sf_dir), config).select(S.decode(F.col("seq")).alias("seq"))


def walk_contigs(spark, sf_dir):
    return _walked(spark, sf_dir, "reference")


def walk_contigs_full_flow(spark, sf_dir):
    return _walked(spark, sf_dir, "full_flow")


def partial_contigs(spark, sf_dir):
    """Contigs that contraction itself completes, all rounds."""
    return _contracted(spark, sf_dir).partial.select(S.decode(F.col("seq")).alias("seq"))


def ext_contracted(spark, sf_dir):
    """The graph that is left at the node limit."""
    return _contracted(spark, sf_dir).ext


def contigs_final(spark, sf_dir):
    done = _contracted(spark, sf_dir)
    found = walk.walk_contigs(done.ext, CONFIG)
    both = done.partial.withColumn("origin", F.lit("partial")).unionByName(found.withColumn("origin", F.lit("walk")))
    return both.select(S.decode(F.col("seq")).alias("seq"), F.length("seq").alias("len"), "origin")


def fasta_reads(spark, sf_dir):
    """The reads written as FASTA and read back by the source, empty ones too."""
    path = shared_path(spark, "reads-fasta")
    rows = reads(spark, sf_dir).select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), "seq").alias("value"))
    rows.write.text(path)
    return fasta.read_fasta(spark, path).select("header", "seq")


def visits_by_3(spark, sf_dir):
    """Visits at a coverage of 3, where counts are not multiples of it."""
    config = AssemblyConfig(k=CONFIG.k, minimizer=CONFIG.minimizer, coverage=3, buckets=CONFIG.buckets)
    return graph.extensions(_valid(spark, sf_dir), config).select("node", "side", "idx", "visit")


def histogram_of_21(spark, sf_dir):
    """Counts up to 20: buckets that tie and buckets that are empty."""
    return histogram.count_histogram(_packed_counts(spark, sf_dir), 21)


def min_bucket_of_21(spark, sf_dir):
    return histogram_of_21(spark, sf_dir).orderBy("n", "bucket").limit(1).select("bucket")


def valid_kmer_count(spark, sf_dir):
    return _valid(spark, sf_dir).agg(F.count("*").alias("n"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("occurrences"))


def _chunks(spark, sf_dir):
    """The walks' chunks, written once: names, ranges and lines each read them."""
    chunks = walk.walk_chunks(_balanced(spark, sf_dir), CONFIG, CHUNK)
    return written(chunks.withColumn("text", S.decode(F.col("text"))).withColumn("origin", F.lit("walk")), "contig-chunks")


def contig_fasta(spark, sf_dir):
    """Named contigs as they are written, a line a chunk."""
    named = fasta.named_chunks(_chunks(spark, sf_dir), MIN_CONTIG)
    return named.select("name", "chunk", F.col("text").alias("seq"))


def contigs_read_back(spark, sf_dir):
    """The contigs written as FASTA and read back by the source, whole."""
    path = shared_path(spark, "contigs-fasta")
    fasta.write_chunks(_chunks(spark, sf_dir), path, MIN_CONTIG)
    return fasta.read_fasta(spark, path).select("header", "seq")


def phase_figures(spark, sf_dir):
    """What each phase of a whole assembly read, made and kept, observed on the way."""
    config = AssemblyConfig(k=CONFIG.k, minimizer=CONFIG.minimizer, buckets=CONFIG.buckets, node_limit=NODE_LIMIT)
    return assembly.figures_table(spark, assembly.assemble(reads(spark, sf_dir), config).figures).where("figure <> 'doublings'")


def flow_cycles(spark, sf_dir):
    """Flow that goes round and that no walk takes up."""
    return cycles.cycles(_balanced(spark, sf_dir), CONFIG).select(S.decode(F.col("seq")).alias("seq"), "flow")


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """The state of a stream that took the reads in STREAM_FILES micro-batches."""
    source, state = shared_path(spark, "stream-reads"), shared_path(spark, "stream-state")
    rows = reads(spark, sf_dir)
    files = -(-rows.rdd.getNumPartitions() // STREAM_FILES)  # of a batch, so that a task's share does not grow with the table
    rows.repartition(files * STREAM_FILES).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
    running_counts.updates(stream, CONFIG, state).trigger(availableNow=True).start().awaitTermination()
    return state


def stream_histogram(spark, sf_dir):
    """The histogram as a stream kept it, by differences."""
    return running_counts.running_histogram(spark, _streamed(spark, sf_dir), CONFIG)


def stream_valid_kmers(spark, sf_dir):
    """The k-mers that a stream reported to have crossed the moving cut-off and not to have fallen below it again."""
    return running_counts.running_valid(spark, _streamed(spark, sf_dir), CONFIG)


def lost_flow(spark, sf_dir):
    """Flow between two self-loops of a node, which its contraction drops."""
    return assembly.lost_flow(_balanced(spark, sf_dir), CONFIG)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "reads": reads,
    "read_count": read_count,
    "base_encode": base_encode,
    "lmer_freq": _lmers,
    "kmer_count": _counts,
    "kmer_count_packed": kmer_count_packed,
    "kmer_count_by_runs": kmer_count_by_runs,
    "kmer_total_distinct": kmer_total_distinct,
    "minimizer": minimizer,
    "owner_hash": owner_hash,
    "owner_load": owner_load,
    "count_histogram": count_histogram,
    "min_bucket": min_bucket,
    "valid_kmers": _valid,
    "pred_succ": pred_succ,
    "nodes": nodes,
    "suffix_ext": suffix_ext,
    "prefix_ext": prefix_ext,
    "macro_nodes": macro_nodes,
    "node_flow": node_flow,
    "balanced_ext": _balanced,
    "ext_rank": ext_rank,
    "wires": wires,
    "neighbours": neighbours,
    "id_set": id_set,
    "self_loops": self_loops,
    "transfers_r1": transfers_r1,
    "partial_contigs_r1": partial_contigs_r1,
    "ext_after_r1": ext_after_r1,
    "nodes_after_r1": nodes_after_r1,
    "rewired_r1": rewired_r1,
    "compaction_stats": compaction_stats,
    "partial_contigs": partial_contigs,
    "ext_contracted": ext_contracted,
    "begin_nodes": begin_nodes,
    "walk_contigs": walk_contigs,
    "walk_contigs_full_flow": walk_contigs_full_flow,
    "contigs_final": contigs_final,
    "contig_fasta": contig_fasta,
    "contigs_read_back": contigs_read_back,
    "phase_figures": phase_figures,
    "lost_flow": lost_flow,
    "flow_cycles": flow_cycles,
    "fasta_reads": fasta_reads,
    "visits_by_3": visits_by_3,
    "histogram_of_21": histogram_of_21,
    "min_bucket_of_21": min_bucket_of_21,
    "valid_kmer_count": valid_kmer_count,
    "stream_histogram": stream_histogram,
    "stream_valid_kmers": stream_valid_kmers,
}

# ---------------------------------------------------------------- SQL

_K, _L, _T, _N = CONFIG.k, CONFIG.minimizer, CONFIG.buckets, CONFIG.node


def _wires_of(ext: str) -> str:
    """Cut points of both sides in order, with the prefix and suffix that are open at each."""
    last = "OVER (PARTITION BY node ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
      SELECT node, p.idx AS p_idx, s.idx AS s_idx, (start - p.start)::INT AS off_p, (start - s.start)::INT AS off_s,
        (least(coalesce(following, p.start + p.visit), p.start + p.visit, s.start + s.visit) - start)::INT AS cnt
      FROM (
        SELECT node, start, last_value(p IGNORE NULLS) {last} AS p, last_value(s IGNORE NULLS) {last} AS s,
          lead(start) OVER (PARTITION BY node ORDER BY start) AS following
        FROM (
          SELECT node, start, max(CASE WHEN side = 'P' THEN {{'start': start, 'visit': visit, 'idx': idx}} END) AS p,
            max(CASE WHEN side = 'S' THEN {{'start': start, 'visit': visit, 'idx': idx}} END) AS s
          FROM {ext} WHERE visit > 0 GROUP BY node, start))
      WHERE p IS NOT NULL AND s IS NOT NULL AND start < p.start + p.visit AND start < s.start + s.visit"""


def _ranked_of(ext: str) -> str:
    return f"""
      SELECT *, row_number() OVER w - 1 AS rank,
        coalesce(sum(visit) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start
      FROM {ext} WINDOW w AS (PARTITION BY node, side ORDER BY visit DESC, cnt DESC, idx)"""


def _walk_of(condition: str) -> str:
    return f"""
      SELECT e.node, e.idx AS p_idx, e.seq || e.node AS seq, 0 AS off, e.visit AS freq
      FROM balanced_ext e WHERE side = 'P' AND terminal AND visit > 0
      UNION ALL
      SELECT x.to_node, x.to_idx, w.seq || x.adds,
        (x.off_s + greatest(w.off - x.off_p, 0))::INT,
        least(w.freq - greatest(x.off_p - w.off, 0), x.flow - greatest(w.off - x.off_p, 0))::INT
      FROM walked w JOIN steps x ON w.node = x.node AND w.p_idx = x.p_idx
      WHERE x.off_p + x.flow > w.off AND (x.off_p <= w.off OR {condition})"""


#: Common table expressions, each after those that it needs.
_CTE: dict[str, str] = {
    "reads": "SELECT doc_id AS read_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM documents",
    "coded": "SELECT read_id, translate(seq, 'ACTG', '0123') AS code FROM reads",
    "lmer_freq": f"SELECT lmer, count(*) AS freq FROM (SELECT substr(code, i, {_L}) AS lmer FROM (SELECT code, unnest(range(1, len(code) - {_L} + 2)) AS i FROM coded)) GROUP BY lmer",
    "kmer_count": f"SELECT kmer, count(*) AS cnt FROM (SELECT substr(code, i, {_K}) AS kmer FROM (SELECT code, unnest(range(1, len(code) - {_K} + 2)) AS i FROM coded)) GROUP BY kmer",
    "minimizer": f"""
      SELECT kmer, lmer AS minimizer, pos FROM (
        SELECT a.kmer, a.lmer, a.pos, row_number() OVER (PARTITION BY a.kmer ORDER BY f.freq, a.pos) AS r
        FROM (SELECT kmer, pos, substr(kmer, pos + 1, {_L}) AS lmer FROM (SELECT kmer, unnest(range(0, {_K - _L + 1}))::INT AS pos FROM kmer_count)) a
        JOIN lmer_freq f ON a.lmer = f.lmer) WHERE r = 1""",
    "owner_hash": f"""
      SELECT lmer, h31, h31 % {CONFIG.owners} AS owner FROM (
        SELECT lmer, ((t >> 31) + t) & 2147483647 AS h31 FROM (
          SELECT lmer, {S.HASH_A} * list_sum([(ascii(substr(lmer, i, 1)) - 48) * (1::BIGINT << (2 * ({_L} - i))) for i in range(1, {_L + 1})])::BIGINT + {S.HASH_B} AS t
          FROM lmer_freq))""",
    "count_histogram": f"SELECT b.bucket, count(k.kmer) AS n FROM (SELECT unnest(range(1, {_T}))::BIGINT AS bucket) b LEFT JOIN kmer_count k ON k.cnt = b.bucket GROUP BY b.bucket",
    "min_bucket": "SELECT bucket FROM count_histogram ORDER BY n, bucket LIMIT 1",
    "valid_kmers": "SELECT kmer, cnt FROM kmer_count WHERE cnt >= (SELECT bucket FROM min_bucket)",
    "pred_succ": f"SELECT kmer, left(kmer, {_N}) AS pred, right(kmer, {_N}) AS succ, cnt FROM valid_kmers",
    "nodes": "SELECT pred AS node FROM pred_succ UNION SELECT succ FROM pred_succ",
    "ext": """
      SELECT node, side, (row_number() OVER (PARTITION BY node, side ORDER BY seq) - 1)::INT AS idx, seq, cnt,
        ceil(cnt / 1.0)::INT AS visit, false AS terminal
      FROM (SELECT pred AS node, 'S' AS side, right(kmer, 1) AS seq, cnt FROM pred_succ
            UNION ALL SELECT succ, 'P', left(kmer, 1), cnt FROM pred_succ)""",
    "flow": """
      SELECT node, coalesce(sum(visit) FILTER (side = 'P'), 0)::BIGINT AS pc, coalesce(sum(visit) FILTER (side = 'S'), 0)::BIGINT AS sc,
        count(*) FILTER (side = 'P') AS np, count(*) FILTER (side = 'S') AS ns FROM ext GROUP BY node""",
    "balanced_ext": """
      SELECT * FROM ext
      UNION ALL SELECT node, 'P', np::INT, '', 1, greatest(sc - pc, 0)::INT, true FROM flow
      UNION ALL SELECT node, 'S', ns::INT, '', 1, greatest(pc - sc, 0)::INT, true FROM flow""",
    "ranked": _ranked_of("balanced_ext"),
    "wires": _wires_of("ranked"),
    "neighbours": f"""
      SELECT node, side, idx, CASE side WHEN 'P' THEN left(seq || node, {_N}) ELSE right(node || seq, {_N}) END AS nbr,
        CASE side WHEN 'P' THEN right(seq || node, len(seq)) ELSE left(node || seq, len(seq)) END AS back
      FROM balanced_ext WHERE NOT terminal""",
    "id_set": "SELECT n.node FROM nodes n LEFT JOIN (SELECT node, max(nbr) AS most FROM neighbours GROUP BY node) m ON n.node = m.node WHERE coalesce(most <= n.node, true)",
    "pairs": f"""
      SELECT w.node, w.p_idx, w.off_p, w.cnt AS flow, p.seq AS p_seq, s.seq AS s_seq, p.terminal AS p_end, s.terminal AS s_end,
        least(p.cnt, s.cnt) AS cnt, left(p.seq || w.node, {_N}) AS pred, right(p.seq || w.node, len(p.seq)) AS p_back,
        right(w.node || s.seq, {_N}) AS succ, left(w.node || s.seq, len(s.seq)) AS s_back
      FROM wires w JOIN id_set i ON w.node = i.node
      JOIN balanced_ext p ON p.node = w.node AND p.side = 'P' AND p.idx = w.p_idx
      JOIN balanced_ext s ON s.node = w.node AND s.side = 'S' AND s.idx = w.s_idx""",
    "transfers": """
      SELECT pred AS target, 'S' AS side, p_back AS search_ext, p_back || s_seq AS new_ext, cnt, flow AS visit, s_end OR succ = node AS terminal, node AS src, p_idx, off_p
      FROM pairs WHERE NOT p_end AND pred <> node
      UNION ALL
      SELECT succ, 'P', s_back, p_seq || s_back, cnt, flow, p_end OR pred = node, node, p_idx, off_p FROM pairs WHERE NOT s_end AND succ <> node""",
    "rest": "SELECT * FROM balanced_ext WHERE node NOT IN (SELECT node FROM id_set)",
    "placed": """
      SELECT t.*, CASE WHEN t.rn = 1 THEN r.idx END AS replaces FROM (
        SELECT *, row_number() OVER (PARTITION BY target, side, search_ext ORDER BY src, p_idx, off_p) AS rn FROM transfers) t
      LEFT JOIN rest r ON r.node = t.target AND r.side = t.side AND r.seq = t.search_ext AND NOT r.terminal""",
    "ext_after": """
      SELECT r.* FROM rest r WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.target = r.node AND p.side = r.side AND p.replaces = r.idx)
      UNION ALL SELECT target, side, replaces, new_ext, cnt, visit, terminal FROM placed WHERE replaces IS NOT NULL
      UNION ALL
      SELECT a.target, a.side, (coalesce(c.n, 0) + row_number() OVER (PARTITION BY a.target, a.side ORDER BY src, p_idx, off_p) - 1)::INT,
        new_ext, cnt, visit, terminal
      FROM placed a LEFT JOIN (SELECT node, side, count(*) AS n FROM rest GROUP BY node, side) c ON c.node = a.target AND c.side = a.side
      WHERE replaces IS NULL""",
    "ranked_after": _ranked_of("ext_after"),
    "visits_by_3": "SELECT node, side, idx, ceil(cnt / 3.0)::INT AS visit FROM ext",
    "histogram_of_21": "SELECT b.bucket, count(k.kmer) AS n FROM (SELECT unnest(range(1, 21))::BIGINT AS bucket) b LEFT JOIN kmer_count k ON k.cnt = b.bucket GROUP BY b.bucket",
    "steps": f"""
      SELECT w.node, w.p_idx, w.off_p, w.off_s, w.cnt AS flow, s.seq AS adds,
        CASE WHEN NOT s.terminal THEN right(w.node || s.seq, {_N}) END AS to_node, p.idx AS to_idx
      FROM wires w JOIN balanced_ext s ON s.node = w.node AND s.side = 'S' AND s.idx = w.s_idx
      LEFT JOIN balanced_ext p ON NOT s.terminal AND p.side = 'P' AND NOT p.terminal AND p.node = right(w.node || s.seq, {_N}) AND p.seq = left(w.node || s.seq, len(s.seq))""",
}


def _sql(select: str, *names: str, recursive: str | None = None) -> str:
    """A query with the expressions that it needs, those that they need, and a recursive one."""
    import re

    needed: set[str] = set()
    todo = [*names]
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [m for m in _CTE if m != n and re.search(rf"\b{m}\b", _CTE[n])]
    parts = [f"{n} AS MATERIALIZED ({_CTE[n]})" for n in _CTE if n in needed]
    if recursive:
        parts.append(f"walked AS ({recursive})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + f"\n{select}"


def _contraction_of(start: str) -> str:
    """All rounds of a contraction: extensions (kind 0) and partial contigs (kind 1) after each; the last round has the end."""
    names = ["ranked", "wires", "pairs", "transfers", "rest", "placed", "ext_after"]
    steps = {n: _CTE[n].replace("balanced_ext", "now") for n in names}
    steps["id_set"] = f"""
      SELECT node FROM now GROUP BY node
      HAVING coalesce(max(CASE WHEN terminal THEN NULL WHEN side = 'P' THEN left(seq || node, {_N}) ELSE right(node || seq, {_N}) END) <= node, true)"""
    parts = ",\n".join(f"{n} AS ({steps[n]})" for n in ["ranked", "wires", "id_set", *names[2:]])
    return f"""
      SELECT 0 AS iter, 0 AS kind, node, side, idx, seq, cnt, visit, terminal FROM {start}
      UNION ALL
      SELECT * FROM (
        WITH now AS (SELECT node, side, idx, seq, cnt, visit, terminal FROM rounds WHERE kind = 0),
        {parts}
        SELECT r.iter + 1, x.* FROM (SELECT max(iter) AS iter, count(DISTINCT node) AS n FROM rounds WHERE kind = 0) r, (
          SELECT 0 AS kind, node, side, idx, seq, cnt, visit, terminal FROM ext_after
          UNION ALL SELECT 1, node, NULL, NULL, p_seq || node || s_seq, NULL, NULL, NULL FROM pairs WHERE p_end AND s_end) x
        WHERE r.n > {NODE_LIMIT})"""


def _contracted_sql(select: str, walk: bool = False) -> str:
    """A query of the rounds of a contraction, and of the walks through its end."""
    parts = {"rounds": _contraction_of("balanced_ext")}
    parts["last_ext"] = "SELECT node, side, idx, seq, cnt, visit, terminal FROM rounds WHERE kind = 0 AND iter = (SELECT max(iter) FROM rounds WHERE kind = 0)"
    if walk:
        parts["last_ranked"] = _ranked_of("last_ext")
        parts["last_wires"] = _wires_of("last_ranked")
        parts["last_steps"] = _CTE["steps"].replace("balanced_ext", "last_ext").replace("wires", "last_wires")
        parts["walked"] = _walk_of(_HALF).replace("balanced_ext", "last_ext").replace("steps", "last_steps")
    before = _sql("", "balanced_ext").removeprefix("WITH ")
    return f"WITH RECURSIVE {before}" + "".join(f",\n{n} AS ({q})" for n, q in parts.items()) + f"\n{select}"


def _plain(name: str, columns: str = "*") -> str:
    return _sql(f"SELECT {columns} FROM {name}", name)


def _walk_sql(condition: str, select: str) -> str:
    return _sql(select, "balanced_ext", "steps", recursive=_walk_of(condition))


_HALF, _FULL = "2 * (x.off_p - w.off) <= w.freq", "x.off_p < w.off + w.freq"
_LETTERS = "translate(seq, '0123', 'ACTG')"

def _cycles_sql() -> str:
    """Places that no seed leads to, followed until they come back."""
    before = _sql("", "balanced_ext", "steps").removeprefix("WITH ")
    moved = "JOIN places n ON n.node = {0}.to_node AND n.p_idx = {0}.to_idx AND n.x = {0}.to_x"
    return f"""WITH RECURSIVE {before},
places AS (
  SELECT node, p_idx, x, to_node, to_idx, x - off_p + off_s AS to_x, adds FROM (SELECT *, unnest(range(off_p, off_p + flow)) AS x FROM steps)),
reached AS (
  SELECT p.* FROM places p JOIN balanced_ext e ON e.node = p.node AND e.idx = p.p_idx AND e.side = 'P' AND e.terminal
  UNION ALL SELECT n.* FROM reached r {moved.format("r")}),
round_places AS (SELECT node, p_idx, x, to_node, to_idx, to_x, adds FROM places EXCEPT SELECT * FROM reached),
ways AS (
  SELECT node AS n0, p_idx AS p0, x AS x0, to_node, to_idx, to_x, adds AS seq, (node, p_idx, x) AS least FROM round_places
  UNION ALL
  SELECT n0, p0, x0, n.to_node, n.to_idx, n.to_x, w.seq || n.adds, least((n.node, n.p_idx, n.x), w.least) FROM ways w {moved.format("w")}
  WHERE (w.to_node, w.to_idx, w.to_x) <> (w.n0, w.p0, w.x0)),
closed AS (SELECT seq FROM ways WHERE (to_node, to_idx, to_x) = (n0, p0, x0) AND least = (n0, p0, x0))
SELECT translate(seq, '0123', 'ACTG') AS seq, count(*) AS flow
FROM (SELECT list_min([substr(seq || seq, i, len(seq)) FOR i IN range(1, len(seq) + 1)]) AS seq FROM closed) GROUP BY seq"""


#: Contigs of the walks, numbered by length and the hash of their chunks' hashes.
_NAMED = f""", long AS (SELECT {_LETTERS} AS seq FROM walked WHERE node IS NULL AND len(seq) > {MIN_CONTIG}),
  named AS (
    SELECT 'contig_' || (row_number() OVER (ORDER BY len(seq) DESC, digest) - 1) || '_l_' || len(seq) || '_r_0' AS name, seq
    FROM (SELECT seq, sha256(array_to_string([sha256(substr(seq, i * {CHUNK} + 1, {CHUNK})) FOR i IN range(0, (len(seq) - 1) // {CHUNK} + 1)], '')) AS digest FROM long))"""

ORACLE_SQL: dict[str, str] = {
    "reads": _plain("reads"),
    "read_count": _sql("SELECT count(*) AS n FROM reads", "reads"),
    "base_encode": _plain("coded"),
    "lmer_freq": _plain("lmer_freq"),
    "kmer_count": _plain("kmer_count"),
    "kmer_count_packed": _plain("kmer_count"),
    "kmer_count_by_runs": _plain("kmer_count"),
    "kmer_total_distinct": _sql("SELECT coalesce(sum(cnt), 0)::BIGINT AS total, count(*) AS distinct_kmers FROM kmer_count", "kmer_count"),
    "minimizer": _plain("minimizer"),
    "owner_hash": _plain("owner_hash"),
    "owner_load": _sql(
        "SELECT o.owner, count(*) AS distinct_kmers, sum(k.cnt)::BIGINT AS total FROM minimizer m JOIN owner_hash o ON m.minimizer = o.lmer JOIN kmer_count k ON k.kmer = m.kmer GROUP BY o.owner",
        "minimizer", "owner_hash", "kmer_count",
    ),
    "count_histogram": _plain("count_histogram"),
    "min_bucket": _plain("min_bucket"),
    "valid_kmers": _plain("valid_kmers"),
    "pred_succ": _plain("pred_succ"),
    "nodes": _plain("nodes"),
    "suffix_ext": _sql("SELECT node, idx, seq, cnt, visit FROM ext WHERE side = 'S'", "ext"),
    "prefix_ext": _sql("SELECT node, idx, seq, cnt, visit FROM ext WHERE side = 'P'", "ext"),
    "macro_nodes": _sql(
        """SELECT node, string_agg(seq || ':' || cnt || ':' || visit, ',' ORDER BY idx) FILTER (side = 'P') AS prefixes,
           string_agg(seq || ':' || cnt || ':' || visit, ',' ORDER BY idx) FILTER (side = 'S') AS suffixes FROM balanced_ext GROUP BY node""",
        "balanced_ext",
    ),
    "node_flow": _plain("flow", "node, pc, sc"),
    "balanced_ext": _plain("balanced_ext"),
    "ext_rank": _plain("ranked", "node, side, idx, rank, start"),
    "wires": _plain("wires"),
    "neighbours": _plain("neighbours"),
    "id_set": _plain("id_set"),
    "self_loops": _sql("SELECT node, side, idx FROM neighbours WHERE nbr = node", "neighbours"),
    "transfers_r1": _plain("transfers"),
    "partial_contigs_r1": _sql("SELECT p_seq || node || s_seq AS seq FROM pairs WHERE p_end AND s_end", "pairs"),
    "ext_after_r1": _plain("ext_after"),
    "nodes_after_r1": _sql("SELECT DISTINCT node FROM ext_after", "ext_after"),
    "rewired_r1": _sql(_wires_of("ranked_after"), "ranked_after"),
    "fasta_reads": _sql("SELECT read_id::VARCHAR AS header, seq FROM reads", "reads"),
    "visits_by_3": _plain("visits_by_3"),
    "histogram_of_21": _plain("histogram_of_21"),
    "min_bucket_of_21": _sql("SELECT bucket FROM histogram_of_21 ORDER BY n, bucket LIMIT 1", "histogram_of_21"),
    "valid_kmer_count": _sql("SELECT count(*) AS n, coalesce(sum(cnt), 0)::BIGINT AS occurrences FROM valid_kmers", "valid_kmers"),
    "compaction_stats": _contracted_sql(
        """SELECT iter, n_nodes, n_nodes - following AS id_set_size FROM (
             SELECT iter, count(DISTINCT node) AS n_nodes, lead(count(DISTINCT node)) OVER (ORDER BY iter) AS following FROM rounds WHERE kind = 0 GROUP BY iter)
           WHERE following IS NOT NULL"""
    ),
    "partial_contigs": _contracted_sql(f"SELECT {_LETTERS} AS seq FROM rounds WHERE kind = 1"),
    "ext_contracted": _contracted_sql("SELECT * FROM last_ext"),
    "contigs_final": _contracted_sql(
        f"""SELECT {_LETTERS} AS seq, len(seq)::INT AS len, origin FROM (
             SELECT seq, 'partial' AS origin FROM rounds WHERE kind = 1 UNION ALL SELECT seq, 'walk' FROM walked WHERE node IS NULL)""",
        walk=True,
    ),
    "stream_histogram": _plain("count_histogram"),
    "stream_valid_kmers": _plain("valid_kmers"),
    "begin_nodes": _sql("SELECT node, idx AS p_idx, visit FROM balanced_ext WHERE side = 'P' AND terminal AND visit > 0", "balanced_ext"),
    "walk_contigs": _walk_sql(_HALF, f"SELECT {_LETTERS} AS seq FROM walked WHERE node IS NULL"),
    "walk_contigs_full_flow": _walk_sql(_FULL, f"SELECT {_LETTERS} AS seq FROM walked WHERE node IS NULL"),
    "contig_fasta": _walk_sql(_HALF, f"{_NAMED} SELECT name, i AS chunk, substr(seq, i * {CHUNK} + 1, {CHUNK}) AS seq FROM (SELECT name, seq, unnest(range(0, (len(seq) - 1) // {CHUNK} + 1)) AS i FROM named)"),
    "contigs_read_back": _walk_sql(_HALF, f"{_NAMED} SELECT name AS header, seq FROM named"),
    "phase_figures": _contracted_sql(
        """SELECT unnest(['reads', 'bases', 'kmers', 'distinct_kmers', 'valid_kmers', 'nodes', 'extensions', 'rounds', 'contracted', 'ports', 'wires', 'walk_contigs', 'partial_contigs', 'letters']) AS figure,
           unnest([(SELECT count(*) FROM reads), (SELECT sum(len(seq)) FROM reads), (SELECT sum(cnt) FROM kmer_count), (SELECT count(*) FROM kmer_count),
             (SELECT count(*) FROM valid_kmers), (SELECT count(DISTINCT node) FROM balanced_ext), (SELECT count(*) FROM balanced_ext), (SELECT max(iter) FROM rounds),
             (SELECT count(DISTINCT node) FROM balanced_ext) - (SELECT count(DISTINCT node) FROM last_ext), (SELECT count(*) FROM last_ext WHERE side = 'P' AND visit > 0),
             (SELECT count(*) FROM last_wires), (SELECT count(*) FROM walked WHERE node IS NULL), (SELECT count(*) FROM rounds WHERE kind = 1),
             (SELECT sum(len(seq)) FROM (SELECT seq FROM walked WHERE node IS NULL UNION ALL SELECT seq FROM rounds WHERE kind = 1))])::BIGINT AS n""",
        walk=True,
    ),
    "flow_cycles": _cycles_sql(),
    "lost_flow": _sql(
        """SELECT w.node, sum(w.cnt)::BIGINT AS flow FROM wires w
           JOIN (SELECT * FROM neighbours WHERE nbr = node AND side = 'P') p ON p.node = w.node AND p.idx = w.p_idx
           JOIN (SELECT * FROM neighbours WHERE nbr = node AND side = 'S') s ON s.node = w.node AND s.idx = w.s_idx GROUP BY w.node""",
        "wires", "neighbours",
    ),
}
