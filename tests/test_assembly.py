import dataclasses
import hashlib
import math
import random
import sys
import time
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandloom.config import AssemblyConfig, parse_arguments
from strandloom.functions import sequence as S
from strandloom.operators import compaction, cycles, graph, histogram, kmers, packed, shares, stretches, walk, wiring
from strandloom.plans import assembly
from strandloom.sources import fasta
from tests import model

sys.setrecursionlimit(20_000)


def table(spark, reads):
    return spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "read_id long, seq string")


def genome(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def pieces(seq, length):
    return [seq[i : i + length] for i in range(len(seq) - length + 1)]


def contigs(spark, reads, **parameters):
    done = assembly.assemble(table(spark, reads), AssemblyConfig(minimizer=3, min_contig=0, **parameters))
    rows = done.contigs.collect()
    return sorted(r.seq for r in rows if r.origin == "partial"), sorted(r.seq for r in rows if r.origin == "walk")


def test_linear_genome_is_one_contig(spark):
    g = genome(120, 3)
    assert contigs(spark, [g], k=15, buckets=1, node_limit=None) == ([], [g])


@pytest.mark.parametrize("mode, limit", [("reference", None), ("full_flow", None), ("reference", 60)])
def test_repeats_equal_the_model(spark, mode, limit):
    r = random.Random(7)
    unit = genome(14, 5)
    reads = [genome(10, i) + unit + genome(9, 90 + i % 3) + unit + genome(8, i // 2) for i in range(4)]
    reads += [r.choice(reads)[3:40] for _ in range(4)]
    want = model.assemble(reads, 7, limit=limit, full_flow=mode == "full_flow")
    assert contigs(spark, reads, k=7, buckets=1, node_limit=limit, walk=mode) == want


def test_rounds_of_a_walk_are_logarithmic_and_no_row_holds_a_chain(spark):
    g = genome(1500, 21)
    config = AssemblyConfig(k=15, minimizer=3, buckets=1, node_limit=None)
    ext = wiring.balanced(graph.extensions(kmers.kmer_counts(table(spark, [g]), config), config))
    flow = walk.flow_map(ext, config)
    maps = walk.powers(flow)
    assert len(maps) - 1 <= math.ceil(math.log2(flow.n_ports)) and flow.n_ports == 1487
    chunks = walk.spelled(flow, maps, walk.walks(flow, maps, "reference"), 100).collect()
    assert [len(c.text) for c in sorted(chunks, key=lambda c: c.chunk)] == [100] * 15
    assert "".join(c.text for c in sorted(chunks, key=lambda c: c.chunk)).translate(str.maketrans("0123", "ACTG")) == g


def test_pieces_meet_whatever_the_bins(spark, monkeypatch):
    unit = genome(12, 1)
    reads = [genome(6, i) + unit + genome(6, 20 + i) for i in range(3)] * 5 + [unit + genome(9, 70)] * 4
    config = AssemblyConfig(k=7, minimizer=3, buckets=1, node_limit=None)
    ext = wiring.balanced(graph.extensions(kmers.kmer_counts(table(spark, reads), config), config)).cache()
    want = model.assemble(reads, 7)[1]
    for size in (1, 3, 64):
        monkeypatch.setattr(walk, "BIN", size)
        got = sorted(r.seq for r in walk.walk_contigs(ext, config).select(S.decode(F.col("seq")).alias("seq")).collect())
        assert got == want and len(got) == 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 5)), min_size=2, max_size=14))
def test_walks_beyond_half_of_the_flow_go(parts):
    """Sizes of a seed's walks, and the step at which each parts from those before, against the rule step by step."""
    lo, at = [], 0
    for size, _ in parts:
        lo.append(at)
        at += size
    split = [None] + [t for _, t in parts[1:]]

    def alive(first, last, step):
        """Walks that stay of first..last-1, which are together before ``step``."""
        if step > 6:
            return list(range(first, last))
        starts = [i for i in range(first, last) if i == first or split[i] == step]
        begin, end, out = lo[first], lo[last] if last < len(lo) else at, []
        for i, j in zip(starts, [*starts[1:], last]):
            if i == first or 2 * (lo[i] - begin) <= end - begin:
                out += alive(i, j, step + 1)
        return out

    rows = pa.table({"port": [1] * len(lo), "lo": pa.array(lo, pa.int32()), "hi": pa.array([*lo[1:], at], pa.int32()), "split": pa.array(split, pa.int32()), "steps": pa.array([1] * len(lo), pa.int32())})
    assert walk._kept(rows)["lo"].to_pylist() == [lo[i] for i in alive(0, len(lo), 0)]


def test_five_million_letters_in_chunks(spark, tmp_path):
    n = 5_000_000
    letter = F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int"), F.lit(1))
    parts = spark.range(0, n, 1, 8).select(F.lit(7).cast("long").alias("contig"), F.col("id").alias("step"), letter.alias("adds"))
    parts = parts.unionByName(spark.createDataFrame([(8, 0, "A" * 150_000), (8, 1, "CG"), (9, 0, "ACGT")], parts.schema))
    chunks = walk.chunked(parts, fasta.CHUNK).withColumn("origin", F.lit("walk")).cache()
    assert chunks.agg(F.max(F.length("text"))).first()[0] == fasta.CHUNK
    assert [tuple(r) for r in chunks.groupBy("contig").agg(F.sum(F.length("text"))).orderBy("contig").collect()] == [(7, n), (8, 150_002), (9, 4)]
    fasta.write_chunks(chunks, str(tmp_path / "out"), 400)
    lines = spark.read.text(str(tmp_path / "out")).agg(F.max(F.length("value"))).first()[0]
    back = {r.header: r.h for r in fasta.read_fasta(spark, str(tmp_path / "out")).select("header", F.sha2("seq", 256).alias("h")).collect()}
    want = "".join(r.adds for r in parts.where("contig = 7").orderBy("step").select("adds").toLocalIterator(prefetchPartitions=True))
    assert lines == fasta.CHUNK
    assert back == {f"contig_0_l_{n}_r_0": hashlib.sha256(want.encode()).hexdigest(), "contig_1_l_150002_r_0": hashlib.sha256(("A" * 150_000 + "CG").encode()).hexdigest()}


def test_windows_cost_the_same_in_long_reads(spark):
    g = genome(400_000, 8)
    config = AssemblyConfig(k=21, minimizer=8)

    def seconds(length):
        reads = table(spark, [g[i : i + length] for i in range(0, len(g), length)]).repartition(4).cache()
        reads.count()
        began = time.time()
        kmers.kmer_counts(reads, config).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(100)
    assert seconds(100_000) < 3 * seconds(100) + 1


@pytest.mark.parametrize("alphabet", ["strict", "compat"])
def test_windows_of_pieces_are_those_of_the_whole(spark, monkeypatch, alphabet):
    r = random.Random(4)
    reads = ["".join(r.choice("ACGTacgtu" if r.random() < 0.95 else "NRYH-é") for _ in range(n)) for n in (0, 4, 5, 39, 40, 41, 44, 45, 200, 333)]
    config = AssemblyConfig(k=5, minimizer=3, alphabet=alphabet)
    whole = Counter(dict(map(tuple, kmers.kmer_counts(table(spark, reads), config).collect())))
    monkeypatch.setattr(S.pieces, "__defaults__", (40,))
    assert Counter(dict(map(tuple, kmers.kmer_counts(table(spark, reads), config).collect()))) == whole and len(whole) > 100
    if alphabet == "strict":
        digits = [x.upper().replace("U", "T").translate(str.maketrans("ACTG", "0123")) for x in reads]
        assert whole == Counter(w for x in digits for w in pieces(x, 5) if set(w) <= set("0123"))


@pytest.mark.parametrize("k", [9, 21, 31, 32, 33, 63, 64])
def test_packed_keys_and_runs_equal_digit_strings(spark, k):
    r = random.Random(k)
    reads = ["".join(r.choice("ACGTacgtUu" if r.random() < 0.98 else "NRé*") for _ in range(n)) for n in (0, 8, 70, 200, 400, 400, 900)]
    reads += ["A" * 150, "AC" * 90, reads[-1], None, genome(k, 1), genome(k - 1, 2)]
    rows = table(spark, reads)
    for alphabet in ("strict", "compat"):
        config = AssemblyConfig(k=k, minimizer=4, alphabet=alphabet)
        want = dict(map(tuple, kmers.kmer_counts(rows, config).collect()))
        packed_counts = packed.packed_counts(rows, config)
        assert dict(packed_counts.dtypes)["key"] == ("bigint" if k <= 31 else "binary")
        in_order = packed_counts.orderBy("key").select(packed.unpacked(F.col("key"), k), "cnt").collect()
        assert [tuple(x) for x in in_order] == sorted(want.items())
    config = AssemblyConfig(k=k, minimizer=4)
    want = dict(map(tuple, kmers.kmer_counts(rows, config).collect()))
    lmers = kmers.lmer_frequencies(rows, config)
    assert dict(map(tuple, packed.counts_by_runs(rows, lmers, config).collect())) == want
    frequency = dict(map(tuple, lmers.collect()))
    for x in kmers.minimizers(kmers.kmer_counts(rows, config), lmers, config).collect():
        best = min(range(k - 3), key=lambda i: (frequency[x.kmer[i : i + 4]], i))
        assert (x.pos, x.minimizer, x.cnt) == (best, x.kmer[best : best + 4], want[x.kmer])


def written_bytes(spark, frame):
    """Bytes that a query's exchanges wrote."""
    context = spark.sparkContext

    def stages():
        jvm = context._gateway.jvm
        found = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    frame.write.format("noop").mode("overwrite").save()
    context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    return sum(v for k, v in stages().items() if k not in before)


@pytest.mark.parametrize("k, packed_share, run_share", [(21, 0.5, 1 / 3), (63, 0.5, 1 / 3)])
def test_runs_and_packed_keys_exchange_less(spark, k, packed_share, run_share):
    reads = table(spark, [genome(100, i) for i in range(4000)]).repartition(4).cache()
    reads.count()
    config = AssemblyConfig(k=k, minimizer=8)
    lmers = kmers.lmer_frequencies(reads, config).cache()
    lmers.count()
    partitions = "spark.sql.shuffle.partitions"
    before = spark.conf.get(partitions)
    spark.conf.set(partitions, "128")  # with few, neighbouring windows lie together and compress as they do not at scale
    try:
        strings, keys, runs = (written_bytes(spark, x) for x in (kmers.kmer_counts(reads, config), packed.packed_counts(reads, config), packed.counts_by_runs(reads, lmers, config)))
    finally:
        spark.conf.set(partitions, before)
    print("SHARES", k, keys / strings, runs / strings)
    assert keys < packed_share * strings and runs < run_share * strings


@pytest.mark.parametrize("tables", [1, 4])
def test_rounds_rewrite_touched_nodes_only(spark, monkeypatch, tables):
    monkeypatch.setattr(compaction, "SETTLED_TABLES", tables)
    r = random.Random(2)
    unit = genome(25, 5)
    reads = [genome(30, i) + unit + genome(30, 90 + i % 3) for i in range(8)] + [genome(150, 40), "ACGT" * 9]
    want = model.assemble(reads, 9, limit=20)
    config = AssemblyConfig(k=9, minimizer=3, buckets=1, node_limit=20)
    ext = wiring.balanced(graph.extensions(kmers.kmer_counts(table(spark, reads), config), config))
    done = compaction.contract(ext, config)
    assert sorted(x.seq for x in done.partial.select(S.decode(F.col("seq")).alias("seq")).collect()) == want[0]
    assert sorted(x.seq for x in walk.walk_contigs(done.ext, config).select(S.decode(F.col("seq")).alias("seq")).collect()) == want[1]
    assert len(done.rounds) > 5 and done.rounds[-1].nodes > 20
    for a, b in zip(done.rounds, done.rounds[1:]):
        assert a.nodes - a.contracted == b.nodes and b.rows <= 12 * (a.touched + b.touched)
    assert done.ext.select("node").distinct().count() == done.rounds[-1].nodes - done.rounds[-1].contracted <= 20


def test_a_transfer_to_nowhere_is_an_error(spark):
    sent = spark.createDataFrame([("01", "S", "0", "01", 1, 1, False, "00", 0, 0)], "target string, side string, search_ext string, new_ext string, cnt long, visit int, terminal boolean, src string, p_idx int, off_p int")
    rows = spark.createDataFrame([], "node string, side string, idx int, seq string, cnt long, visit int, terminal boolean, origin int")
    with pytest.raises(Exception, match="no node for a transfer"):
        compaction.edited(rows, sent).collect()


def test_figures_and_seconds_of_a_run(spark):
    g = genome(200, 5)
    done = assembly.assemble(table(spark, [g, g[:90]]), AssemblyConfig(k=15, minimizer=3, buckets=1, node_limit=50))
    f = done.figures
    assert (f["reads"], f["bases"], f["kmers"]) == (2, 290, 186 + 76) and f["nodes"] - f["contracted"] <= 50
    assert f["walk_contigs"] + f["partial_contigs"] == done.contigs.count() > 0
    assert f["letters"] == done.contigs.agg(F.sum(F.length("seq"))).first()[0]
    assert set(done.seconds) == {"count", "nodes", "contract", "wire", "map", "walk", "spell"}


def test_cycles_and_homopolymers_give_nothing(spark):
    circle = genome(30, 11)
    assert contigs(spark, [circle + circle[:8]] * 1, k=9, buckets=1, node_limit=None)[1] in ([], [circle + circle[:8]])
    assert contigs(spark, ["A" * 30], k=5, buckets=1, node_limit=None)[0] == []


@given(st.text("ab", min_size=1, max_size=30))
def test_least_rotation(text):
    assert cycles.least_rotation(text) == min(text[i:] + text[:i] for i in range(len(text)))


def test_a_circle_is_a_cycle_of_flow(spark):
    circle, line = genome(30, 11), genome(60, 12)
    reads = [circle + circle[:8]] * 3 + [line]
    config = AssemblyConfig(k=9, minimizer=3, buckets=1, node_limit=None)
    ext = wiring.balanced(graph.extensions(kmers.kmer_counts(table(spark, reads), config), config))
    rows = cycles.cycles(ext, config).collect()
    digits = circle.translate(str.maketrans("ACTG", "0123"))
    assert [tuple(r) for r in rows] == [(min(digits[i:] + digits[:i] for i in range(30)), 3)]
    assert [r.seq.translate(str.maketrans("0123", "ACTG")) for r in walk.walk_contigs(ext, config).collect()] == [line]


def test_nothing_above_the_cutoff(spark):
    with pytest.raises(histogram.NothingLeft):
        assembly.assemble(table(spark, [genome(60, 2)]), AssemblyConfig(k=15, minimizer=3, buckets=21))


def test_flow_invariants(spark):
    unit = genome(12, 1)
    reads = [genome(6, i) + unit + genome(6, 20 + i) for i in range(5)]
    config = AssemblyConfig(k=7, minimizer=3, buckets=1)
    ext = wiring.balanced(graph.extensions(kmers.kmer_counts(table(spark, reads), config), config)).cache()
    flow = ext.groupBy("node").agg(F.sum(F.when(F.col("side") == "P", F.col("visit")).otherwise(-F.col("visit"))).alias("d"))
    assert flow.where("d <> 0").count() == 0
    w = wiring.wires(ext)
    assert w.where("cnt < 1").count() == 0
    used = {(r.node, r.p_idx): r.n for r in w.groupBy("node", "p_idx").agg(F.sum("cnt").alias("n")).collect()}
    assert used == {(r.node, r.idx): r.visit for r in ext.where("side = 'P' AND visit > 0").collect()}
    chosen = {r.node for r in compaction.independent_set(ext, config).collect()}
    near = compaction.neighbours(ext, config).collect()
    assert chosen and not [r for r in near if r.node in chosen and r.nbr in chosen and r.nbr != r.node]


def test_fasta_edges(spark, tmp_path):
    path = tmp_path / "in.fa"
    path.write_text(">one\nACGTN\nACGU\r\n>two\n\n>three>x\nac\n>last\nACGTACGT")
    rows = {r.header: r.seq for r in fasta.read_fasta(spark, str(path)).collect()}
    assert rows == {"one": "ACGTNACGU", "two": "", "three": "", "x": "ac", "last": "ACGTACGT"}
    config = AssemblyConfig(k=5, minimizer=3)
    strict = {S_: n for S_, n in kmers.kmer_counts(fasta.read_fasta(spark, str(path)), config).collect()}
    want = Counter("".join("ACTG".index(c).__str__() for c in w) for w in pieces("ACGTACGT", 5))
    assert strict == want


def test_compat_alphabet_spills_into_the_base_before(spark):
    rows = spark.createDataFrame([("ACNT",)], "seq string").select(S.compat_windows(S.compat_codes(F.col("seq")), 4).alias("w"))
    # N is 7: it becomes G (3) and sets the low bit of the base before it, C stays C.
    assert rows.first().w == ["0132"]
    rows = spark.createDataFrame([("AANA",)], "seq string").select(S.compat_windows(S.compat_codes(F.col("seq")), 2).alias("w"))
    assert rows.first().w == ["00", "13", "30"]


def test_written_fasta_is_read_again(spark, tmp_path):
    made = spark.createDataFrame([("ACGT" * 110, "walk"), ("ACGTT", "walk"), ("TT" * 210, "partial")], "seq string, origin string")
    fasta.write_fasta(made, str(tmp_path / "out"), 400, 2)
    back = fasta.read_fasta(spark, str(tmp_path / "out")).collect()
    assert sorted(r.seq for r in back) == sorted(["ACGT" * 110, "TT" * 210])
    assert all(r.header.split("_l_")[1].split("_r_")[0] == str(len(r.seq)) for r in back)


def test_contigs_are_numbered_in_several_tasks(spark):
    rows = [(genome(30 + i % 50, i), "walk") for i in range(400)] + [("ACGT" * 10, "walk"), ("ACGT" * 10, "partial"), ("ACGT" * 10, "walk"), ("A" * 30, "walk")]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        got = fasta.numbered_contigs(spark.createDataFrame(rows, "seq string, origin string"), 30)
        got = got.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(coalesce, before)
    want = sorted((r for r in rows if len(r[0]) > 30), key=lambda r: (-len(r[0]), r[0], r[1]))
    assert sorted((r.name, r.seq, r.origin) for r in got) == sorted((f"contig_{i}_l_{len(s)}_r_0", s, o) for i, (s, o) in enumerate(want))
    assert len({r.task for r in got}) > 1
    assert fasta.numbered_contigs(spark.createDataFrame([], "seq string, origin string"), 30).count() == 0


def test_arguments():
    path, config = parse_arguments("-f x.fa -r 100 -c 80 -n 0".split())
    assert (path, config.coverage, config.buckets, config.node_limit) == ("x.fa", 80, 21, 100_000)
    with pytest.raises(SystemExit):
        parse_arguments("-f x -r 100 -c 1 -z 3".split())
    for bad in ({"k": 65}, {"coverage": 0}, {"read_length": 99}, {"minimizer": 40}):
        with pytest.raises(ValueError):
            AssemblyConfig(**bad)


def test_stream_counts(spark, tmp_path):
    from strandloom.streaming.kmer_stream import kmer_count_stream, read_fasta_stream

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.fa").write_text(f">r{i}\n{genome(40, 4)}\n")
    config = AssemblyConfig(k=9, minimizer=3)
    stream = kmer_count_stream(read_fasta_stream(spark, str(tmp_path / "in"), 1), config)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.cnt for r in spark.table("counts").collect()} == {2}


def test_letters_are_taken_a_slice_at_a_time():
    """what a worker holds follows LETTERS, not the rows of a batch."""
    import pyarrow as pa

    from strandloom.operators import packed

    batch = pa.record_batch([pa.array(["ACGTTGCA" * 1000] * 500 + [""] + ["A" * 9000] * 3)], ["seq"])
    sizes = [b.n for b in packed._slices([batch], "strict")]
    assert len(sizes) > 3 and max(sizes) <= packed.LETTERS and sum(sizes) == 500 * 8000 + 3 * 9000


def test_counts_go_as_packed_runs(spark):
    """Valid k-mers are counted as packed keys, no strings are exchanged, and equal those of the windows."""
    from strandloom.config import AssemblyConfig
    from strandloom.operators import kmers

    config = AssemblyConfig(k=21, minimizer=8)
    texts = ["ACGT" * 30, "ACGT" * 30, "A" * 200, "TTGCA", "", None, "ACGTNACGTTGCATGCATGCCGATCGATCGGGATATATC" * 300]
    reads = spark.createDataFrame([(t,) for t in texts], "seq string").repartition(3)
    found = kmers.spelled_counts(reads, config)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(share" in plan and "hashpartitioning(kmer" not in plan
    plain = kmers.extracted(reads, 21, "kmer").groupBy("kmer").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_pieces_that_ended_are_written_once(spark):
    """a round of maps writes what went on, and positions write each half once."""
    import glob

    from strandloom.session import checkpoint_folder

    config = AssemblyConfig(k=8, minimizer=4, buckets=1, node_limit=None)
    ext = wiring.balanced(graph.extensions(assembly.valid(table(spark, [genome(120, 5), genome(40, 6), genome(15, 7)]), config)[0], config))
    before = set(glob.glob(f"{checkpoint_folder(spark)}/walk-*"))
    flow = walk.flow_map(ext, config)
    maps = walk.powers(flow)
    assert len(maps) > 4
    tables = [p for p in glob.glob(f"{checkpoint_folder(spark)}/walk-map-*") if p not in before]
    assert len(tables) == len(maps)
    assert sum(spark.read.parquet(p).where("to IS NULL").count() for p in tables) == maps[-1].where("to IS NULL").count()
    walk.positions(walk.walks(flow, maps, "reference"), maps).count()
    places = [p for p in glob.glob(f"{checkpoint_folder(spark)}/walk-places-*") if p not in before]
    found = walk.walks(flow, maps, "reference")
    assert sum(spark.read.parquet(p).count() for p in places) + found.count() == walk.positions(found, maps).count()


def _graph(spark, limit=None):
    unit = genome(25, 5)
    reads = [genome(30, i) + unit + genome(30, 90 + i % 3) for i in range(8)] + [genome(150, 40), "ACGT" * 9]
    config = AssemblyConfig(k=9, minimizer=3, buckets=1, node_limit=limit)
    return config, graph.extensions(kmers.kmer_counts(table(spark, reads), config), config)


def test_a_round_writes_only_what_transfers_reach(spark):
    """Nodes that no transfer reaches stay where they are."""
    config, ext = _graph(spark, 20)
    ext = wiring.balanced(ext)
    flagged = compaction.chosen_first(ext, config)
    sent = compaction.transfers(compaction.wired_pairs(flagged.where("chosen").drop("chosen")), config)
    after = compaction.applied(flagged, sent).join(sent.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
    first = compaction.contract(ext, config).rounds[0]
    assert (first.rows, first.touched) == after.agg(F.count("*"), F.count_distinct("node")).first()


def test_ends_are_added_in_one_pass(spark):
    """One exchange by node makes the ends, the flags and the wires, without a table between."""
    config, ext = _graph(spark)
    flagged = compaction.chosen_first(wiring.balanced(ext), config)
    for made in (wiring.wires(flagged), compaction.wired_pairs(flagged.where("chosen"))):
        plan = made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in plan and "Join" not in plan
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(node") == 1


def test_texts_are_counted_without_making_reads_first(spark):
    """letters that are no bases are dropped in the counting task; minimizers are chosen and k-mers spelled there too."""
    config = AssemblyConfig(k=21, minimizer=8, buckets=3)
    texts = ["A cat, a tag: gattaca! " * 40, "", None, "Ää Cç€ uU gG tT" * 30, "acgt", genome(300, 3), genome(300, 3).lower(), "x" + genome(5000, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    reads, raw = fasta.reads_from_table(docs, "doc_id", "text"), docs.selectExpr("text AS seq")
    counts, lmers = kmers.kmer_counts(reads, config), kmers.lmer_frequencies(reads, config)
    found = kmers.counted_minimizers(raw, config, bases_only=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "regexp" not in plan and "conv(" not in plan
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(found, "kmer", "cnt", "minimizer", "pos") == rows(kmers.minimizers(counts, lmers, config), "kmer", "cnt", "minimizer", "pos")
    assert rows(kmers.lmer_frequencies(raw, config, bases_only=True), "lmer", "freq") == rows(lmers, "lmer", "freq")
    kept, cutoff = assembly.valid(raw, config, bases_only=True)
    assert rows(kept, "kmer", "cnt") == rows(counts.where(f"cnt >= {cutoff}"), "kmer", "cnt")
    assert packed.summed_runs(raw, config, True).count() < counts.count() / 100
    with pytest.raises(histogram.NothingLeft):
        assembly.valid(raw.where("seq = ''"), config, bases_only=True)


@pytest.mark.parametrize("bases_only", [False, True])
def test_long_reads_are_cut_into_overlapping_slices(monkeypatch, bases_only):
    """each window of a read longer than a slice is in one slice, and in one only."""
    monkeypatch.setattr(packed, "LETTERS", 50)
    n, text = 7, genome(1234, 9)
    for size in (*range(45, 70), 1234):
        batch = pa.record_batch([pa.array(["AC", text[:size], "", "GATTACAGATTACA"])], ["seq"])
        slices = list(packed._slices([batch], "strict", n, bases_only))
        got = sum((b.packed(n)[1][b.starts(n)].tolist() for b in slices), [])
        whole = next(packed._slices([pa.record_batch([pa.array([text[:size]])], ["seq"])], "strict", 10_000, bases_only))
        last = next(packed._slices([pa.record_batch([pa.array(["GATTACAGATTACA"])], ["seq"])], "strict", n, bases_only))
        assert sorted(got) == sorted(whole.packed(n)[1][whole.starts(n)].tolist() + last.packed(n)[1][last.starts(n)].tolist())
        assert all(b.n <= 4 * 50 + n for b in slices)


def test_a_round_is_one_job(spark):
    """A round is one exchange of messages, whatever came before; most of its time was planning and further jobs."""
    config, ext = _graph(spark, 20)
    ext = spark.createDataFrame(wiring.balanced(ext).collect(), wiring.balanced(ext).schema)
    context = spark.sparkContext
    context.setJobGroup("contraction-rounds", "rounds of a contraction")
    try:
        done = compaction.contract(ext, config)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("contraction-rounds"))
    assert len(done.rounds) > 5 and jobs <= len(done.rounds) + 6


@pytest.mark.parametrize("pieces, held", [(0, 1), (2, 3), (100, 10**6)])
def test_rounds_by_shares_equal_rounds_by_tables(spark, monkeypatch, pieces, held):
    """Every round leaves the extensions that joins and windows over whole tables leave."""
    monkeypatch.setattr(compaction, "SETTLED_TABLES", pieces)
    monkeypatch.setattr(shares, "HELD", held)
    config, ext = _graph(spark)
    ext = wiring.balanced(ext)
    rows = lambda df: sorted(map(tuple, df.select(*compaction.EXT).collect()))
    want, partial = ext, []
    n = ext.select("node").distinct().count()
    for number in range(1, 7):
        flagged = compaction.chosen_first(want, config).cache()
        pairs = compaction.wired_pairs(flagged.where("chosen").drop("chosen"))
        partial += [r.seq for r in compaction.partial_contigs(pairs).collect()]
        want = compaction.applied(flagged, compaction.transfers(pairs, config)).localCheckpoint()
        n = want.select("node").distinct().count()
        done = compaction.contract(ext, dataclasses.replace(config, node_limit=n))
        assert len(done.rounds) == number and rows(done.ext) == rows(want)
        assert sorted(r.seq for r in done.partial.collect()) == sorted(partial)


def test_a_message_to_a_node_that_is_gone_is_an_error(tmp_path):
    class Index:
        value: dict = {}

    message = (b"01" * 4, 1, b"00" * 4, 0, 0, b"0", b"1", 1, 1, False)
    box = shares.Outbox()
    box.tell(message)
    with pytest.raises(ValueError, match="no node for a transfer to 01010101"):
        list(shares.next_round(str(tmp_path), 1, Index, 8)(box.handed_on()))


def test_pieces_of_a_share_are_put_together(tmp_path):
    """Later pieces are one when they are many, and the first goes when they are as large; nodes that are gone go with it."""
    states: dict = {b"%04d" % i: b"x%d" % i * 9 for i in range(200)}
    file = shares.Pieces(str(tmp_path))
    pieces = [file.add(states)]
    file.close()
    first = pieces[0]
    for now in range(1, 400):
        node = b"%04d" % (now * 7 % 200)
        changed = {node: (now, b"gone") if now % 5 == 0 else hashlib.sha256(b"%d" % now).digest()}
        file, reader = shares.Pieces(str(tmp_path)), shares.Reader(str(tmp_path))
        pieces = shares._pieces_after(pieces, dict(states), changed, file, reader, now, 4)
        file.close()
        states.update(changed)
        read: dict = {}
        for p in pieces:
            read.update(reader.get(p))
        alive = lambda d: {k: v for k, v in d.items() if type(v) is bytes or v[0] == now}
        assert len(pieces) <= 5 and alive(read) == alive(states)
    assert pieces[0] != first


@pytest.mark.parametrize("mode", ["reference", "full_flow"])
@pytest.mark.parametrize("block, longest", [(1, 1024), (40, 3), (10**6, 1024), (10**6, 2)])
def test_stretches_give_the_walks_of_single_steps(spark, monkeypatch, mode, block, longest):
    """wherever blocks and pieces are cut."""
    monkeypatch.setattr(stretches, "BLOCK", block)
    monkeypatch.setattr(stretches, "LONGEST", longest)
    r = random.Random(7)
    unit = genome(14, 5)
    reads = [genome(10, i) + unit + genome(9, 90 + i % 3) + unit + genome(8, i // 2) for i in range(4)]
    reads += [r.choice(reads)[3:40] for _ in range(4)] + [genome(30, 11) * 2]
    want = model.assemble(reads, 7, full_flow=mode == "full_flow")[1]
    config = AssemblyConfig(k=7, minimizer=3, buckets=1, node_limit=None, walk=mode)
    ext = wiring.balanced(graph.extensions(kmers.kmer_counts(table(spark, reads), config), config))
    rows = [(e.node.encode(), e.side == "S", e.seq.encode(), e.cnt, e.visit, e.terminal) for e in sorted(ext.collect())]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], list(shares.EXTENSION))
    pieces = [r for b in stretches.blocks([batch.slice(0, 5), batch.slice(5)]) for r in b.to_pylist()]
    assert max(p["steps"] or 0 for p in pieces) <= longest
    assert sorted(x.seq.translate(str.maketrans("0123", "ACTG")) for x in walk.walk_contigs(ext, config).collect()) == want


def test_what_is_composed_is_stretches(spark):
    """maps of a walk have a row a stretch, not a row a step."""
    import glob

    from strandloom.session import checkpoint_folder

    config = AssemblyConfig(k=15, minimizer=3, buckets=1, node_limit=None)
    ext = wiring.balanced(graph.extensions(kmers.kmer_counts(table(spark, [genome(1500, 21)]), config), config))
    before = set(glob.glob(f"{checkpoint_folder(spark)}/walk-map-*"))
    chunks = walk.walk_chunks(ext, config, 100).collect()
    assert [len(c.text) for c in sorted(chunks, key=lambda c: c.chunk)] == [100] * 15
    made = [p for p in glob.glob(f"{checkpoint_folder(spark)}/walk-map-*") if p not in before]
    assert sum(spark.read.parquet(p).count() for p in made) < 1487


def test_a_stretch_to_nowhere_is_an_error():
    nodes = {b"0001": ([(b"", 1, 2, True)], [(b"2", 1, 2, False)]), b"0012": ([(b"3", 1, 2, False)], [(b"", 1, 2, True)])}
    with pytest.raises(ValueError, match="no prefix for a step to 0012"):
        list(stretches.followed(nodes, 0))


def test_walks_of_many_seeds_in_batches():
    """seeds are judged batch by batch, as each is alone."""
    r = random.Random(5)
    rows = []
    for port in range(60):
        at = 0
        for i in range(r.randint(1, 6)):
            size = r.randint(1, 9)
            rows.append((port, at, at + size, r.randint(0, 4) if i else None, 7))
            at += size
    of = lambda some: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))], ["port", "lo", "hi", "split", "steps"])
    want = [tuple(x.values()) for port in range(60) for x in walk._kept(pa.Table.from_batches([of([x for x in rows if x[0] == port])])).to_pylist()]
    for size in (1, 4, 1000):
        got = [tuple(x.values()) for b in walk._kept_of_all([of(rows[i : i + size]) for i in range(0, len(rows), size)]) for x in b.to_pylist()]
        assert got == want
