import random

import pytest

from strandloom.config import AssemblyConfig
from strandloom.operators import histogram, kmers
from strandloom.streaming import running_counts as R

CONFIG = AssemblyConfig(k=5, minimizer=3, buckets=4)


def add(spark, folder, reads):
    spark.createDataFrame([(r,) for r in reads], "seq string").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, state):
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(folder)
    R.updates(stream, CONFIG, state).trigger(availableNow=True).start().awaitTermination()


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def check(spark, state, reads):
    """State, changes and histogram against one batch query over all reads so far."""
    counts = kmers.kmer_counts(spark.createDataFrame([(r,) for r in reads], "seq string"), CONFIG)
    assert pairs(R.running_counts(spark, state, CONFIG)) == pairs(counts)
    assert pairs(R.running_histogram(spark, state, CONFIG)) == pairs(histogram.count_histogram(counts, CONFIG.buckets))
    assert pairs(R.running_valid(spark, state, CONFIG)) == pairs(histogram.valid_kmers(counts, CONFIG.buckets))
    return R.latest(spark, state, CONFIG)[1].cutoff


@pytest.fixture(scope="module")
def batches():
    r = random.Random(4)
    known = ["".join(r.choice("ACGT") for _ in range(30)) for _ in range(40)]
    few, many = known[:20], known[20:]
    return [few + few, [], many[:3], few[:8] + ["ACG", "NNNNNNN"], many + many]


def test_after_each_start_equal_to_the_batch_query(spark, tmp_path, batches):
    folder, state, seen, cutoffs = str(tmp_path / "in"), str(tmp_path / "state"), [], []
    for batch in batches:
        add(spark, folder, batch)
        run(spark, folder, state)  # a new query each time: a restart from the checkpoint
        seen += batch
        cutoffs.append(check(spark, state, seen))
    assert len(set(cutoffs)) > 1, "the cut-off is to move in this test"
    crossed = R.changes(spark, state, CONFIG)
    assert crossed.where("not valid").count() > 0
    now = R.latest(spark, state, CONFIG)[1]
    assert len(now.segments) <= len(batches).bit_length()
    met = {}
    for r in crossed.orderBy("batch").collect():
        assert met.get(r.kmer, False) != r.valid, "each change is a change"
        met[r.kmer] = r.valid


def test_another_batching(spark, tmp_path, batches):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    seen = [r for b in batches for r in b]
    for i in range(0, len(seen), 37):
        add(spark, folder, seen[i : i + 37])
    run(spark, folder, state)
    check(spark, state, seen)


def test_a_batch_that_failed_half_way_is_run_again(spark, tmp_path, batches, monkeypatch):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for batch in batches[:3]:
        add(spark, folder, batch)
    crossing, calls = R._crossing, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost after its segment was written")
        return crossing(*args)

    monkeypatch.setattr(R, "_crossing", failing)
    with pytest.raises(Exception, match="lost after"):
        run(spark, folder, state)
    monkeypatch.setattr(R, "_crossing", crossing)
    run(spark, folder, state)
    check(spark, state, [r for b in batches[:3] for r in b])


def test_segments_are_not_exchanged(spark, tmp_path, batches):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    add(spark, folder, batches[0])
    run(spark, folder, state)
    now = R.latest(spark, state, CONFIG)[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = spark.createDataFrame([("01230", 1)], "kmer string, more long").groupBy("kmer").sum("more")
        plan = some.join(R._segment(spark, state, now.segments[0], now.parts), "kmer", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1


def test_before_the_first_batch(spark, tmp_path):
    state = str(tmp_path / "state")
    assert pairs(R.running_histogram(spark, state, CONFIG)) == [(1, 0), (2, 0), (3, 0)]
    assert not any(f(spark, state, CONFIG).collect() for f in (R.running_counts, R.running_valid, R.changes))
