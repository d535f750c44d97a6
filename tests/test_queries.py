import pytest

from strandloom import queries

#: A limit that the small tables go below, in place of the registered one.
SMALL_LIMIT = 3_000


@pytest.fixture
def small_limit(monkeypatch):
    before = f"r.n > {queries.NODE_LIMIT}"
    monkeypatch.setattr(queries, "NODE_LIMIT", SMALL_LIMIT)
    return lambda sql: sql.replace(before, f"r.n > {SMALL_LIMIT}")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_sql(same, small_limit, name):
    same(queries.QUERIES[name], small_limit(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", ["partial_contigs", "lost_flow", "flow_cycles", "contig_fasta"])
def test_sql_gives_rows(duck, small_limit, name):
    assert duck.sql(small_limit(queries.ORACLE_SQL[name])).fetchall()


def test_contraction_statistics_fall(spark, small_limit):
    from tests.conftest import SF

    rows = sorted(queries.QUERIES["compaction_stats"](spark, SF).collect())
    assert [r["iter"] for r in rows] == list(range(len(rows))) and len(rows) > 0
    for a, b in zip(rows, rows[1:]):
        assert a["n_nodes"] - a["id_set_size"] == b["n_nodes"]
    assert all(r["id_set_size"] >= 1 for r in rows)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).take(1)
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["contig_fasta", "contigs_read_back"])
def test_chunks_are_spelled_once(spark, name):
    """names, ranges and lines read chunks that were written, not the walks again."""
    from strandloom.operators import walk
    from tests.conftest import SF

    calls = []
    spelled = walk.spelled

    def once(*a, **k):
        chunks = spelled(*a, **k)
        calls.append(chunks)
        return chunks

    walk.spelled = once
    try:
        found = queries.QUERIES[name](spark, SF)
    finally:
        walk.spelled = spelled
    assert len(calls) == 1
    assert "walk-places" not in "".join(found.inputFiles())
