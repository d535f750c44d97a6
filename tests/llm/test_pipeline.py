import zlib

import numpy as np
import sentencepiece

import corpus_pipeline
from strandloom.llm.queries import tokenizer_file
from tests.llm.fixtures import prose
from tests.llm.test_documents import components, family


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    clean = [(i, prose(80, 500 + i), "en", "abc"[i % 3], 1) for i in range(30)]
    passage = prose(70, 900)
    shared = [(60 + i, prose(60, 700 + i) + " " + passage + " " + prose(60, 800 + i), "en", "a", 1) for i in range(2)]
    rows = clean + shared + [*family(100, 6, 90, 5, 1)] + [(200, "too short", "en", "a", 1), (201, "same word " * 40, "en", "b", 1), (202, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path)
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], path).cache())
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert all(d.columns == docs.columns for d in seen[:5])
    assert ids[1] == sorted(set(ids[0]) - {200, 201, 202})
    kept = [r for r in rows if r[0] in ids[1]]
    assert ids[2] == sorted({c for _, _, c in components(kept)}) and set(range(30)) <= set(ids[2])
    assert ids[3] == ids[2]
    texts = {r.doc_id: r.text for r in seen[3].collect()}
    assert all(texts[i] == t for i, t, *_ in clean)
    assert all(passage not in texts[60 + i] and texts[60 + i].startswith(prose(60, 700 + i)[:200]) for i in range(2))
    size = {r.source: r.n for r in seen[3].selectExpr("source", "size(split(trim(text), '[ ]+')) AS n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    mixed = {r.source: r.n for r in seen[4].selectExpr("source", "size(split(trim(text), '[ ]+')) AS n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    total = sum(size.values())
    assert abs(mixed["a"] - min(3 * size["a"], total * 5 / 8)) < 300 and set(ids[4]) <= set(ids[3])
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for r in seen[5].collect():
        want = np.array(library.encode(texts[r.doc_id]), "<u4")
        assert r.n_pieces == len(want) and r.ids_crc32 == zlib.crc32(want.tobytes()) and r.ids == want.tolist() and r.round_trip


def test_awkward_documents_pass_the_stages(spark, tmp_path):
    """Repeated doc_ids, null doc_ids, very long texts and extra columns; and no rows at all."""
    from tests.llm.fixtures import awkward, table

    twice = [(50, prose(80, 40), "en", "a", 1)] * 2 + [(None, prose(80, 41), "en", "b", 1)] * 2
    for rows in (awkward() + twice, []):
        docs = table(spark, rows)
        seen = [docs]
        for _, stage in corpus_pipeline.STAGES:
            seen.append(stage(spark, seen[-1], str(tmp_path)).cache())
        assert all(d.columns == docs.columns for d in seen[:5])
        if rows:
            kept = [(r.doc_id, r.text) for r in seen[3].collect()]
            assert kept.count((50, prose(80, 40))) == 1 and kept.count((None, prose(80, 41))) == 1
            assert {i for i, _ in kept} >= {1, 7, 8}
        else:
            assert seen[5].count() == 0


def test_run_on_a_data_folder(spark):
    from tests.conftest import SF

    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 20 and got.where("NOT round_trip").count() == 0
