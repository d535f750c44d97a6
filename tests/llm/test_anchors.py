"""Repeated runs of words, held against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import blockanchors as B
from tests.llm.fixtures import awkward, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, window):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    order = [float("inf") if i is None else i for i, *_ in rows]
    least = {}
    for w, o in zip(words, order):
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            least[run] = min(least.get(run, o), o)
    for (doc_id, *_), w, o in zip(rows, words, order):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < o:
                gone[i : i + window] = True
        yield doc_id, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)


def fixture():
    r = random.Random(3)
    rows = awkward()
    passage = prose(60, 77).split()
    for i in range(60):  # parts of one passage, at any distance from their document's start
        a, n = r.randrange(40), r.randrange(8, 30)
        rows.append((r.choice([100 + i, 100 + i, None, 100]), prose(r.randrange(12), i) + " \n" + " ".join(passage[a : a + n]) + "\t" + prose(r.randrange(9), 500 + i), "en", "a", 1))
    rows.append((90, "again " * 300, "en", "a", 1))
    rows += [(91 + i, "again " * (11 + i), "en", "a", 1) for i in range(4)]
    rows += [(None, " ".join(passage), "en", "a", 1)] * 2
    return rows


@pytest.mark.parametrize("settings", [{}, {"task_words": 150, "slice_words": 40, "range_words": 1000, "least_ranges": 1}, {"task_words": 1 << 14, "slice_words": 8, "least_ranges": 64}, {"window": 6, "task_words": 700}])
def test_words_of_earlier_windows_go(spark, settings):
    rows, config = fixture(), B.AnchorConfig(**settings)
    want = list(removed(rows, config.window))
    docs = table(spark, rows)
    out = B.without_repeats(docs, config)
    assert out.columns == docs.columns + ["n_words", "n_removed", "kept_sha256", "kept_"]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_) for r in out.collect()) == Counter(want)
    assert all(r.n == "n" and r.key == "key" for r in out.select("n", "key").collect())
    report = B.removal_report(docs, config).collect()
    assert Counter(map(tuple, report)) == Counter((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in want)
    assert sum(w[2] for w in want) > 300


def test_an_empty_table(spark):
    assert B.removal_report(table(spark, [])).count() == 0


def test_packed_entries_come_back():
    rng = np.random.default_rng(1)
    doc = np.sort(rng.integers(0, 50, 400))
    keys, ids = rng.integers(0, 1 << 63, 50).astype(np.uint64), rng.integers(-9, 9, 50)
    for kind in (np.uint32, np.uint64):
        h, at = rng.integers(0, 1 << 32, 400).astype(kind), rng.integers(0, 1 << 31, 400)
        for with_ids in (None, ids):
            got = B.unpack(B.pack(h, at, doc, keys, with_ids))
            assert (got[0] == h).all() and (got[1] == at).all() and (got[3][got[2]] == keys[doc]).all()
            assert with_ids is None or (got[4][got[2]] == ids[doc]).all()
