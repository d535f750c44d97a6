"""Fill-in-the-middle forms and the Merkle manifest, held against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from strandloom.llm import fillmiddle, merkle
from tests.llm.fixtures import awkward, prose, table

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=1500))
def test_rank_and_select(flags):
    flags = np.array(flags, bool)
    bits = fillmiddle.RankSelect(flags)
    assert (bits.rank(np.arange(len(flags) + 1)) == np.r_[0, np.cumsum(flags)]).all()
    places = np.flatnonzero(flags)
    assert (bits.select(np.arange(len(places))) == places).all()


def formed(doc_id, text):
    t = text or ""
    u = TOKEN.findall(t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 80:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rows = awkward()
    rows += [(100 + i, prose(i % 40, i) + " " * (i % 3) + ("<", "", "\n", "P>", "é日")[i % 5], "en", "a", 1) for i in range(200)]
    rows += [(400 + i, "some " + mark + " text", "en", "a", 1) for i, mark in enumerate(["<P>", "<S>", "<M>", "<p>", "<P", "P>"])]
    docs = table(spark, rows)
    out = fillmiddle.fill_in_middle(docs)
    assert out.columns == docs.columns + ["n_", "form", "prefix_chars", "middle_chars", "output"]
    want = [formed(i, t) for i, t, *_ in rows]
    got = out.select("doc_id", "n_", "form", "prefix_chars", "middle_chars", "output").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    back = out.select(fillmiddle.restored(out.output, out.form).alias("t"), "text").collect()
    assert all(r.t == (r.text or "") for r in back)
    report = Counter(map(tuple, fillmiddle.middle_report(docs).collect()))
    assert report == Counter((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t, *_) in zip(want, rows))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        run = level[i // 2 * 2 : i // 2 * 2 + 2]
        yield run[: i % 2], run[i % 2 + 1 :]
        i //= 2


def manifest(rows):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: sha("".join(map(framed, (i, source, lang, n, text))))
    by_lang = {}
    for i, text, lang, source, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        by_lang.setdefault(lang, []).append(((i is not None, i or 0), leaf(i, text, lang, source, n), leaf(i, text, lang, source, n + 1) if hit else None, i))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels([r[1] for r in sorted(by_lang[lang], key=lambda r: r[:2])]) for lang in langs}
    top = levels([trees[lang][-1][0] for lang in langs])
    for k, lang in enumerate(langs):
        for j, (_, own, tampered, i) in enumerate(sorted(by_lang[lang], key=lambda r: r[:2])):
            h, beside = tampered or own, ""
            for left, right in [*way(trees[lang], j), *way(top, k)]:
                h, beside = sha("".join([*left, h, *right])), beside + "".join(left + right)
            yield i, own, trees[lang][-1][0], top[-1][0], sha(beside), h, h == top[-1][0]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "STOREY", height)
    rows = awkward() + [(100 + i, prose(3, i), ["en", "de", "fr", None, "it", "Ω", "é"][min(i % 11, 6)], "a", i if i % 4 else None) for i in range(70)]
    got = merkle.manifest(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(manifest(rows))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(7, "one", "en", "a", 1)], [(7, "one", "en", "a", 1), (8, "two", None, "a", 1), (9, "three", None, "a", 1)]])
def test_small_manifests_and_empty_tables(spark, rows):
    docs = table(spark, rows)
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == Counter(manifest(rows))
    assert fillmiddle.middle_report(docs).count() == len(rows)
