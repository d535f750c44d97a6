"""Operators on whole documents, held against brute force."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import jaccard, langid, lmscore, mixing, quality, recordfiles, sentencepieces, suffixdedup, wordpieces
from strandloom.llm.eliasfano import EliasFano
from strandloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from tests.llm.fixtures import awkward, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(same, name):
    same(QUERIES[name], ORACLE_SQL[name])


# ---- suffix dedup


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        keep = np.ones(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                keep[i : i + length] = False
        runs = int((~keep[1:] & keep[:-1]).sum() + (len(b) > 0 and not keep[0]))
        yield len(b), int((~keep).sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[keep].tobytes()).hexdigest()


@pytest.mark.parametrize("settings", [{}, {"hot": 2, "range_rows": 60, "run_rows": 50, "sample_per_range": 5, "broadcast_rows": 0}])
def test_suffix_dedup(spark, settings):
    passage = prose(45, 9)
    rows = awkward() + [(20 + i, prose(20, 50 + i) + passage[i * 3 : 260 + i] + prose(12, 70 + i), "en", "a", 1) for i in range(6)]
    rows.append((40, ("ab" * 150) + prose(9, 1) + ("ab" * 150), "en", "a", 1))
    shared = prose(40, 8)  # a passage with less and less of it, and other words around: one beginning, many contexts
    rows += [(50 + i, prose(8, 90 + i) + shared[9 * i : 9 * i + 105 + 11 * (i % 9)] + prose(8, 30 + i % 5), "en", "a", 1) for i in range(9)]
    rows += [(60 + i, prose(30, 40 + i % 2)[: 150 + 3 * i] + shared[:130] + prose(30, 60 + i % 3), "en", "a", 1) for i in range(9)]
    got = suffixdedup.removal_report(table(spark, rows), suffixdedup.SuffixConfig(**settings)).collect()
    want = [(i, *x) for (i, *_), x in zip(rows, removed([r[1] for r in rows], 200))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_only_groups_beyond_two_ranges_are_split(spark):
    config = suffixdedup.SuffixConfig()
    for n, hot in ((12_000, False), (config.hot, False), (config.hot + 1, True)):
        starts = spark.range(n).selectExpr("1L AS start", "id AS class", "0L AS pos")
        assert [r.hot for r in suffixdedup.shared_anchors(starts, config).select("hot").distinct().collect()] == [hot]


def test_columns_of_any_name_stay(spark):
    from pyspark.sql import functions as F

    rows = [(i, prose(60, 1 if i < 2 else i), "en", "ab"[i % 2], 1) for i in range(6)]
    taken = ["_class", "_spans", "_kept", "_touched", "_copied", "own_class", "cut_spans", "kept_", "Touched", "n_bytes", "_at", "_copy", "_source", "_cut", "_epochs", "own_source", "epochs", "cut", "place", "copy"]
    docs = table(spark, rows).select("*", *[F.lit(c).alias(c) for c in taken])
    for out in (suffixdedup.deduplicated(docs), mixing.mixed_documents(docs), jaccard.one_of_each(docs), quality.keep_good(docs)):
        assert out.columns == docs.columns and all(r[c] == c for r in out.collect() for c in taken)


def test_loser_tree_and_front_coding():
    rng = np.random.default_rng(0)
    rows = rng.integers(97, 99, (400, 12)).astype(np.uint8)
    rows = rows[np.argsort(rows.view("S12").ravel(), kind="stable")]
    shared, rest = suffixdedup.front_code(rows)
    assert (suffixdedup.front_decode(shared, rest, 12) == rows).all() and len(rest) < rows.size / 2
    for runs in (1, 3, 8):
        label = rng.integers(0, runs, 400)
        lists = [[bytes(x) for x in rows[label == r]] for r in range(runs)]
        prefixes = [suffixdedup.common_prefix(rows[label == r]).tolist() for r in range(runs)]
        out = list(suffixdedup.LoserTree(lists, prefixes))
        assert [lists[r][i] for r, i, _ in out] == [bytes(x) for x in rows]
        assert [p for *_, p in out] == suffixdedup.common_prefix(rows).tolist()


def test_suffix_dedup_of_nothing(spark):
    assert suffixdedup.removal_report(table(spark, [])).count() == 0
    assert suffixdedup.deduplicated(table(spark, [])).count() == 0


# ---- Jaccard join


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(s), min((x for x in groups[find(i)] if x is not None), default=None)) for i, ((d, *_), s) in enumerate(zip(rows, sets))]


def family(first, n, words, seed, edits):
    """Near copies of one text, each with its own edits."""
    base = prose(words, seed).split()
    for k in range(n):
        w = base[:]
        for e in range(edits):
            w[(7 * k + 11 * e) % words] = f"edit{k}x{e}"
        yield first + k, " ".join(w), "en", "a", 1


@pytest.mark.parametrize("settings", [{}, {"frequent": 1, "pairs_per_row": 0, "broadcast_rows": 0}])
def test_jaccard(spark, settings):
    rows = awkward()
    rows += [*family(100, 12, 90, 5, 1), *family(200, 8, 60, 6, 2), *family(300, 5, 9, 7, 1), (400, "a b c", "en", "a", 1), (401, "A b c", "en", "a", 1)]
    got = jaccard.jaccard_components(table(spark, rows), jaccard.JaccardConfig(**settings)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, components(rows)))


def test_candidates_of_one_doc_id_meet_their_own_text_only(spark):
    """2,000 rows without an id in near-equal pairs: as many texts are read again as there are rows, not pairs of them."""
    rows = [(None, prose(60, i // 2) + f" end{i % 2}", "en", "a", 1) for i in range(2000)] + [(5, prose(60, 9000 + i) + " x", "en", "a", 1) for i in range(4)]
    docs, config = table(spark, rows), jaccard.JaccardConfig()
    got = jaccard.jaccard_components(docs, config).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, 57, i)) for i, *_ in rows)
    texts = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "xxhash64(text) AS node")
    read = jaccard.candidate_tokens(docs, texts, config)
    assert read._jdf.queryExecution().toRdd().toJavaRDD().isEmpty()  # no text has such a node, and the join ends at once


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(table(spark, [])).count() == 0
    assert jaccard.one_of_each(table(spark, [(1, None, None, None, None)])).count() == 1


def test_jaccard_of_a_large_group_around_one_text(spark):
    """300 copies with edits of few words: most link with the text only, some with each other only, some with none."""
    import random

    r, base = random.Random(5), prose(150, 31).split()
    rows = [(0, " ".join(base), "en", "a", 1)]
    for k in range(1, 301):
        rate = r.choice([0.005, 0.01, 0.02, 0.03])
        w = [r.choice("xyz") if r.random() < rate / 2 else x for x in base if r.random() > rate / 2]
        rows.append((k, " ".join(w), "en", "a", 1))
    rows += [(1000 + i, prose(80, 2000 + i), "en", "a", 1) for i in range(700)]
    got = jaccard.jaccard_components(table(spark, rows)).collect()
    want = components(rows)
    assert len({c for i, _, c in want if i < 1000}) > 10 and sorted(map(tuple, got)) == sorted(want)


def test_one_row_of_each_group_stays(spark):
    text, near = prose(60, 1), prose(60, 1).replace("alpha", "ALPHA") + " x"
    rows = [(50, text, "en", "a", 1), (50, text, "de", "b", 2), (51, near, "en", "a", 1), (None, prose(60, 2), "en", "a", 1), (None, prose(60, 2), "en", "a", 1)]
    rows += [(60, "", "en", "a", 1), (60, "", "en", "a", 1), (None, None, None, None, None)]
    for limit in (0, 100):
        got = jaccard.one_of_each(table(spark, rows), jaccard.JaccardConfig(broadcast_rows=limit)).collect()
        assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("50", text), ("None", prose(60, 2)), ("60", ""), ("60", ""), ("None", "")])


def test_combinations_are_shared_by_linked_sets():
    rng = np.random.default_rng(3)
    config = jaccard.JaccardConfig(frequent=2)
    for _ in range(300):
        n = int(rng.integers(3, 80))
        x = rng.choice(2000, n, replace=False)
        y = x.copy()
        cut = int(rng.integers(0, n // 4 + 1))
        y[:cut] = rng.integers(3000, 9000, cut)
        y = np.unique(y)
        if 100 * len(set(x) & set(y)) < 75 * len(set(x) | set(y)):
            continue
        holders = {t: 1 + int(t * 7 % 5) for t in set(x) | set(y)}

        def index(s):
            pairs = sorted((min(max(holders[t], 2), 3), int(t)) for t in s)
            return set(jaccard.combinations(np.array([t for _, t in pairs]), np.array([h for h, _ in pairs]), len(s), config).tolist())

        assert index(x) & index(y) or set(x) == set(y)


# ---- token records


def test_pre_tokens_equal_the_library():
    import random

    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(1)
    parts = ["'s", "'re", "'", " ", "  ", "\n", "\t", "a", "é", "1", "!", "日", "\u00a0", "<|endoftext|>", "\u0378", "😀", "²", "'D", "the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(25))) for _ in range(600)] + [None, ""]
    got = dict(wordpieces.encode_column(pa.array(texts, pa.string()), path))
    assert all(got[i].tolist() == library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts))


def test_records(spark, tmp_path):
    rows = awkward()
    path = tokenizer_file("byte_bpe_50k.json")
    records = recordfiles.write_records(table(spark, rows), path, path=str(tmp_path / "r"))
    got = recordfiles.read_records(table(spark, rows), records).collect()
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(path), 0, []
    for i, t, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    base, n, _ = records.files[-1]
    whole = [ids.tolist() for _, ids in recordfiles.read_indexed(base)]
    order = np.arange(n)[::-1]
    assert [ids.tolist() for _, ids in recordfiles.read_indexed(base, order)] == whole[::-1]
    raw = bytearray(open(base + ".rec", "rb").read())
    raw[14] ^= 1
    open(base + ".rec", "wb").write(raw)
    with pytest.raises(ValueError):
        list(recordfiles.read_indexed(base))
    assert recordfiles.tokenize_to_records(table(spark, []), path).count() == 0


# ---- mixing


def test_mix(spark):
    rows = [(i, prose(3 + i % 9, i), "en", ["a", "b", None][i % 7 % 3], 1) for i in range(60)] + [(i, t, lang, s, n) for i, t, lang, s, n in awkward()]
    docs = table(spark, rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect()), key=str)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(x) == math.floor(t + 0.5) for (_, t), x in by.items())
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-6
    assert all(t <= 3 * s + 1e-9 for s, t in by)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix_sources(table(spark, [])).count() == 0 and mixing.mixed_documents(table(spark, [])).count() == 0


def test_slices_grow_and_change_nothing(spark):
    assert [mixing.digits_for(n, 20_000) for n in (0, 81_920_000, 81_920_001, 10**11)] == [3, 3, 4, 6]
    rows = [(i, prose(3 + i % 9, i), "en", ["a", "b", None][i % 7 % 3], 1) for i in range(60)] + [(None, prose(4, 300 + i), "en", "a", 1) for i in range(40)]
    docs = table(spark, rows)
    few, many = ([sorted(map(str, f(docs, slice_rows=n).collect())) for f in (mixing.mix_sources, mixing.mixed_documents)] for n in (20_000, 0.001))
    assert few == many and len(few[0]) == 100
    keys = docs.where("doc_id is null").select(mixing.random_key(docs.doc_id, docs.text, "mix").alias("key"))
    assert keys.distinct().count() == 40  # rows without an id do not share a key


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    left = 2015 - 30 - 15
    assert got == {"a": 30.0, "b": pytest.approx(left * 2 / 3), "c": pytest.approx(left / 3), None: 15.0}


# ---- quality


def test_quality(spark):
    rows = awkward() + [(50, "a b c d e f g h i j " * 8, "en", "a", 1), (51, "$$$ *** ### " * 40 + prose(30, 1), "en", "a", 1), (52, "x # y\nx # y\nz | z", None, "a", 1)]
    rows += [(60 + i, prose(150, 200 + i), "en", "a", 1) for i in range(10)]
    got = {r.doc_id: r for r in quality.score_quality(table(spark, rows)).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert not got[51].kept and got[60].kept and got[7].kept and not got[4].kept
    docs = table(spark, rows)
    assert quality.keep_good(docs).columns == docs.columns
    assert sorted(str(r.doc_id) for r in quality.keep_good(docs).select("doc_id").collect()) == sorted(str(r.doc_id) for r in quality.score_quality(docs).where("kept").collect())
    assert quality.score_quality(table(spark, [])).count() == 0


def test_common_words_alone_reject(spark):
    import random

    def text(n, seed, common):
        r = random.Random(seed)
        return " ".join(r.choice(common) if common and r.random() < 0.3 else r.choice("mno") + "".join(r.choices("aeiourstln", k=6)) for _ in range(n))

    english, german = "the of and to in is that for it".split(), "der die und das den ist von zu mit".split()
    rows = [(i, text(150, i, english), "en", "a", 1) for i in range(40)] + [(100 + i, text(150, 100 + i, german), "de", "a", 1) for i in range(5)]
    rows += [(200 + i, text(150, 200 + i, None), "xx", "a", 1) for i in range(5)]  # a language without any of the words
    rows += [(300, text(150, 300, None), "en", "a", 1), (301, text(150, 301, german), "en", "a", 1), (302, text(90, 302, None), "en", "a", 1)]
    rows += [(310, text(150, 310, german), None, "a", 1), (311, text(150, 311, None), None, "a", 1)]
    got = {r.doc_id: r for r in quality.score_quality(table(spark, rows)).collect()}
    assert not any(r.base_failed or r.class_distance > quality.QualityConfig.max_class_distance for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {300, 301, 311}


def _divergence(p, q):
    p, q = ([x / max(1, sum(v)) for x in v] for v in (p, q))
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    mean = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt(max(0.0, (kl(p, mean) + kl(q, mean)) / 2)) if sum(p) and sum(q) else None


def _histograms(text):
    classes = [0] * 8
    for c in text:
        kind = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\v\f\r" else 4 if c in "#*$%&|<>" else 5 if c < "\x80" else 6 if unicodedata.category(c)[0] in "LM" else 7
        classes[kind] += 1
    common = Counter(w.translate(LOWER) for w in WORD.findall(text))
    known = [common[w] for w in dict.fromkeys(quality.COMMON_WORDS)]
    return classes, known + [sum(common.values()) - sum(known)]


def test_quality_verdicts_and_distances_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    rare = [(-1, "$ & * < > | 12 ?! " * 40, "zz"), (-2, "a sole text of the language that it is in " + prose(150, 9), "yy")]
    rare += [(-3, "×÷«» “quoted” … 、。 ☃ 😀 е́ ქართული ខ្មែរ 中文字 ａＢ Ⅷ ½ ﷺ 𝒳 𐍈 " * 20, None), (-4, "\u00b5\u00aa\u0301\uffff\U0010ffff", "en")]
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, g) for i, t, g in rare], "doc_id long, text string, lang string"))
    rows += rare
    config, references = quality.QualityConfig(), {None: ([0] * 8, [0] * (quality.N_COMMON + 1))}
    for _, t, g in rows:
        found = _histograms(t)
        for key in {g, None}:
            now = references.get(key, ([0] * 8, [0] * (quality.N_COMMON + 1)))
            references[key] = tuple([a + b for a, b in zip(x, y)] for x, y in zip(now, found))
    references = {k: v for k, v in references.items() if k is None or sum(v[0]) >= config.min_chars_in_reference}
    assert "zz" not in references and "yy" not in references and len(references) > 3
    got = {r.doc_id: r for r in quality.score_quality(docs).collect()}
    verdicts = Counter()
    for i, t, g in rows:
        r, (classes, common), pooled = got[i], _histograms(t), g not in references or g is None
        class_ref, common_ref = references[None if pooled else g]
        far = _divergence(classes, class_ref)
        if far is not None:
            assert r.class_distance == pytest.approx(far, abs=1e-6)
        near = _divergence(common, common_ref)
        if near is not None:
            assert r.common_distance == pytest.approx(near, abs=1e-6)
        odd = sum(classes) >= config.min_chars_for_classes and far > config.max_class_distance
        one, ref = ([sum(x[:-1]), x[-1]] if pooled else x for x in (common, common_ref))
        if sum(common) >= config.min_words_for_common and sum(common_ref[:-1]) >= config.min_common_in_reference * sum(common_ref):
            odd |= _divergence(one, ref) > config.max_common_share * _divergence([0] * (len(ref) - 1) + [1], ref)
        assert r.kept == (not r.base_failed and not odd), i
        verdicts[r.base_failed, r.kept] += 1
    assert len(rows) == len(got) and not got[-1].kept and min(verdicts[False, True], verdicts[True, False]) > 0


def test_js_distance():
    one, other = np.array([[1, 0]]), np.array([[0, 1]])
    assert quality.js_distance(one, other)[0] == pytest.approx(1) and quality.js_distance(one, 5 * one)[0] == 0


# ---- language identification


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    sym = rng.integers(1, 5, 300).astype(np.uint32)
    grams, counts = np.unique(np.lib.stride_tricks.sliding_window_view(sym, 3), axis=0, return_counts=True)
    m = langid.CharacterModels(["x"], grams, np.zeros(len(grams), int), counts)
    for context in ([1, 2], [4, 4], [9, 9]):
        total = sum(float(np.exp(m.log_probabilities(np.array([*context, c], np.uint32), np.array([2]))[0, 0])) for c in range(1, 5))
        unseen = float(np.exp(m.log_probabilities(np.array([*context, 77], np.uint32), np.array([2]))[0, 0]))
        assert total + unseen == pytest.approx(1, abs=1e-5)


def _streams(text):
    """Letters, with one 0 for each run of others but a leading one, behind four zeros."""
    import unicodedata

    out = [0] * 4
    for c in text:
        s = ord(c.lower()) if unicodedata.category(c)[0] in "LM" and len(c.lower()) == 1 else ord(c) if unicodedata.category(c)[0] in "LM" else 0
        if s or (len(out) > 4 and out[-1]):
            out.append(s)
    return out


def test_cross_entropies_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 1500")
    identifier = langid.train_language_identifier(docs)
    rows = docs.collect()
    fold = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5
    languages = sorted({r.lang for r in rows if r.lang and fold(r)})
    assert identifier.models.languages == languages and len(languages) > 1
    tables = {}
    for g in languages:
        top = Counter()
        for r in rows:
            if r.lang == g and fold(r) > 1:
                s = _streams(r.text)
                top.update(tuple(s[k - 4 : k + 1]) for k in range(4, len(s)))
        levels = [top]
        for _ in range(4):
            levels.append(Counter(gram[1:] for gram in levels[-1]))
        tables[g] = []
        for level in reversed(levels):
            once, twice = (sum(c == k for c in level.values()) for k in (1, 2))
            total, kinds = Counter(), Counter()
            for gram, c in level.items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            tables[g].append((level, total, kinds, once / (once + 2 * twice) if once and twice else 0.5))
    alphabet = len({gram for g in languages for gram in tables[g][0][0]})

    def probability(g, gram):
        p = 1 / (alphabet + 1)
        for k, (level, total, kinds, d) in enumerate(tables[g], 1):
            part = gram[5 - k :]
            n = total[part[:-1]]
            if n:
                p = max(level[part] - d, 0) / n + d * kinds[part[:-1]] / n * p
        return p

    got = {r.doc_id: r for r in langid.identify_languages(docs, identifier).collect()}
    tested = [r for r in rows if fold(r) == 0 and any(_streams(r.text))][:12]
    for r in tested:
        s, raw = _streams(r.text), np.frombuffer(r.text.encode(), np.uint8)
        want = [-sum(math.log(probability(g, tuple(s[k - 4 : k + 1]))) for k in range(4, len(s))) / (len(s) - 4) for g in languages]
        found, n = identifier.models.cross_entropies(raw, np.array([0, len(raw)]))
        assert n[0] == len(s) - 4 and found[0] == pytest.approx(want, abs=1e-4)
        assert got[r.doc_id].lang_pred == languages[int(np.argmin(want))]
    assert len(tested) > 5


def test_language_id(spark):
    from tests.conftest import SF

    docs = spark.read.parquet(SF + "/documents.parquet")
    found = langid.identify_languages(docs, langid.train_language_identifier(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    odd = table(spark, awkward())
    got = {r.doc_id: r for r in langid.identify_languages(odd, langid.train_language_identifier(odd)).collect()}
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and got[4].score == 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values() if r.doc_id is not None)
    assert got[12].lang_pred in ("en", "de")
    marks = table(spark, [(1, "\u0301 \u0300 12", None, None, 0), (2, "\u0301e", None, None, 0)])
    assert [r.lang_pred == "und" for r in sorted(langid.identify_languages(marks, langid.train_language_identifier(odd)).collect())] == [True, False]
    empty = table(spark, [])
    assert langid.identify_languages(empty, langid.train_language_identifier(empty)).count() == 0


def test_a_language_of_one_long_text_is_learnt_within_the_bound(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 > 1]
    rows = [(ids[0], " ".join("zxqj"[(k * k) % 4] + "wvk"[k % 3] * 2 + "jq" for k in range(30_000)), "xx", "a", 1)]
    rows += [(i, prose(900, i), "en", "a", 1) for i in ids[1:30]]
    config = langid.LanguageIdConfig(sample_chars=20_000, piece_chars=500)
    model = langid.train_language_identifier(table(spark, rows), config)
    new = table(spark, [(1000, "zwwjq xvvjq qkkjq zwwjq", None, None, 0), (1001, prose(40, 77), None, None, 0)])
    assert {r.doc_id: r.lang_pred for r in langid.identify_languages(new, model, config).collect()} == {1000: "xx", 1001: "en"}
    rate_of = langid.F.struct(langid.F.lit(20_000 / sum(len(r[1]) for r in rows[:1])).alias("count"))
    drawn = [r.text for r in langid._drawn_pieces(table(spark, rows[:1]), rate_of, config).collect()]
    assert 10_000 < len(drawn[0]) < 30_000 and all(piece in rows[0][1] for piece in drawn[0].split("\n"))


# ---- SentencePiece


def test_merges_equal_the_library():
    import random

    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    parts = ["s", "the", "re", " ", "  ", "\n", "a", "é", "1", "!", "日", "x", "😀", "in", "er", "\u0378", "ßsch"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(15))) for _ in range(500)] + [None, "", "w" * 700, "the" * 3000, "".join(r.choices("etaoinsé日", k=5000))]
    for i, ids, text in sentencepieces.encode_column(pa.array(texts, pa.string()), path, "auto"):
        assert ids.tolist() == library.encode(texts[i] or "") and text.decode() == (texts[i] or "")


def test_viterbi_is_the_best_path():
    path = tokenizer_file("piece_bpe_32k.model")
    coder = sentencepieces.coder(path, "viterbi")
    score = dict(zip(coder.table.ids.tolist(), coder.table.scores.tolist()))
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for word in ["▁thenting", "▁überall", "▁a", "▁xyzzy", "▁日x"]:
        best = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for first in range(end):
                i = library.piece_to_id(word[first:end])
                s = score.get(i, None) if i else None
                s = coder.table.unknown_score if s is None and end - first == 1 else s
                if s is not None:
                    best[end] = max(best[end], best[first] + s)
        ids, _ = coder.encode([word])
        assert sum(score.get(int(i), 0) for i in ids) == pytest.approx(best[-1] - coder.table.unknown_score * sum(library.piece_to_id(c) == 0 for c in word))


def test_sentencepiece_rows(spark):
    got = sentencepieces.encode_documents(table(spark, awkward()), tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(got) == len(awkward()) and all(r.round_trip or r.doc_id == 4 for r in got)
    assert {r.doc_id: r.n_pieces for r in got}[4] == 0
    assert sentencepieces.encode_documents(table(spark, []), tokenizer_file("piece_bpe_32k.model")).count() == 0


# ---- language-model scoring


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1 << 60), (7, 10), (900, 1 << 50), (5000, 5200)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano(EliasFano.encode(v))
        assert (e.values(np.arange(len(v))) == v).all()
        q = np.concatenate([v, rng.integers(0, top, 50, dtype=np.uint64)])
        want = {int(x): i for i, x in enumerate(v)}
        assert e.find(q).tolist() == [want.get(int(x), -1) for x in q]


def test_packed_arrays():
    rng = np.random.default_rng(0)
    arrays = [np.zeros(0, np.int64), rng.integers(0, 200, 50), rng.integers(0, 1 << 60, 7, dtype=np.uint64), np.array([0, 70_000])]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(arrays, lmscore.unpack(lmscore.pack(*arrays))))


def trained_fold(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 != 2


def lm_reference(rows, config):
    """(tokens, known, training tokens, base, score) of each row, from counts of all words, pairs and triples."""
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t, *_ in rows]
    learn = [t for t, r in zip(tokens, rows) if trained_fold(r[0])]
    c1 = Counter(w for t in learn for w in t)
    c2 = Counter(p for t in learn for p in zip(t, t[1:]))
    c3 = Counter(p for t in learn for p in zip(t, t[1:], [*t[2:], 0]))
    kinds = Counter(p[:2] for p in c3)
    total = sum(c1.values())

    def p(w, v=0, u=0):
        if v == 0:
            return (c1[w] + 1) / (total + len(c1) + 1)
        if u == 0:
            return (c2[v, w] + config.prior * p(w)) / (c1[v] + config.prior)
        if not c2[u, v]:
            return p(w, v)
        return (max(c3[u, v, w] - config.discount, 0) + config.discount * kinds[u, v] * p(w, v)) / c2[u, v]

    for t in tokens:
        base = sum(math.log10(p(w)) for w in t)
        score = sum(math.log10(p(t[k], *reversed(t[max(0, k - 2) : k]))) for k in range(len(t)))
        yield len(t), sum(c1[w] > 0 for w in t), total, base, score


@pytest.mark.parametrize("settings", [{}, {"range_rows": 300, "span_bytes": 4000, "numbered": 64}])
def test_lm_scores(spark, settings):
    config = lmscore.LmConfig(**settings)
    rows = [(1000 + i, " ".join(WORDS_OF(i)), "en", "a", 1) for i in range(120)] + awkward()
    rows += [(2000 + i, f"once {i} seen " + prose(20, i), "en", "a", 1) for i in range(20)]
    want = sorted(((i, *x) for (i, *_), x in zip(rows, lm_reference(rows, config))), key=str)
    model = lmscore.train_ngram_model(table(spark, rows), config)
    for got in (lmscore.train_and_score(table(spark, rows), config), lmscore.score_documents(table(spark, rows), model)):
        got = sorted(map(tuple, got.collect()), key=str)
        assert len(got) == len(want)
        for (i, held, n, known, total, base, score), x in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[1]))):
            assert (i, n, known, total) == x[:4] and held == (not trained_fold(i))
            assert base == pytest.approx(x[4]) and abs(score - x[5]) < 0.03 * n


def test_lm_scores_of_nothing(spark):
    empty = table(spark, [])
    assert lmscore.train_and_score(empty).count() == 0
    held = [(i, "a b", "en", "a", 1) for i in range(40) if not trained_fold(i)]
    for got in (lmscore.train_and_score(table(spark, held)), lmscore.score_documents(table(spark, held), lmscore.train_ngram_model(empty))):
        assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()] == [(3, 0, 0, 0.0, 0.0)] * len(held)


def test_texts_seen_twice_score_apart(spark):
    """Every n-gram counts, those seen once too."""
    ids = [i for i in range(400) if trained_fold(i)]
    rows = [(ids[k], prose(60, k), "en", "a", 1) for k in range(100)] + [(ids[100 + k], prose(60, k), "en", "a", 1) for k in range(20)]
    got = {r.doc_id: r.score / r.n_tokens for r in lmscore.train_and_score(table(spark, rows)).collect()}
    twice, once = [got[ids[k]] for k in range(20)], [got[ids[k]] for k in range(20, 100)]
    assert min(twice) > max(once) + 0.1


def WORDS_OF(i):
    """Word sequences with frequent pairs and triples."""
    import random

    r = random.Random(i)
    out = []
    while len(out) < 40:
        out += r.choice([["the", "old", "mill"], ["the", "new", "road"], ["a", "long", "way"], [f"rare{r.randrange(300)}"]])
    return out
