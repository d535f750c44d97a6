"""Quality rules by distribution divergence.

Each document gets the base counts of the rule set and two Jensen-Shannon
distances (base 2, so 0..1): its character-class histogram and its common-word
histogram against the references of its language.  The references are sums over
all documents of that language, gathered as one small histogram per language
and task.  A distance only counts when the document is long enough for it.  The bar
for common words is a share of the distance that a text without any of them has to
the reference; a reference that hardly holds such words itself judges none by them.

Defined results: a null or empty text has no words and fails the base rules; a
null ``lang``, or one whose documents hold too little text to be a reference, is
compared with the pooled reference, where the verdict goes by the number of common
words and not by which; a very long text is one histogram as any other; repeated rows
are judged alike; columns other than those named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from . import textkernels as K

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = """
the of and to in a is that for it was on be with as by this are or from at have not
der die und das den ist in von zu mit sich des auf für nicht ein eine als auch dem
le la les de des et un une en du que est pour qui dans pas sur au par plus
el los las que y se del por con una su para como es lo al no más o si
""".split()

# The symbols that the rule set counts.
SYMBOLS = "#*$%&|<>"

#: Classes of a character: lower, upper, digit, blank, counted symbol, other ASCII, letter or mark above ASCII, other above ASCII.
N_CLASSES = 8


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 10
    max_repeat_percent: int = 20
    min_chars_for_classes: int = 200
    max_class_distance: float = 0.32
    min_words_for_common: int = 100
    max_common_share: float = 0.85  # of the distance of a text without common words
    min_common_in_reference: float = 0.10  # of the reference's words
    min_chars_in_reference: int = 2_000  # of a language; with fewer, its documents are compared with the pooled one


def _class_table() -> np.ndarray:
    t = np.full(256, 7, np.uint8)
    t[:128] = 5
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    t[K.SEPARATOR] = 3
    t[[ord(c) for c in SYMBOLS]] = 4
    return t


@cache
def _above_ascii() -> np.ndarray:
    """Class of each code point above ASCII, by its Unicode category."""
    return np.fromiter((6 if category(chr(c))[0] in "LM" else 7 for c in range(0x110000)), np.uint8, 0x110000)


def character_classes(buf: np.ndarray) -> np.ndarray:
    """Class of each character of whole UTF-8 texts, at its first byte."""
    cls = _CLASS[buf]
    at = np.flatnonzero(buf >= 0xC0)
    if len(at):
        head = buf[at].astype(np.int64)
        a, b, c = (buf[np.minimum(at + i, len(buf) - 1)].astype(np.int64) & 0x3F for i in (1, 2, 3))
        two, three = (head & 0x1F) << 6 | a, (head & 0x0F) << 12 | a << 6 | b
        code = np.where(head < 0xE0, two, np.where(head < 0xF0, three, (head & 0x07) << 18 | a << 12 | b << 6 | c))
        cls[at] = _above_ascii()[code]
    return cls


_CLASS = _class_table()
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _common_table() -> tuple[np.ndarray, int]:
    words = [w.encode() for w in dict.fromkeys(COMMON_WORDS)]
    offs = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    h = K.SpanHash(np.frombuffer(b"".join(words), np.uint8))(offs[:-1], offs[1:])
    return np.sort(h), len(words)


_COMMON, N_COMMON = _common_table()


def histograms(buf, offs, words) -> tuple[np.ndarray, np.ndarray]:
    """Character-class and common-word counts of each document of a chunk."""
    starts, ends, word_offs = words
    n = len(offs) - 1
    lead = _LEAD[buf]
    classes = np.empty((n, N_CLASSES), np.int64)
    cls = character_classes(buf)
    for c in range(N_CLASSES):
        classes[:, c] = K.per_document((cls == c) & lead, offs)
    lowered = K.SpanHash(K.LOWER[buf])(starts, ends)
    at = np.minimum(np.searchsorted(_COMMON, lowered), N_COMMON - 1)
    slot = np.where(_COMMON[at] == lowered, at, N_COMMON)
    doc = np.repeat(np.arange(n), np.diff(word_offs))
    common = np.bincount(doc * (N_COMMON + 1) + slot, minlength=n * (N_COMMON + 1))
    return classes, common.reshape(n, N_COMMON + 1)


def base_counts(buf, offs, words) -> dict[str, np.ndarray]:
    """The counts of the rule set for each document of a chunk."""
    starts, ends, word_offs = words
    n = len(offs) - 1
    span = K.SpanHash(buf)
    word = ~K.SEPARATOR[buf]
    n_words = np.diff(word_offs)

    line_start, line_end, line_offs = K.split_spans(buf != 10, offs)
    has_word = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(word, out=has_word[1:])
    real = has_word[line_end] > has_word[line_start]
    line_doc = np.repeat(np.arange(n), np.diff(line_offs))[real]
    _, later = K.repeated(K.keyed(span(line_start[real], line_end[real]), line_doc))

    at, doc = K.windows_within(word_offs, 5)
    hashes = K.window_hashes(span(starts, ends), 5)
    again, _ = K.repeated(K.keyed(hashes[at], doc)) if len(at) else (np.zeros(0, bool), None)
    edge = np.zeros(len(starts) + 6, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + 5, -1)
    covered = np.cumsum(edge)[: len(starts)] > 0

    return {
        "n_words": n_words,
        "word_chars": K.per_document(word & _LEAD[buf], offs),
        "n_symbols": K.per_document(_IS_SYMBOL[buf], offs),
        "n_dup_lines": np.bincount(line_doc[later], minlength=n),
        "n_repeat_words": K.per_document(covered, word_offs),
    }


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of rows of counts to rows of reference counts."""

    def share(x):
        total = x.sum(axis=1, keepdims=True)
        return np.divide(x, total, out=np.zeros(x.shape), where=total > 0)

    def entropy(x):
        return -(x * np.log2(x, out=np.zeros(x.shape), where=x > 0)).sum(axis=1)

    p, q = share(counts), share(reference)
    return np.sqrt(np.clip(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2, 0, 1))


def odd_words(common: np.ndarray, reference: np.ndarray, pooled: np.ndarray, config: QualityConfig) -> np.ndarray:
    """Whether each row of common-word counts is beyond the bar of its reference."""

    def beyond(counts, reference):
        bare = np.zeros_like(reference)
        bare[:, -1] = 1
        return js_distance(counts, reference) > config.max_common_share * js_distance(bare, reference)

    def in_all(x):
        return np.stack([x[:, :-1].sum(axis=1), x[:, -1]], axis=1)

    told = in_all(reference)
    judges = told[:, 0] >= config.min_common_in_reference * np.maximum(told.sum(axis=1), 1)
    return judges & np.where(pooled, beyond(in_all(common), told), beyond(common, reference))


def language_references(docs: DataFrame, config: QualityConfig = QualityConfig()) -> dict[str | None, np.ndarray]:
    """Summed histograms of all documents by language, if it has text enough; key None holds the sum over all."""
    width = N_CLASSES + N_COMMON + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, np.ndarray] = {}
        for batch in batches:
            buf, offs = K.utf8_column(batch.column(1))
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = langs.dictionary.to_pylist()
            for lo, hi in K.chunks(offs):
                part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                both = np.hstack(histograms(part, at, K.split_words(part, at)))
                for c in np.unique(code[lo:hi]):
                    name = names[c] if c >= 0 else None
                    total[name] = total.get(name, 0) + both[code[lo:hi] == c].sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))],
                ["lang", "counts"],
            )

    found = docs.select(F.col("lang").cast("string"), "text").mapInArrow(sums, "lang string, counts array<bigint>")
    parts = [F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(width)]
    rows = found.groupBy("lang").agg(*parts).collect()  # one row a language
    out = {r[0]: np.array(r[1:], dtype=np.int64) for r in rows}
    pooled = sum(out.values(), np.zeros(width, np.int64))
    return {k: v for k, v in out.items() if v[:N_CLASSES].sum() >= config.min_chars_in_reference} | {None: pooled}


def verdicts(buf, offs, references: np.ndarray, pooled: np.ndarray, config: QualityConfig) -> dict[str, np.ndarray]:
    """All result columns for the documents of a chunk, given their languages' references and which are the pooled one."""
    words = K.split_words(buf, offs)
    out = base_counts(buf, offs, words)
    classes, common = histograms(buf, offs, words)
    class_d = js_distance(classes, references[:, :N_CLASSES])
    common_d = js_distance(common, references[:, N_CLASSES:])
    failed = (out["n_words"] < config.min_words) | (100 * out["n_repeat_words"] > config.max_repeat_percent * out["n_words"])
    odd = (classes.sum(axis=1) >= config.min_chars_for_classes) & (class_d > config.max_class_distance)
    odd |= (out["n_words"] >= config.min_words_for_common) & odd_words(common, references[:, N_CLASSES:], pooled, config)
    out = {k: v.astype(np.int64) for k, v in out.items()}
    return out | {"base_failed": failed, "kept": ~failed & ~odd, "class_distance": class_d, "common_distance": common_d}


def _judged(batches: Iterator[pa.RecordBatch], lang: int, text: int, by_lang: dict, config: QualityConfig):
    """(batch rows, verdicts) of the chunks of batches whose columns ``lang`` and ``text`` are given."""
    for batch in batches:
        buf, offs = K.utf8_column(batch.column(text))
        langs = batch.column(lang).to_pylist()
        for lo, hi in K.chunks(offs):
            references = np.stack([by_lang[x] if x in by_lang else by_lang[None] for x in langs[lo:hi]])
            pooled = np.array([x is None or x not in by_lang for x in langs[lo:hi]])
            yield batch.slice(lo, hi - lo), verdicts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], references, pooled, config)


def score_quality(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Rule counts, divergences and verdict for every document."""
    references = docs.sparkSession.sparkContext.broadcast(language_references(docs, config))
    schema = StructType(
        [StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [StructField(c, BooleanType()) for c in ("base_failed", "kept")]
        + [StructField(c, DoubleType()) for c in ("class_distance", "common_distance")]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _judged(batches, 1, 2, references.value, config):
            yield pa.RecordBatch.from_arrays([rows.column(0)] + [pa.array(v) for v in found.values()], schema.names)

    return docs.select("doc_id", F.col("lang").cast("string"), "text").mapInArrow(judge, schema)


def keep_good(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    references = docs.sparkSession.sparkContext.broadcast(language_references(docs, config))
    lang, text = docs.columns.index("lang"), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _judged(batches, lang, text, references.value, config):
            yield rows.filter(pa.array(found["kept"]))

    return docs.mapInArrow(keep, docs.schema)
