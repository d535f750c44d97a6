"""Language identification with interpolated Kneser-Ney character models.

One model a language, learnt from a bounded sample of labelled documents and kept
in sorted hash arrays: for each order a sorted array of n-gram hashes with one row
of log probabilities (a column a language), and one of context hashes with the
back-off weights.  A text takes the language of lowest cross-entropy per symbol.
A logistic curve of the margin, fitted on labelled documents that the counts did
not see, gives the score; a text is marked ``rejected`` when the score is below
one half or its cross-entropy lies beyond what the language's own texts reach.

Symbols are lower-cased letters and marks; everything else is a word boundary.

Defined results: a null text, or one without letters, is ``und`` with score 0;
languages come from non-null ``lang`` of learning documents; if there are none,
every text is ``und``; repeated rows get equal results; other columns are ignored;
very long texts are predicted whole and learnt from by drawn pieces, as others are;
an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from . import textkernels as K

_cache: dict = {}
_STEP = np.uint64(0xD1342543DE82EF95)


@dataclass(frozen=True)
class LanguageIdConfig:
    order: int = 5
    #: Bound of the learning sample, in characters a language, in expectation.
    sample_chars: int = 1_500_000
    #: Length of the pieces of texts that are drawn.
    piece_chars: int = 2_000
    folds: int = 5
    max_calibration_docs: int = 4_000


def symbol_table() -> np.ndarray:
    """Code point to symbol: lower-cased letter or mark, else 0."""
    if "symbols" not in _cache:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] in "LM":
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 else c
        _cache["symbols"] = t
    return _cache["symbols"]


def with_letters(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each document has a letter; marks alone are none."""
    if "letters" not in _cache:
        _cache["letters"] = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
    codes = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return K.per_document(_cache["letters"][codes], lead[offs]) > 0


def symbols(buf: np.ndarray, offs: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of documents laid end to end, each behind ``pad`` zeros; runs of zeros are one."""
    codes = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    at = lead[offs]
    sym = symbol_table()[codes]
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    starts = at[:-1][np.diff(at) > 0]
    keep[starts] = sym[starts] != 0
    counts = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=counts[1:])
    inner = counts[at]
    n = len(offs) - 1
    out = np.zeros(inner[-1] + pad * n, np.uint32)
    doc = np.repeat(np.arange(1, n + 1), np.diff(inner))
    out[np.arange(inner[-1]) + pad * doc] = sym[keep]
    return out, inner + pad * np.arange(n + 1)


def mixed(sym: np.ndarray) -> np.ndarray:
    return K.mix(sym.astype(np.uint64) + np.uint64(0x51ED27))


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams from the mixed symbols in ``columns``, first symbol first."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h *= _STEP
        h += c
    return K.mix(h)


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    return folded([mixed(c) for c in columns])


class SortedHashes:
    """Position of 64-bit hashes in a sorted array, by leading bits and short scans."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(keys, edges).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        at = self.first[wanted >> np.uint64(64 - self.bits)]
        todo = np.arange(len(wanted))
        last = len(self.keys)
        while len(todo):
            inside = at < last
            todo, at = todo[inside], at[inside]
            key = self.keys[at]
            hit = key == wanted[todo]
            out[todo[hit]] = at[hit]
            on = key < wanted[todo]
            todo, at = todo[on], at[on] + 1
        return out


@dataclass
class Level:
    grams: SortedHashes
    logp: np.ndarray  # (n-grams, languages)
    contexts: SortedHashes
    backoff: np.ndarray  # (contexts, languages), log


class CharacterModels:
    """Interpolated Kneser-Ney models of several languages with shared n-gram tables."""

    def __init__(self, languages: list[str], grams: np.ndarray, lang: np.ndarray, counts: np.ndarray):
        """``grams``: (n, order) distinct n-grams by language; ``lang``, ``counts``: of each row."""
        self.languages, self.order = languages, grams.shape[1]
        n_lang = len(languages)
        types = [(grams[lang == i], counts[lang == i].astype(np.float64)) for i in range(n_lang)]
        tables = [types]
        for _ in range(self.order - 1):  # continuation counts: distinct longer types
            lower = []
            for g, _c in tables[-1]:
                u, c = np.unique(g[:, 1:], axis=0, return_counts=True) if len(g) else (g[:, 1:], np.zeros(0))
                lower.append((u, c.astype(np.float64)))
            tables.append(lower)
        tables.reverse()
        self.alphabet = len(np.unique(np.concatenate([g[:, 0] for g, _ in tables[0]])))
        self.levels: list[Level] = []
        self.unseen = np.zeros(n_lang)
        for k, level in enumerate(tables, 1):
            self._add_level(k, level, n_lang)

    def _add_level(self, k: int, level, n_lang: int) -> None:
        union = np.unique(np.concatenate([g for g, _ in level]), axis=0)
        columns = [union[:, j] for j in range(k)]
        hashes = gram_hash(columns)
        order = np.argsort(hashes)
        union, grams = union[order], SortedHashes(hashes[order])
        context_hash = gram_hash(list(union[:, :-1].T)) if k > 1 else np.zeros(len(union), np.uint64)
        context_keys, context_of = np.unique(context_hash, return_inverse=True)
        discounted = np.zeros((len(union), n_lang))
        backoff = np.ones((len(context_keys), n_lang))
        for i, (g, c) in enumerate(level):
            if not len(g):
                continue
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            row = grams.find(gram_hash([g[:, j] for j in range(k)]))
            context = context_of[row]
            total = np.bincount(context, c, len(context_keys))
            kinds = np.bincount(context, minlength=len(context_keys))
            seen = total > 0
            backoff[seen, i] = d * kinds[seen] / total[seen]
            discounted[row, i] = np.maximum(c - d, 0) / total[context]
        if k == 1:
            lower = np.full((len(union), n_lang), 1 / (self.alphabet + 1))
            self.unseen = np.log(backoff[0] / (self.alphabet + 1))
        else:
            below = self.levels[-1]
            lower = np.exp(below.logp[below.grams.find(gram_hash(list(union[:, 1:].T)))])
        p = discounted + backoff[context_of] * lower
        self.levels.append(Level(grams, np.log(p).astype(np.float32), SortedHashes(context_keys), np.log(backoff).astype(np.float32)))

    def log_probabilities(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(len(at), languages): log probability of the symbol at each index after its context."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        todo, sym = np.arange(len(at)), mixed(sym)
        for k in range(self.order, 0, -1):
            level, pos = self.levels[k - 1], at[todo]
            row = level.grams.find(folded([sym[pos - j] for j in range(k - 1, -1, -1)]))
            hit = row >= 0
            out[todo[hit]] += level.logp[row[hit]]
            todo, pos = todo[~hit], pos[~hit]
            if not len(todo):
                break
            if k == 1:
                out[todo] += self.unseen
            else:
                context = level.contexts.find(folded([sym[pos - j] for j in range(k - 1, 0, -1)]))
                known = context >= 0
                out[todo[known]] += level.backoff[context[known]]
        return out

    def cross_entropies(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol by document and language, and the number of symbols."""
        pad = self.order - 1
        sym, at = symbols(buf, offs, pad)
        n = np.diff(at) - pad
        doc = np.repeat(np.arange(len(n)), n)
        where = np.arange(len(doc)) + pad * (doc + 1)
        logp = self.log_probabilities(sym, where)
        bounds = np.concatenate(([0], np.cumsum(n)))
        sums = np.zeros((len(logp) + 1, logp.shape[1]))
        np.cumsum(logp, axis=0, out=sums[1:])
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        return -total / np.maximum(n, 1)[:, None], n


@dataclass
class LanguageIdentifier:
    models: CharacterModels | None
    slope: float = 1.0
    shift: float = 0.0
    limits: np.ndarray | None = None

    def margins(self, entropies: np.ndarray, n: np.ndarray) -> np.ndarray:
        if entropies.shape[1] < 2:
            return np.sqrt(n)
        low = np.partition(entropies, 1, axis=1)
        return (low[:, 1] - low[:, 0]) * np.sqrt(n)

    def calibrate(self, entropies: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Fit the score on documents outside the counts, and the limits of cross-entropy."""
        best = entropies.argmin(axis=1)
        right = (best == truth).astype(float)
        x = np.stack([self.margins(entropies, n), np.ones(len(n))], axis=1)
        w = np.array([1.0, 0.0])
        prior = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (p - right) + 0.1 * (w - prior)
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
            w = w - np.linalg.solve(hessian, gradient)
        if w[0] > 0:
            self.slope, self.shift = w
        self.limits = np.full(entropies.shape[1], np.inf)
        for i in range(entropies.shape[1]):
            own = entropies[(truth == i) & (best == i) & (n >= 20), i]
            if len(own) >= 20:
                self.limits[i] = own.mean() + 6 * own.std()

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        n_docs = len(offs) - 1
        if self.models is None:
            return ["und"] * n_docs, np.zeros(n_docs), np.ones(n_docs, bool), np.zeros(n_docs)
        entropies, n = self.models.cross_entropies(buf, offs)
        best = entropies.argmin(axis=1)
        score = 1 / (1 + np.exp(-np.clip(self.slope * self.margins(entropies, n) + self.shift, -30, 30)))
        own = entropies[np.arange(n_docs), best]
        beyond = (n >= 20) & (own > self.limits[best]) if self.limits is not None else np.zeros(n_docs, bool)
        score = np.where(beyond, np.minimum(score, 0.49), score)
        empty = ~with_letters(buf, offs)
        names = ["und" if e else self.models.languages[b] for e, b in zip(empty, best)]
        return names, np.where(empty, 0.0, score), empty | (score < 0.5), np.where(empty, 0.0, own)


def _fold(config: LanguageIdConfig):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(config.folds))


def _drawn_pieces(docs: DataFrame, rate_of: Column, config: LanguageIdConfig) -> DataFrame:
    """(lang, text): the pieces of each text that its language's rate draws, a line each; at rate 1 whole texts."""
    size = F.lit(config.piece_chars)
    n = F.greatest(F.ceil(F.length("text") / size), F.lit(1)).cast("int")
    share = F.floor(rate_of["count"] * (1 << 20))
    drawn = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(F.xxhash64(F.col("doc_id"), i), F.lit(1 << 20)) < share)
    pieces = F.transform(drawn, lambda i: F.col("text").substr(i * size + 1, size))
    text = F.when(rate_of["count"] < 1, F.array_join(pieces, "\n")).otherwise(F.col("text"))
    return docs.select("lang", text.alias("text")).where("text <> ''")


def train_language_identifier(docs: DataFrame, config: LanguageIdConfig = LanguageIdConfig()) -> LanguageIdentifier:
    """Learn from labelled documents outside fold 0; fold 1 calibrates, the rest is counted."""
    spark = docs.sparkSession
    labelled = docs.select("doc_id", F.col("lang").cast("string"), "text", _fold(config).alias("fold"))
    labelled = labelled.where("fold > 0 AND lang IS NOT NULL AND text IS NOT NULL")
    totals = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in totals)
    if not languages:
        return LanguageIdentifier(None)
    # What is counted is drawn by pieces, so that a language of few very long texts has its share; whole texts calibrate.
    rate = {r["lang"]: min(1.0, config.sample_chars / max(1, r["chars"])) for r in totals}
    tuned = {r["lang"]: min(1.0, config.max_calibration_docs / max(1, r["n"])) for r in totals}
    rates = F.create_map(*[x for k in languages for x in (F.lit(k), F.struct(F.lit(rate[k]).alias("count"), F.lit(tuned[k]).alias("tune")))])
    rate_of, draw = rates[F.col("lang")], F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    calibrating = labelled.where("fold = 1").where(draw < F.least(rate_of["tune"], rate_of["count"]))
    order, index = config.order, {k: i for i, k in enumerate(languages)}
    names = [f"s{j}" for j in range(order)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([index[x] for x in batch.column(0).to_pylist()], np.int32)
            buf, offs = K.utf8_column(batch.column(1))
            for lo, hi in K.chunks(offs):
                sym, at = symbols(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], order - 1)
                n = np.diff(at) - (order - 1)
                doc = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(doc)) + (order - 1) * (doc + 1)
                columns = [sym[pos - j] for j in range(order - 1, -1, -1)]
                lang = code[lo:hi][doc]
                key = K.mix(gram_hash(columns) ^ K.mix(lang.astype(np.uint64)))
                _, pick, counts = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang[pick])] + [pa.array(c[pick].astype(np.int32)) for c in columns] + [pa.array(counts.astype(np.int64))],
                    ["lang", *names, "n"],
                )

    # Fold 1 is counted too where it is all there is.
    counted = labelled.where("fold <> 1") if labelled.where("fold <> 1").take(1) else labelled
    rows = _drawn_pieces(counted, rate_of, config).mapInArrow(count, "lang int, " + ", ".join(f"{c} int" for c in names) + ", n long")
    table = rows.groupBy("lang", *names).agg(F.sum("n").alias("n")).toArrow()
    if not table.num_rows:
        return LanguageIdentifier(None)
    # In a fixed order, so that sums of floating-point numbers agree between runs.
    table = table.sort_by([(c, "ascending") for c in ("lang", *names)])
    grams = np.stack([table[c].to_numpy().astype(np.uint32) for c in names], axis=1)
    out = LanguageIdentifier(CharacterModels(languages, grams, table["lang"].to_numpy(), table["n"].to_numpy()))

    shared = spark.sparkContext.broadcast(out.models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            buf, offs = K.utf8_column(batch.column(1))
            for lo, hi in K.chunks(offs):
                e, n = shared.value.cross_entropies(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([pa.array(code[lo:hi]), pa.array(n), pa.array(e.tolist(), pa.list_(pa.float64()))], ["lang", "n", "e"])

    held = calibrating.select("lang", "text").mapInArrow(measure, "lang long, n long, e array<double>")
    held = sorted(held.where("n > 0").collect())
    if held:
        out.calibrate(np.array([r["e"] for r in held]), np.array([r["n"] for r in held]), np.array([r["lang"] for r in held]))
    return out


def identify_languages(docs: DataFrame, identifier: LanguageIdentifier, config: LanguageIdConfig = LanguageIdConfig()) -> DataFrame:
    """Predicted language, score, rejection and cross-entropy of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.utf8_column(batch.column(2))
            for lo, hi in K.chunks(offs):
                names, score, rejected, entropy = shared.value.predict(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score), pa.array(rejected), pa.array(entropy)],
                    schema.names,
                )

    schema = StructType(
        [
            StructField("doc_id", docs.schema["doc_id"].dataType),
            StructField("held_out", BooleanType()),
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
            StructField("rejected", BooleanType()),
            StructField("cross_entropy", DoubleType()),
        ]
    )
    return docs.select("doc_id", (_fold(config) == 0).alias("held_out"), "text").mapInArrow(predict, schema)
