"""Fill-in-the-middle forms of texts, cut at tokens by succinct rank and select.

A text's tokens are blanks with the word that they lead to, and blanks at its end.
Where tokens end is a bit a byte, packed, with a directory of set bits before each block
of 512 and each word of 64.  The directory's total in a text is its number of tokens, and
a cut after ``c`` tokens is the place of the text's ``c``-th set bit.

Defined results: a null text counts as empty; an empty text, and one that holds a mark,
stays plain; a null doc_id counts as an empty string where it is hashed; equal rows give
equal rows; very long texts are cut whole, a chunk of documents at a time; other columns
are kept, whatever their names (those of ``FORM`` come last); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import textkernels as K
from .storage import fresh_names

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORM = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class MiddleConfig:
    """``changed`` and ``suffix_first`` are percentages: texts that are cut, and those of them with the suffix first."""

    seed: int = 42
    changed: int = 50
    suffix_first: int = 80


#: Place of the j-th set bit of each byte.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _set = [j for j in range(8) if _byte >> j & 1]
    _IN_BYTE[_byte, : len(_set)] = _set


class RankSelect:
    """A packed bitvector with a directory of the set bits before each block and word."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        blocks = len(flags) // 512 + 1
        padded = np.zeros(blocks * 64, np.uint8)
        padded[: len(packed)] = packed
        self.bytes = padded
        self.words = padded.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64).reshape(blocks, 8)
        self.in_block = np.zeros((blocks, 8), np.int64)
        np.cumsum(ones[:, :-1], axis=1, out=self.in_block[:, 1:])
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(ones.sum(axis=1), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[at >> 9] + self.in_block.ravel()[word] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Places of the set bits with the given numbers, from 0."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        word = (self.in_block[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.in_block[block, word]
        word += 8 * block
        byte = self.bytes.reshape(-1, 8)[word]
        upto = np.cumsum(np.bitwise_count(byte), axis=1, dtype=np.int64)
        which = (upto <= left[:, None]).sum(axis=1)
        row = np.arange(len(k))
        left = left - (upto[row, which] - np.bitwise_count(byte[row, which]))
        return 64 * word + 8 * which + _IN_BYTE[byte[row, which], left]


def token_ends(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Flags of the bytes at which a token ends."""
    blank = K.SEPARATOR[buf]
    ends = np.zeros(len(buf), bool)
    ends[:-1] = ~blank[:-1] & blank[1:]
    ends[offs[1:][np.diff(offs) > 0] - 1] = True
    return ends


def _dice(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, config: MiddleConfig = MiddleConfig()) -> DataFrame:
    """The documents with their number of tokens, form, cut sizes in characters, and output."""
    new = fresh_names(docs, *FORM)
    kinds = [LongType(), StringType(), LongType(), LongType(), StringType()]
    schema = StructType(docs.schema.fields + [StructField(c, k) for c, k in zip(new, kinds)])
    dice = fresh_names(docs, "h1", "h2", "h3", "h4")
    rows = docs.select("*", *[h.alias(c) for h, c in zip(_dice(F.col("doc_id"), config.seed), dice)])
    text_at, width = docs.columns.index("text"), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offsets = K.utf8_column(batch.column(text_at))
            for lo, hi in K.chunks(offsets):
                part = batch.slice(lo, hi - lo)
                buf, offs = whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *_formed(part, text_at, width, buf, offs, config)], schema.names)

    return rows.mapInArrow(cut, schema)


def _formed(part: pa.RecordBatch, text_at: int, width: int, buf: np.ndarray, offs: np.ndarray, config: MiddleConfig) -> list[pa.Array]:
    bits = RankSelect(token_ends(buf, offs))
    rank = bits.rank(offs)
    n = np.diff(rank)
    h1, h2, h3, h4 = (part.column(width + j).to_numpy() for j in range(4))
    texts = part.column(text_at)
    marked = np.zeros(len(n), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h3 % 100 >= config.changed)
    spm = ~plain & (h4 % 100 < config.suffix_first)
    a, b = h1 % (n + 1), h2 % (n + 1)
    starts = np.cumsum(np.r_[0, (buf & 0xC0) != 0x80])  # characters before each byte
    cuts = []
    for c in (np.minimum(a, b), np.maximum(a, b)):
        some = np.flatnonzero(~plain & (c > 0))
        place = offs[:-1].copy()
        place[some] = bits.select(rank[some] + c[some] - 1) + 1
        cuts.append(place)
    prefix_chars, middle_chars = starts[cuts[0]] - starts[offs[:-1]], starts[cuts[1]] - starts[cuts[0]]
    data, out = buf.tobytes(), []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for x, i, j, y, is_plain, is_spm in zip(*(v.tolist() for v in (offs[:-1], *cuts, offs[1:], plain, spm))):
        if is_plain:
            out.append(data[x:y])
        elif is_spm:
            out.append(b"".join((s, data[j:y], p, data[x:i], m, data[i:j])))
        else:
            out.append(b"".join((p, data[x:i], s, data[j:y], m, data[i:j])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return [
        pa.array(n, pa.int64()),
        pa.array(form.tolist(), pa.string()),
        pa.array(prefix_chars, pa.int64(), mask=plain),
        pa.array(middle_chars, pa.int64(), mask=plain),
        pa.array(out, pa.binary()).cast(pa.string()),
    ]


def restored(output: Column, form: Column) -> Column:
    """The text behind an output; marks cannot occur in a text that was cut, so the first of each is the one set."""
    rest = F.substr(output, F.lit(4))
    second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    one = F.left(rest, F.position(second, rest) - 1)
    rest = F.substr(rest, F.length(one) + 4)
    two = F.left(rest, F.position(F.lit(MIDDLE), rest) - 1)
    middle = F.substr(rest, F.length(two) + 4)
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def middle_report(docs: DataFrame, config: MiddleConfig = MiddleConfig()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    out = fill_in_middle(docs.select("doc_id", "text"), config)
    digest = lambda c: F.sha2(c, 256)
    return out.select(
        "doc_id", *FORM[:4], digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


MIDDLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
d AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
c AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c"""
