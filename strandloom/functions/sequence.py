"""Sequence algebra as column expressions.

Bases are kept as digits in key order, A < C < T < G, so that string order is key
order at every length.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BASES, DIGITS = "ACTG", "0123"

#: Digits 0..7 of all ASCII characters in compat mode: bits 1 to 3 of the character.
_ASCII = "".join(map(chr, range(1, 128)))
_CODES = "".join(str((c >> 1) & 7) for c in range(1, 128))

HASH_A, HASH_B = 68111, 105929


def encode(seq: Column) -> Column:
    """Bases to digits; case is ignored, U counts as T, anything else becomes a dot."""
    return F.regexp_replace(F.translate(seq, "acgtuACGTU", "0132201322"), "[^0-3]", ".")


def decode(digits: Column) -> Column:
    return F.translate(digits, DIGITS, BASES)


def compat_codes(seq: Column) -> Column:
    """Digits 0..7: two bits of the base itself, and 4 where it spills into the base before it."""
    return F.translate(F.regexp_replace(seq, r"[^\x01-\x7F]", "\x01"), _ASCII, _CODES)


#: Window starts in one piece of a long sequence.
PIECE = 4096


def pieces(codes: Column, n: int, size: int = PIECE) -> Column:
    """Pieces of at most ``size`` window starts that overlap by ``n`` - 1, so that each window is whole in one piece."""
    cut = F.regexp_extract_all(codes, F.lit(f"(?=(.{{1,{size + n - 1}}})).{{1,{size}}}"), F.lit(1))
    return F.when(F.length(codes) <= size, F.array(codes)).otherwise(cut)


def windows(digits: Column, n: int) -> Column:
    """All windows of ``n`` digits, as an array; those with anything else in them are left out.

    One pass that looks ahead at each place, so its cost is linear in the sequence.
    """
    return F.regexp_extract_all(digits, F.lit(f"(?=([0-3]{{{n}}}))"), F.lit(1))


def compat_windows(codes: Column, n: int) -> Column:
    """Windows where a base that spills sets the low bit of the base before it in the same window."""
    spilled = codes
    for even in "0246":
        spilled = F.regexp_replace(spilled, f"{even}(?=[4-7])", str(int(even) + 1))
    spilled, own = (F.translate(c, "4567", DIGITS) for c in (spilled, codes))
    body = F.regexp_extract_all(spilled, F.lit(f"(?=(.{{{n - 1}}}).)"), F.lit(1))
    end = F.regexp_extract_all(own, F.lit(f"(?=.{{{n - 1}}}(.))"), F.lit(1))
    return F.zip_with(body, end, lambda a, b: F.concat(a, b))


def first(seq: Column, n: Column | int) -> Column:
    return F.left(seq, n if isinstance(n, Column) else F.lit(n))


def last(seq: Column, n: Column | int) -> Column:
    return F.right(seq, n if isinstance(n, Column) else F.lit(n))


def visits(count: Column, coverage: int) -> Column:
    """Times that a walk may use a k-mer seen ``count`` times."""
    return F.ceil(count / F.lit(coverage)).cast("int")


def before(node: Column, seq: Column, size: int) -> tuple[Column, Column]:
    """Neighbour through a prefix, and the neighbour's suffix that points back."""
    whole = F.concat(seq, node)
    return first(whole, size), last(whole, F.length(seq))


def after(node: Column, seq: Column, size: int) -> tuple[Column, Column]:
    """Neighbour through a suffix, and the neighbour's prefix that points back."""
    whole = F.concat(node, seq)
    return last(whole, size), first(whole, F.length(seq))


def number(digits: Column) -> Column:
    """Value of a short digit string in base four."""
    return F.conv(digits, 4, 10).cast("long")


def hash31(x: Column) -> Column:
    """Hash of a non-negative number below 4**15 to 31 bits."""
    t = F.lit(HASH_A) * x + F.lit(HASH_B)
    return (F.shiftright(t, 31) + t).bitwiseAND(F.lit((1 << 31) - 1))
