"""Scalar functions."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaves_from(n: Column, r: Column) -> Column:
    """Leaves of a binary network with n nodes, r reticulations."""
    return F.expr("null") if n is None else F.floor((n - 2 * r + 1) / 2).cast("long")


def nodes_from(r: Column, leaves: Column) -> Column:
    return (2 * r + 2 * leaves - 1).cast("long")


def reticulations_from(n: Column, leaves: Column) -> Column:
    return F.floor((n - 2 * leaves + 1) / 2).cast("long")


def integer_log(x: Column) -> Column:
    """floor(log2 x), 0 for 0, exact for all longs: the length of the binary form."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x)) - 1).cast("int")


def taxon_name(x: Column) -> Column:
    """0 a, 25 z, 26 ba, 27 bb, 676 baa: base 26 with letters."""
    digits = F.transform(F.sequence(F.lit(13), F.lit(0), F.lit(-1)), lambda k: F.floor(x / F.pow(F.lit(26.0), k)).cast("long") % 26)
    letters = F.array_join(F.transform(digits, lambda d: F.char(d + 97)), "")
    return F.coalesce(F.nullif(F.regexp_replace(letters, "^a+", ""), F.lit("")), F.lit("a"))


def count_letter(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter)))


def reverse_bits(x: Column, width: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), width, "0")), 2, 10).cast("long")


def rotate_left_32(x: Column, k: int) -> Column:
    return F.shiftleft(x, k).bitwiseOR(F.shiftright(x, 32 - k)).bitwiseAND(F.lit(0xFFFFFFFF))


def rotate_right_32(x: Column, k: int) -> Column:
    return rotate_left_32(x, (32 - k) % 32)


def scramble(x: Column) -> Column:
    """A one-to-one scramble of longs by shifts, each of which ``unscramble`` undoes."""
    x = x.bitwiseXOR(F.shiftleft(x, 21))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 35))
    return x.bitwiseXOR(F.shiftleft(x, 4))


def unscramble(x: Column) -> Column:
    def undo(y: Column, shift, k: int) -> Column:
        # x ^ (x >> k) has the inverse x ^ (x >> k) ^ (x >> 2k) ^ ...
        out = y
        for j in range(1, 64 // k + 1):
            if j * k < 64:
                out = out.bitwiseXOR(shift(y, j * k))
        return out

    x = undo(x, F.shiftleft, 4)
    x = undo(x, F.shiftrightunsigned, 35)
    return undo(x, F.shiftleft, 21)


def hash_combine(a: Column, b: Column) -> Column:
    """Digest of an ordered pair."""
    return F.xxhash64(a, b)


def linear_index(row: Column, column: Column, width: Column) -> Column:
    """Place of a cell in a table laid out row by row."""
    return row * width + column


def triangle_index(a: Column, b: Column) -> Column:
    """Place of an unordered pair of different numbers among all such pairs: (0,1), (0,2), (1,2), ..."""
    high = F.greatest(a, b)
    return (high * (high - 1) / 2).cast("long") + F.least(a, b)


def tokens(s: Column, delimiter: str) -> Column:
    """Parts of a string between single characters, empty ones left out."""
    return F.filter(F.split(s, "\\Q" + delimiter + "\\E"), lambda x: x != "")


def kth_set_bit(x: Column, k: int) -> Column:
    """Place of the k-th (from 0) set bit of a long, counted from the lowest; null if there are fewer."""
    return _kth(x, k, "1")


def kth_unset_bit(x: Column, k: int) -> Column:
    return _kth(x, k, "0")


def _kth(x: Column, k: int, digit: str) -> Column:
    bits = F.reverse(F.lpad(F.bin(x), 64, "0"))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substring(bits, i + 1, F.lit(1)) == digit)
    return F.get(places, F.lit(k))


def set_kth_unset(x: Column, k: int) -> Column:
    return x.bitwiseOR(_bit(kth_unset_bit(x, k)))


def clear_kth_set(x: Column, k: int) -> Column:
    return x.bitwiseAND(F.bitwise_not(_bit(kth_set_bit(x, k))))


def _bit(place: Column) -> Column:
    """The long with one bit set; 0 for no place."""
    return F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), place), F.lit(0).cast("long"))


def coin(key: Column, seed: int, p: float = 0.5) -> Column:
    """A toss for each key that comes out the same in every run."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) < p


def die(key: Column, seed: int, sides: int) -> Column:
    """0 to sides - 1, the same in every run."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(sides)).cast("int")


def decrease_or_remove(counts: Column, key: Column) -> Column:
    """A map of counts with one less for ``key``; a count that reaches 0 goes."""
    less = F.transform_values(counts, lambda k, v: F.when(k == key, v - 1).otherwise(v))
    return F.map_filter(less, lambda k, v: v > 0)


def pair_sum(a: Column, b: Column) -> Column:
    """Sum of two structs, field by field (x, y)."""
    return F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))


def trailing_zeros(x: Column) -> Column:
    return F.when(x == 0, 64).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.lit("0"), F.bin(x)))).cast("int")


def leading_zeros(x: Column) -> Column:
    return (64 - F.when(x == 0, 0).otherwise(F.length(F.bin(x)))).cast("int")


def draw(k: int, n: int, seed: int) -> list[int]:
    """k different numbers below n."""
    return sorted(random.Random(seed).sample(range(n), k))
