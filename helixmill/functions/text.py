"""String, formatting and number helpers as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import col


def first_token(s: Column | str, sep: str) -> Column:
    return F.split_part(col(s), F.lit(sep), F.lit(1))


def header_id(header: Column | str) -> Column:
    """A header up to its first blank."""
    return F.regexp_extract(col(header), r"^[>@]?(\S*)", 1)


def header_taxid_gene(header: Column | str) -> tuple[Column, Column]:
    """taxid and gene of a header `>taxid_gene`."""
    clean = header_id(header)
    return F.split_part(clean, F.lit("_"), F.lit(1)).cast("int"), F.split_part(clean, F.lit("_"), F.lit(2)).cast("int")


def basename(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"^.*/", "")


def directory(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def strip_extension(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"(?<=[^/])\.[^./]*$", "")


def remove_suffix(s: Column | str, suffix: str) -> Column:
    c = col(s)
    return F.when(F.endswith(c, F.lit(suffix)), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def has_suffix(s: Column | str, suffix: str) -> Column:
    return F.endswith(col(s), F.lit(suffix))


def trim_end(s: Column | str, letter: str) -> Column:
    """Without the given letter at the end, however often it stands there."""
    return F.rtrim(col(s), F.lit(letter))


def joined(sep: str, *of: Column | str) -> Column:
    """Values as text with a separator between them; nulls are left out."""
    return F.concat_ws(sep, *[col(c).cast("string") for c in of])


def shared_prefix(a: Column | str, b: Column | str) -> Column:
    """The longest common beginning of two strings."""
    x, y = col(a), col(b)
    n = F.least(F.length(x), F.length(y))
    same = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))), i).otherwise(acc))
    return F.substring(x, F.lit(1), same)


def pad(s: Column | str, width: int, fill: str = " ") -> Column:
    """Padded on the right, never cut."""
    c = col(s)
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, fill))


def format_milliseconds(ms: Column | str) -> Column:
    """h:mm:ss.mmm of a duration."""
    m = col(ms).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(m / 3_600_000), F.pmod(F.floor(m / 60_000), F.lit(60)), F.pmod(F.floor(m / 1000), F.lit(60)), F.pmod(m, F.lit(1000)))


def format_seconds(s: Column | str) -> Column:
    m = col(s).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(m / 3600), F.pmod(F.floor(m / 60), F.lit(60)), F.pmod(m, F.lit(60)))


def format_precision(x: Column | str, digits: int) -> Column:
    """A number with a fixed count of decimals and no separators."""
    return F.format_string(f"%.{digits}f", col(x).cast("double"))


def choose(n: Column | str, k: Column | str) -> Column:
    """n choose k as a long, exact for all that fit one; 0 where k is outside 0..n, an error where the result does not fit.

    Each factor is divided by what it has in common with the divisor before it is multiplied, so no intermediate product is
    larger than the next binomial."""
    a, b = col(n).cast("long"), col(k).cast("long")
    small = F.least(b, a - b)
    one = F.lit(1).cast("long")

    def gcd(x: Column, y: Column) -> Column:
        """Euclid's rule; 92 steps are enough for any two longs."""
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(x.alias("x"), y.alias("y")), lambda p, _: F.when(p.y == 0, p).otherwise(F.struct(p.y.alias("x"), F.pmod(p.x, F.when(p.y == 0, one).otherwise(p.y)).alias("y"))))
        return pair.x

    def step(acc: Column, i: Column) -> Column:
        factor = a - small + i
        # acc * factor / i is whole: i first loses what it shares with factor, and then divides acc
        shared = F.get(F.transform(F.array(gcd(factor, i)), lambda g: F.call_function("div", factor, g) * F.call_function("div", acc, F.call_function("div", i, g))), F.lit(0))
        return shared

    steps = F.when(small > 0, F.sequence(one, small)).otherwise(F.array().cast("array<bigint>"))
    return F.when((b < 0) | (b > a), F.lit(0).cast("long")).otherwise(F.aggregate(steps, one, step))


def bit_string(x: Column | str, width: int) -> Column:
    return F.lpad(F.bin(col(x).bitwiseAND((1 << width) - 1)), width, "0")


def is_bit_set(x: Column | str, i: int) -> Column:
    return F.bit_get(col(x), F.lit(i)) == 1


def count_bits(x: Column | str) -> Column:
    return F.bit_count(col(x))


def with_bit(x: Column | str, at: int, to: bool, width: int = 64) -> Column:
    """x with the bit `at` places from the left of a word of `width` bits set or cleared."""
    mask = F.lit(1 << (width - 1 - at) if width < 64 or at else -(1 << 63)).cast("long")
    c = col(x).cast("long")
    return c.bitwiseOR(mask) if to else c.bitwiseAND(F.bitwise_not(mask))


def first_set_bit(x: Column | str, width: int) -> Column:
    """Places from the left to the first set bit of the low `width` bits; width if none is set."""
    c = col(x).cast("long").bitwiseAND((1 << width) - 1 if width < 64 else -1)
    return F.when(c == 0, F.lit(width)).otherwise(width - F.length(F.bin(c)))


def information_content(x: Column | str, width: int) -> Column:
    """How often neighbouring bits differ within the low `width` bits (at most 63)."""
    c = col(x).cast("long")
    return F.bit_count(c.bitwiseXOR(F.shiftrightunsigned(c, 1)).bitwiseAND((1 << (width - 1)) - 1))


def swapped_bytes(x: Column | str) -> Column:
    """A long with its eight bytes in the other order."""
    c = col(x).cast("long")
    parts = [F.shiftleft(F.shiftrightunsigned(c, 8 * i).bitwiseAND(255), 56 - 8 * i) for i in range(8)]
    return functools.reduce(Column.bitwiseOR, parts)
