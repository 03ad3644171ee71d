"""Column expressions over DNA strings, spaced shapes and packed keys. Bases are coded A 0, C 1, G 2, T 3."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGT"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Shape:
    """A spaced shape: X takes a position, _ skips it. `take` holds the offsets of the positions taken."""

    text: str

    def __post_init__(self):
        if not self.text or set(self.text) - {"X", "_"} or "X" not in self.text:
            raise ValueError(f"a shape is a string over X and _ with at least one X, not {self.text!r}")
        if self.k > 31:
            raise ValueError("more than 31 positions do not fit a signed long")

    @property
    def take(self) -> tuple[int, ...]:
        return tuple(i for i, c in enumerate(self.text) if c == "X")

    @property
    def k(self) -> int:
        return self.text.count("X")

    def __len__(self) -> int:
        return len(self.text)

    @property
    def gaps(self) -> int:
        return self.text.count("_")

    @property
    def longest_gap(self) -> int:
        return max((len(g) for g in self.text.split("X")), default=0)

    @property
    def longest_run(self) -> int:
        return max(len(g) for g in self.text.split("_"))

    @property
    def gap_lengths(self) -> set[int]:
        return {len(g) for g in self.text.split("X") if g}

    @property
    def palindromic(self) -> bool:
        return self.text == self.text[::-1]


def letters_to_dna(text: Column | str) -> Column:
    """A stand-in for sequence data: the letters a-z of a text, mapped to ACGT cyclically."""
    return F.translate(F.regexp_replace(F.lower(col(text)), "[^a-z]+", ""), LETTERS, (BASES * 7)[:26])


def reverse_complement(s: Column | str) -> Column:
    return F.reverse(F.translate(col(s), "ACGTacgt", "TGCATGCA"))


def codes(s: Column | str) -> Column:
    """array<int> of base codes; a letter other than A, C, G, T (lower case too) is -1."""
    code = lambda c: F.when(c == "A", 0).when(c == "C", 1).when(c == "G", 2).when(c == "T", 3).otherwise(-1)
    return F.transform(F.split(col(s), ""), code)


def key_to_dna(key: Column | str, k: int) -> Column:
    """The k bases of a packed key, first base in the highest bits."""
    one = lambda i: F.substring(F.lit(BASES), (F.shiftright(col(key), 2 * (k - 1 - i)).bitwiseAND(3) + 1).cast("int"), F.lit(1))
    return F.concat(*[one(i) for i in range(k)])


def apply_shape(s: Column | str, shape: Shape) -> Column:
    """The taken letters of a string's beginning."""
    return F.concat(*[F.substring(col(s), i + 1, 1) for i in shape.take])


def expand_shape(s: Column | str, shape: Shape) -> Column:
    """A string of k letters written into the shape, with _ for gaps."""
    at, parts = 0, []
    for c in shape.text:
        at += c == "X"
        parts.append(F.substring(col(s), at, 1) if c == "X" else F.lit("_"))
    return F.concat(*parts)


def pack_value(taxid: Column | str, gene: Column | str, pos: Column | str, gene_bits: int, pos_bits: int) -> Column:
    return F.shiftleft(col(taxid).cast("long"), gene_bits + pos_bits).bitwiseOR(F.shiftleft(col(gene).cast("long"), pos_bits)).bitwiseOR(col(pos).cast("long"))


def unpack_value(value: Column | str, gene_bits: int, pos_bits: int) -> tuple[Column, Column, Column]:
    v = col(value)
    return F.shiftrightunsigned(v, gene_bits + pos_bits), F.shiftrightunsigned(v, pos_bits).bitwiseAND((1 << gene_bits) - 1), v.bitwiseAND((1 << pos_bits) - 1)


def pack_node(taxid: Column | str, gene: Column | str) -> Column:
    """A node of a read's tree as one long: the taxon in the high 32 bits, the gene (or 0) in the low ones."""
    return pack_value(taxid, gene, F.lit(0), 32, 0)


def unpack_node(node: Column | str) -> tuple[Column, Column]:
    return F.shiftrightunsigned(col(node), 32).cast("int"), col(node).bitwiseAND((1 << 32) - 1).cast("int")


def digits(s: Column | str) -> Column:
    """A digit from 0 to 3 for each of the letters A, C, G and T."""
    return F.translate(col(s), BASES, "0123")


def dna_to_bytes(s: Column | str) -> Column:
    """Four bases a byte, the first in the highest bits, as binary; a last byte with fewer bases ends in zero bits. Letters
    other than A, C, G and T give null."""
    pairs = F.when(col(s).rlike("^[ACGT]*$"), digits(s))
    filled = F.rpad(pairs, (F.ceil(F.length(pairs) / 4) * 4).cast("int"), F.lit("0"))
    byte = lambda i: F.lpad(F.conv(F.substring(filled, i * 4 + 1, F.lit(4)), 4, 16), 2, "0")
    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(filled) / 4).cast("int") - 1)), byte)
    return F.when(F.length(pairs) == 0, F.unhex(F.lit(""))).when(pairs.isNotNull(), F.unhex(F.array_join(whole, "")))


def bytes_to_dna(b: Column | str, length: Column | str) -> Column:
    """The first `length` bases of packed bytes."""
    h = F.hex(col(b))
    byte = lambda i: F.lpad(F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 4), 4, "0")
    all_ = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(h) / 2).cast("int") - 1)), byte), "")
    return F.when(F.length(h) == 0, F.lit("")).when(h.isNotNull(), F.substring(F.translate(all_, "0123", BASES), F.lit(1), col(length)))
