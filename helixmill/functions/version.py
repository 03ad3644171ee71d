"""Version numbers: up to four parts, compared part by part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import col

PARTS = 4


def parse(text: str) -> tuple[int, int, int, int]:
    """The parts of "1.2.3.4", missing ones as 0; all 0 where the text is no version."""
    parts = text.split(".")
    if len(parts) > PARTS or not all(p.isascii() and p.isdigit() for p in parts):
        return (0, 0, 0, 0)
    return tuple([*map(int, parts), 0, 0, 0, 0][:PARTS])


def version(text: Column | str) -> Column:
    """As parse(), a struct that compares as versions do; null for null."""
    c = col(text)
    good = c.rlike(r"^[0-9]+(\.[0-9]+){0,3}$")
    part = lambda i: F.when(good, F.coalesce(F.get(F.split(c, r"\."), F.lit(i)).try_cast("int"), F.lit(0))).otherwise(0)
    return F.when(c.isNotNull(), F.struct(*[part(i).alias(n) for i, n in enumerate(("major", "minor", "patch", "tweak"))]))
