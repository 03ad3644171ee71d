"""Hashed word features of whole texts, shared by the operators that weigh words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec

_SECOND = np.uint64(0xA0761D6478BD642F)


def ngrams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, textvec.Words]:
    """Buckets (of 2 ** bits) of each word and each pair of neighbouring words, and the row of each."""
    w = textvec.words(column)
    same = w.doc[1:] == w.doc[:-1]
    pairs = textvec.mix(w.hashes[:-1] * _SECOND + w.hashes[1:])[same]
    hashes = np.concatenate([w.hashes, pairs])
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([w.doc, w.doc[1:][same]]), w


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """About `most` labelled rows at most (key, text and label columns), drawn by a hash of the key: with n labels a row is
    drawn with probability most / n. Rows whose label columns are null are not drawn; repeated labels of a key count once."""
    good = labels.select(F.col(key).alias("label_key"), *columns).dropna().dropDuplicates(["label_key"])
    n = good.count()
    chance = min(1.0, most / max(n, 1))
    good = good.filter(hash_unit(F.col("label_key")) < chance)
    return docs.select(F.col(key).alias("label_key"), F.col(text).alias("text")).join(F.broadcast(good), "label_key")


def hash_unit(*of: Column) -> Column:
    """A number in [0, 1) from a hash of columns."""
    return F.pmod(F.xxhash64(*of, F.lit(20260102)), F.lit(1 << 40)) / float(1 << 40)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
