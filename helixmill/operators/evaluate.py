"""Scores of a classification against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and sensitivity, specificity, precision, accuracy and f1 (null where undefined)."""
    t, s = F.coalesce(truth, F.lit(False)), F.coalesce(said, F.lit(False))
    n = rows.groupBy(*(by or [])).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in (("tp", t & s), ("fp", ~t & s), ("fn", t & ~s), ("tn", ~t & ~s))])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.when(b > 0, a / b)
    return n.select(
        *(by or []), "tp", "fp", "fn", "tn", share(tp, tp + fn).alias("sensitivity"), share(tn, tn + fp).alias("specificity"),
        share(tp, tp + fp).alias("precision"), share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
