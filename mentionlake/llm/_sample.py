"""Bounded samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_hash(*columns, seed: int) -> F.Column:
    """A number in [0, 1) from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / F.lit(float(2**53))


def sample_by_label(rows: DataFrame, label: str, key: str, per_label: int, seed: int = 3) -> DataFrame:
    """About `per_label` rows of each label (all, if fewer), chosen by a hash of the key. One narrow
    aggregate finds the labels' counts; what returns to the driver is a number a label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).collect()
    share = None
    for r in counts:
        one = F.when(F.col(label) == r[label], min(1.0, per_label / r["n"]))
        share = one if share is None else F.coalesce(share, one)
    return rows.filter(unit_hash(key, seed=seed) < share) if share is not None else rows.limit(0)
