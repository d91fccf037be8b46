"""Bounded, repeatable samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize

#: Classes whose counts are sent to every task at most.
FEW_CLASSES = 10_000


def sample_per_class(rows: DataFrame, label: str, most: int, seed: int = 11) -> DataFrame:
    """At most about ``most`` rows of each class, drawn by a hash of doc_id, so that reruns draw the same.

    The classes' sizes give each class a hash threshold; nothing is sorted or gathered. A class that has at most
    ``most`` rows is taken whole; of others, up to five standard deviations over ``most`` may come.
    """
    counts = materialize(rows.groupBy(label).count().select(F.col(label).alias("_label"), "count"))
    turn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 31))
    limit = F.least(F.lit(1.0), F.lit(float(most)) / F.col("count")) * F.lit(float(1 << 31))
    few = F.broadcast(counts) if counts.count() <= FEW_CLASSES else counts
    return rows.join(few, F.col(label) == F.col("_label")).where(turn < limit).select(rows.columns)
