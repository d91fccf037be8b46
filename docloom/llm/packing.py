"""Packing by length buckets whose boundaries minimise padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, read, text_or_empty
from docloom.llm.mixing import word_count

BUCKETS, TOKEN_BUDGET = 12, 32_768
ROWS_A_PART = 50_000


def best_boundaries(lengths: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` ranges of the sorted, distinct ``lengths`` that make the least padding, by dynamic programming.

    Each row is padded to its range's upper end. Ties go to the fewer and then to the lower boundaries. A range from i to j
    costs length[j] * rows - words in it, so for each j the best i is the lowest of lines with falling slopes at a rising
    point; their lower hull makes a layer linear in the number of lengths. All figures are whole numbers.
    """
    n = len(lengths)
    if not n:
        return []
    at, before, words = lengths.tolist(), [0, *np.cumsum(rows).tolist()], [0]
    for x, k in zip(at, rows.tolist(), strict=True):
        words.append(words[-1] + x * k)
    cost: list = [0] + [None] * n  # None: not reached in so many ranges
    picks, best = [], None
    for k in range(min(buckets, n)):
        after, pick = [None] * (n + 1), np.zeros(n + 1, np.int32)
        hull: list[tuple[int, int, int]] = []  # (slope, height, i)
        top = 0
        for j in range(1, n + 1):
            if cost[j - 1] is not None:
                m, c = -before[j - 1], cost[j - 1] + words[j - 1]
                while len(hull) - top > 1:
                    (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                    if (c - c1) * (m1 - m2) > (c2 - c1) * (m1 - m):
                        break
                    hull.pop()
                hull.append((m, c, j - 1))
            if len(hull) == top:
                continue
            x = at[j - 1]
            while top + 1 < len(hull) and hull[top + 1][0] * x + hull[top + 1][1] < hull[top][0] * x + hull[top][1]:
                top += 1
            m, c, i = hull[top]
            after[j], pick[j] = m * x + c + x * before[j] - words[j], i
        picks.append(pick)
        if best is None or after[n] < best[0]:
            best = (after[n], k)
        cost = after
    ends, j = [], n
    for k in range(best[1], -1, -1):
        ends.append(at[j - 1])
        j = int(picks[k][j])
    return ends[::-1]


def pack(docs: DataFrame, size: Column, budget: int = TOKEN_BUDGET, buckets: int = BUCKETS, seed: int = 13) -> DataFrame:
    """doc_id, size, bucket_length, batch_id, slot of each row of ``docs``.

    One aggregate makes the histogram of exact lengths, of which there can be no more than the square root of twice all
    words; dynamic programming over it chooses the boundaries, all of them lengths that occur. In a bucket, rows follow a
    seeded order, and each batch takes as many as fit the token budget at the bucket's length; a row longer than the budget
    makes a batch of its own. The order is cut into parts by a hash, so a bucket with most of the rows is numbered part by
    part. Rows without words go to the first bucket's batches. Rows that repeat a doc_id each take a slot; null text has
    size 0; further columns are ignored; an empty table gives no rows.
    """
    sized = materialize(docs.select("doc_id", F.coalesce(size, F.lit(0)).cast("long").alias("size")))
    found = sized.groupBy("size").count().toArrow()
    order = np.argsort(lengths := found["size"].to_numpy().astype(np.int64))
    lengths, counts = lengths[order], found["count"].to_numpy().astype(np.int64)[order]
    ends = best_boundaries(lengths, counts, buckets)
    inside = np.bincount(np.searchsorted(ends, lengths), counts, minlength=len(ends)) if ends else []
    first_fit = lambda values: F.coalesce(*[F.when(F.col("size") <= e, F.lit(v)) for e, v in zip(ends, values, strict=True)], F.lit(1)).cast("long")
    bucket, parts_of = first_fit(ends), first_fit([max(1, int(n) // ROWS_A_PART) for n in inside])
    turn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)
    dealt = sized.withColumns({
        "bucket_length": bucket,
        "rows_a_batch": F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), bucket))).cast("long"),
        "turn": turn,
        "part": F.floor(F.shiftright(turn, 32) * parts_of / F.lit(1 << 31)).cast("long"),
    })
    counts = dealt.groupBy("bucket_length", "part").count()
    before = counts.select("bucket_length", "part", (F.sum("count").over(Window.partitionBy("bucket_length").orderBy("part")) - F.col("count")).alias("before"))
    number = F.row_number().over(Window.partitionBy("bucket_length", "part").orderBy("turn", "doc_id", "size")) - 1
    return (
        dealt.withColumn("number", number)
        .join(before, ["bucket_length", "part"])
        .withColumn("number", F.col("number") + F.col("before"))
        .select(
            "doc_id",
            "size",
            "bucket_length",
            F.concat_ws("-", "bucket_length", F.floor(F.col("number") / F.col("rows_a_batch")).cast("long")).alias("batch_id"),
            (F.col("number") % F.col("rows_a_batch")).cast("long").alias("slot"),
        )
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    """``pack`` by the words of ``docs(doc_id, text)``; a null text has none."""
    return pack(docs, word_count(text_or_empty()))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
