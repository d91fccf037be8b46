"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.shared import discard, materialize, shared_folder

__all__ = ["discard", "materialize", "shared_folder"]  # and what is defined here

#: A word, as the contracts of this subpackage define it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; null doc_ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def in_groups(sizes: list[int], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of consecutive texts of about ``most`` bytes each, a longer text alone."""
    at = 0
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and (to == at or size + sizes[to] <= most):
            size += sizes[to]
            to += 1
        yield slice(at, to)
        at = to


def word_blocks(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``most`` bytes of text each; no word is cut."""
    at = 0
    while at < len(text):
        to = at + most
        if to < len(text):
            ends = _SPACE.search(text, to)
            to = ends.start() if ends else len(text)
        yield text[at:to].split()
        at = to


def connected_components(edges: DataFrame) -> DataFrame:
    """Label each node of the undirected ``edges(a, b)`` with the smallest node it reaches.

    Returns (node, component) for every node of an edge; an empty edge table gives an empty result. Null ends and
    loops are passed over. Rounds of large-star and small-star contraction, each written to the shared folder, until
    the edges stop changing; a node with very many edges is only ever grouped by an aggregate and joined, so neither a
    task nor the driver gathers its neighbours.
    """

    def mark(e: DataFrame):
        h = F.xxhash64("a", "b")
        return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(h % 1_000_003)).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        joined = near.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            out = out.unionByName(low.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    now = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    seen = mark(now)
    while seen[0]:
        after = materialize(star(star(now, True), False))
        was, seen = seen, mark(after)
        discard(now)
        now = after
        if was == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
