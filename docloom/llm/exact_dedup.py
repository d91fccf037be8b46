"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, materialize, read, text_or_empty

#: A chunk ends at the first word end after a vowel or full stop past 512 characters, and at 4096 at the latest.
CHUNK = r"(?s).{512,4096}?[aeiou.] |.{1,4096}"


def chunked(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text: normalised, chunks, recipe: the chunks' hashes in order) of each row of ``docs``."""
    text = F.regexp_replace(text_or_empty(), SPACE, " ")
    return (
        docs.select("doc_id", text.alias("text"))
        .withColumn("chunks", F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)))
        .withColumn("recipe", F.transform("chunks", lambda c: chunk_hash(c)))
    )


def exact_groups(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Each text is cut into content-defined chunks. A chunk's hash is its identifier once verified: every chunk goes
    through one shuffle, combined on the map side, that compares the content behind equal hashes. Chunks whose hash
    stands for more than one content (as good as never) get an identifier from their content instead. Texts are then
    compared by their ordered identifier lists alone, so no long text moves again.

    Null text counts as empty. A null doc_id never represents a group that has another. Rows that repeat a doc_id and
    its text are one document: all are marked kept, and ``drop_exact_duplicates`` returns one of them. Further columns
    are ignored.
    """
    cut = chunked(docs, chunk_hash)
    pieces = cut.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("p")).select("p.recipe", "p.chunks")
    doubtful = (
        pieces.groupBy(F.col("recipe").alias("hash"))
        .agg(F.min("chunks").alias("low"), F.max("chunks").alias("high"))
        .where("low <> high")
        .select("hash")
    )
    bare = materialize(cut.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "recipe"))
    if not doubtful.isEmpty():
        bare = _disambiguated(cut, doubtful)
    groups = bare.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return bare.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _disambiguated(cut: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Recipes in which the chunks of doubtful hashes are named by their content."""
    rows = cut.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "recipe", "chunks")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("row", "doc_id", "text_sha256", F.posexplode_outer(F.arrays_zip("recipe", "chunks")).alias("at", "p"))
    parts = parts.join(doubtful.withColumn("doubt", F.lit(True)), F.col("p.recipe") == F.col("hash"), "left")
    name = F.concat(F.col("p.recipe").cast("string"), F.when(F.col("doubt"), F.concat(F.lit(":"), F.col("p.chunks"))).otherwise(""))
    return (
        parts.select("row", "doc_id", "text_sha256", F.when(F.col("at").isNotNull(), F.struct("at", name.alias("name"))).alias("part"))
        .groupBy("row", "doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select("doc_id", "text_sha256", F.col("parts.name").alias("recipe"))
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each text that ``exact_groups`` tells apart: one of its keep_id, null or not."""
    keep = exact_groups(docs).where("kept").select("doc_id", "text_sha256").distinct()
    own = docs.withColumn("_sha256", F.sha2(F.regexp_replace(text_or_empty(), SPACE, " "), 256))
    same = own["doc_id"].eqNullSafe(keep["doc_id"]) & (own["_sha256"] == keep["text_sha256"])
    return own.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_sha256"]).drop("_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
