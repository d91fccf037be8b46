"""The corpus pipeline: quality, exact dedup, near dedup, mixing and packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, read
from docloom.llm.exact_dedup import drop_exact_duplicates
from docloom.llm.mixing import mix_documents
from docloom.llm.packing import pack_documents
from docloom.llm.quality import score_quality, training_labels
from docloom.llm.simhash import simhash_components


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, repeated rows and null ids included; null text counts as empty; an empty table gives no rows."""
    names = {c: f"_kept{k}" for k, c in enumerate(docs.columns)}  # whatever the table's columns are called
    kept = docs.select("doc_id", "text", *[F.col(c).alias(name) for c, name in names.items()])
    scored = score_quality(kept, training_labels(read(spark, sf_dir, "labels")), passing=list(names.values()))
    return scored.where("predicted = 1").select(*[F.col(name).alias(c) for c, name in names.items()])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest doc_id, one of no doc_id if none has any; null text counts as empty; an empty table gives no rows."""
    return drop_exact_duplicates(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, which tells rows apart where doc_id is null or repeated."""
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest doc_id, one of no doc_id if none has any.

    Rows that repeat the smallest doc_id within a component count as that document and stay.
    """
    rows = numbered(docs)
    of = simhash_components(rows.withColumn("doc_id", F.col("_row"))).select(F.col("doc_id").alias("_row"), "component_id")
    ids = of.join(rows.select("_row", "doc_id"), "_row")
    least = ids.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.min("_row").alias("any_row"))
    first = (F.col("doc_id") == F.col("least")) | (F.col("least").isNull() & (F.col("_row") == F.col("any_row")))
    keep = ids.join(least, "component_id").where(first).select("_row")
    return rows.join(keep, "_row", "left_semi").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents at the target mix, each as often as the mix takes it; what it takes of one in part counts as a whole from half on.

    A null source is a source; documents without words and those that the mix takes nothing of go; an empty table gives no rows.
    """
    rows = numbered(docs)
    taken = mix_documents(rows, ("_row",)).where("taken > 0").select("_row", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies")).where("copies > 0")
    return rows.join(taken, "_row").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, bucket_length, batch_id, slot of each row of the mix, repeats and null ids included; an empty table gives no rows."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixing), ("packing", packing)]
#: The classifier and the fingerprints aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
