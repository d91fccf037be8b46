"""Writes: upserts, replaced children, deletes, immutable results, logs and their undoing, as new versions of tables.

Parquet has no row updates, so each function returns the table after the change; ``save`` swaps it in by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T


def upsert(rows: DataFrame, changes: DataFrame, key: str, now: Column, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Rows with ``changes`` put in by key: the last change of a key (by ``seq``) wins, ``keep`` columns of old rows stay.

    updated_at of changed rows is ``now``. Old rows meet changes by one aggregate over the union of both.
    """
    columns = rows.columns
    old = rows.select(key, F.struct(*columns).alias("old"), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in rows.dtypes) + ">").alias("new"), F.lit(-1).cast("long").alias("seq"))
    new = changes.select(key, F.lit(None).alias("old"), F.struct(*columns).alias("new"), F.col("seq").cast("long").alias("seq"))
    both = old.unionByName(new).groupBy(key).agg(F.max("old").alias("old"), F.max_by("new", F.when(F.col("new").isNotNull(), F.col("seq"))).alias("new"))

    def pick(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c == "updated_at":
            return F.when(F.col("new").isNull(), F.col("old.updated_at")).otherwise(now).alias(c)
        if c in keep:
            return F.when(F.col("old").isNotNull(), F.col(f"old.`{c}`")).otherwise(F.col(f"new.`{c}`")).alias(c)
        return F.when(F.col("new").isNull(), F.col(f"old.`{c}`")).otherwise(F.col(f"new.`{c}`")).alias(c)

    return both.select(*[pick(c) for c in columns])


def replace_children(rows: DataFrame, fresh: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """Child rows after those of ``parents`` are replaced by ``fresh``; parents without fresh rows lose theirs."""
    return rows.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def update(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def update_one(rows: DataFrame, key: str, value, values: dict[str, Column]) -> DataFrame:
    """``update`` of one row; raises KeyError if there is none."""
    if rows.where(F.col(key) == value).isEmpty():
        raise KeyError(f"{key} {value!r} not found")
    return update(rows, F.col(key) == value, values)


def interrupted(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs left running by a stopped process, as failed."""
    return update(jobs, F.col("status").isin("running", "queued"), {"status": F.lit("failed"), "error": F.lit("interrupted"), "finished_at": now})


def delete_finished(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("status").isin("completed", "failed", "cancelled"))


def retained(events: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Usage events younger than the retention."""
    return events.where(N.micros(F.col("occurred_at")) >= N.micros(now) - hours * 3_600_000_000)


def immutable_put(stored: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts) of content-addressed results (id, body): equal ones are no-ops, others conflict."""
    keyed = results.withColumn("address", F.sha2("id", 256))
    both = keyed.join(stored.select("address", F.col("body").alias("stored")), "address", "left")
    return both.where("stored is null").drop("stored"), both.where("stored is not null and stored <> body").select("id", "address")


def checkpoint_key(version: Column, source: Column, model: Column, prompt: Column, chunk: Column) -> Column:
    """Fingerprint of a chunk's result: changes with the version, source, model, prompt and chunk."""
    return F.sha2(F.concat_ws("\n", version, F.sha2(source, 256), model, F.sha2(prompt, 256), chunk), 256)


def missing_chunks(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(cache.select("fingerprint").distinct(), "fingerprint", "left_anti")


def audit(run: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, path, before, after, action) of each destination whose content changed."""
    b, a = before.select("path", F.col("content").alias("before")), after.select("path", F.col("content").alias("after"))
    both = run.select("run_id", "path").distinct().join(b, "path", "left").join(a, "path", "left").where("not (before <=> after)")
    return both.select("run_id", "path", "before", "after", F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "deleted").otherwise("changed").alias("action"))


def latest_restorable(runs: DataFrame) -> DataFrame:
    """The run to undo: the last one completed (or made) that changed something and isn't undone."""
    fine = runs.where((F.col("changes") > 0) & F.col("restored_at").isNull())
    return fine.agg(F.max_by("run_id", F.struct(F.coalesce("completed_at", "created_at").alias("t"), F.col("run_id").alias("r"))).alias("run_id"))


def rolled_back(notes: DataFrame, log: DataFrame) -> DataFrame:
    """Notes before a run: changed ones get their earliest before-image back, created ones go, deleted ones return."""
    first = log.groupBy("path").agg(F.min_by(F.struct("before"), "pos").alias("f")).select("path", F.col("f.before").alias("before"))
    kept = notes.join(first.select("path"), "path", "left_anti").select("path", "content")
    return kept.unionByName(first.where("before is not null").select("path", F.col("before").alias("content")))


def run_manifest(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(value): one JSON object of aggregates over ``rows``."""
    return rows.agg(*[c.alias(k) for k, c in fields.items()]).select(F.to_json(F.struct(*fields)).alias("value"))


def news_sheet(items: DataFrame) -> DataFrame:
    """The four columns of a news sheet, nulls as blanks."""
    return items.select(*[T.or_blank(F.col(c)).alias(c) for c in ("title", "content", "source", "date")])


def save(rows: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Write a table version; with partitions only those present are replaced."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_lines(lines: DataFrame, path: str) -> None:
    """Append a log's lines (value) as text files."""
    lines.select("value").write.mode("append").text(path)
