"""Results that never change, written all or nothing: a data source whose tasks write segments and whose driver commits them."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "docloom_immutable"
STORED = "address string, id string, body string"
#: Bytes of bodies that a task holds before it writes a row group.
GROUP_BYTES = 16_000_000


def mounted(path: str) -> str:
    """``path`` as a folder that driver and executors have mounted."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: results are written to a mounted folder")
    return path.removeprefix("file://").removeprefix("file:").rstrip("/")


@dataclass
class Segment(WriterCommitMessage):
    name: str
    rows: int


class SegmentWriter(DataSourceArrowWriter):
    """Each task attempt writes a segment of its own; what a commit doesn't name is invisible and is deleted if the write fails."""

    def __init__(self, path: str, version: int):
        self.path, self.version, self.run = path, version, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segment:
        os.makedirs(f"{self.path}/segments", exist_ok=True)
        name, rows, writer, held, size = f"{self.run}-{uuid.uuid4().hex}.parquet", 0, None, [], 0
        try:
            for batch in iterator:
                writer = writer or pq.ParquetWriter(f"{self.path}/segments/{name}", batch.schema, compression="zstd")
                held.append(batch)
                size += batch.nbytes
                rows += batch.num_rows
                if size > GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held))
        finally:
            if writer:
                writer.close()
        return Segment(name if rows else "", rows)

    def commit(self, messages: list[Segment | None]) -> None:
        names = sorted(m.name for m in messages if m and m.name)
        os.makedirs(f"{self.path}/commits", exist_ok=True)
        staged = f"{self.path}/commits/.{self.run}"
        with open(staged, "w") as f:
            json.dump({"segments": names, "rows": sum(m.rows for m in messages if m)}, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(staged, f"{self.path}/commits/{self.version:012d}.json")  # fails if another write has taken the number
        except FileExistsError:
            self.abort(messages)
            raise RuntimeError(f"{self.path} changed while results were written; nothing was, write again") from None
        finally:
            os.unlink(staged)

    def abort(self, messages: list[Segment | None]) -> None:
        folder = f"{self.path}/segments"
        for name in os.listdir(folder) if os.path.isdir(folder) else []:
            if name.startswith(self.run):
                os.unlink(f"{folder}/{name}")


class ImmutableResults(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return STORED

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        if overwrite:
            raise ValueError("immutable results can't be overwritten")
        return SegmentWriter(mounted(self.options["path"]), int(self.options["version"]))


def committed(path: str) -> list[list[str]]:
    """The segments that each commit made visible, in order."""
    folder = f"{mounted(path)}/commits"
    names = sorted(n for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []
    out = []
    for n in names:
        with open(f"{folder}/{n}") as f:
            out.append([f"{mounted(path)}/segments/{s}" for s in json.load(f)["segments"]])
    return out


def stored_results(spark: SparkSession, path: str, commits: int | None = None) -> DataFrame:
    """(address, id, body) of the results that are visible; with ``commits``, as they were after so many."""
    segments = [f"file://{s}" for some in committed(path)[:commits] for s in some]
    return spark.read.schema(STORED).parquet(*segments) if segments else spark.createDataFrame([], STORED)


def conflicts(stored: DataFrame, results: DataFrame) -> DataFrame:
    """(id): results that differ from the stored one of their id, or among themselves."""
    seen = stored.select("address", F.col("body").alias("stored"))
    each = results.groupBy("address").agg(F.min("id").alias("id"), F.min("body").alias("low"), F.max("body").alias("high"))
    both = each.join(seen, "address", "left")
    return both.where("low <> high or (stored is not null and stored <> low)").select("id")


def put_results(results: DataFrame, path: str) -> int:
    """Write ``results(id, body)`` to ``path``, addressed by the SHA-256 of the id; returns how many were new.

    Equal results are no-ops. If one differs from a stored result of its id, or from another of the same write, ValueError is
    raised and nothing is written. A write that fails, in whatever task, leaves nothing visible; two writes at once don't mix:
    the later raises RuntimeError and can be repeated. Rows without id are left out, a null body is empty.
    """
    spark = results.sparkSession
    spark.dataSource.register(ImmutableResults)
    keyed = results.where("id is not null").select(F.sha2("id", 256).alias("address"), F.col("id").cast("string").alias("id"), F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"))
    version = len(committed(path))
    stored = stored_results(spark, path, version)
    if differs := conflicts(stored, keyed).limit(1).collect():
        raise ValueError(f"immutable result {differs[0].id!r} already has different content")
    fresh = keyed.join(stored.select("address"), "address", "left_anti").groupBy("address").agg(F.min("id").alias("id"), F.min("body").alias("body"))
    fresh.write.format(FORMAT).mode("append").option("path", path).option("version", version).save()
    names = committed(path)[version]
    return sum(pq.read_metadata(n).num_rows for n in names)
