"""Immutable results: no-ops, conflicts, failed tasks, writers that meet."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.sources import immutable


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, body string").repartition(3)


def seen(spark, path):
    return {r.id: r.body for r in immutable.stored_results(spark, path).collect()}


def test_put_and_conflicts(spark, tmp_path):
    path = str(tmp_path / "r")
    assert seen(spark, path) == {}
    assert immutable.put_results(frame(spark, ("a", "1"), ("b", "2"), ("b", "2"), (None, "x"), ("n", None)), path) == 3
    assert immutable.put_results(frame(spark, ("a", "1"), ("c", "3")), f"file://{path}") == 1  # equal ones are no-ops
    want = {"a": "1", "b": "2", "c": "3", "n": ""}
    assert seen(spark, path) == want
    for bad in ([("a", "other"), ("d", "4")], [("e", "1"), ("e", "2")]):
        with pytest.raises(ValueError, match="different content"):
            immutable.put_results(frame(spark, *bad), path)
    assert seen(spark, path) == want
    assert immutable.put_results(frame(spark, ("a", "1")), path) == 0
    assert immutable.stored_results(spark, path, 1).count() == 3


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    immutable.put_results(frame(spark, ("a", "1")), path)
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("id"), F.when(F.col("id") == 399, F.raise_error(F.lit("broken row"))).otherwise("x").alias("body"))
    spark.dataSource.register(immutable.ImmutableResults)
    late = rows.repartition(4, "id").select(F.sha2("id", 256).alias("address"), "id", F.col("body").cast("string").alias("body"))
    with pytest.raises(Exception, match="broken row"):
        late.write.format(immutable.FORMAT).mode("append").option("path", path).option("version", 1).save()
    assert seen(spark, path) == {"a": "1"}
    assert len(os.listdir(f"{path}/segments")) == len(immutable.committed(path)[0])  # what other tasks wrote is gone


def test_writers_that_meet(spark, tmp_path):
    path = str(tmp_path / "r")
    immutable.put_results(frame(spark, ("a", "1")), path)
    one = frame(spark, ("b", "2")).select(F.sha2("id", 256).alias("address"), "id", "body")
    with pytest.raises(Exception, match="changed while"):  # as if the other had committed after this one looked
        one.write.format(immutable.FORMAT).mode("append").option("path", path).option("version", 0).save()
    assert seen(spark, path) == {"a": "1"} and sorted(os.listdir(f"{path}/commits")) == ["000000000000.json"]
    assert immutable.put_results(frame(spark, ("b", "2")), path) == 1
    with pytest.raises(Exception, match="overwritten"):
        one.write.format(immutable.FORMAT).mode("overwrite").option("path", path).option("version", 2).save()
