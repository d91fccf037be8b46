"""Courses as pipelined stages: transcripts and compressed videos meet as streams, parts come out in order once they are whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType


def longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


class WholeParts(StatefulProcessor):
    """Releases a course's parts in order: one comes out when all its items are ready and all parts before it are out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", longs("part"), StructType([StructField("of", LongType()), StructField("items", ArrayType(LongType()))]))  # those that aren't whole
        self.next = handle.getValueState("next", longs("part"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        following = begun = (self.next.get() or (0,))[0]
        ready: dict[int, tuple[int, set[int]]] = {}

        def told(part: int) -> tuple[int, set[int]] | None:
            if part not in ready and self.parts.containsKey((part,)):
                of, items = self.parts.getValue((part,))
                ready[part] = of, set(items)
            return ready.get(part)

        for pdf in rows:
            for part, item, of in zip(pdf.part.tolist(), pdf["item"].tolist(), pdf.items_of_part.tolist(), strict=True):
                if part >= begun:  # an item said again after a restart of its stage counts once
                    (told(part) or ready.setdefault(part, (of, set())))[1].add(item)
        out = []
        while (found := told(following)) and len(found[1]) >= found[0]:
            del ready[following]
            if self.parts.containsKey((following,)):
                self.parts.removeKey((following,))
            out.append((*key, following))
            following += 1
        for part, (of, items) in ready.items():
            self.parts.updateValue((part,), (of, sorted(items)))
        self.next.update((following,))
        yield pd.DataFrame({"course": pd.Series([c for c, _ in out], dtype=object), "part": pd.Series([p for _, p in out], dtype="int64")})

    def close(self) -> None:
        pass


def _within(within: str) -> Column:
    return (F.col("c_ts") >= F.col("ts")) & (F.col("c_ts") <= F.col("ts") + F.expr(f"interval {within}"))


def _both(transcripts: DataFrame, compressed: DataFrame, within: str, delay: str, how: str) -> DataFrame:
    """Items of both stages; a stage's failures don't count as its output."""
    fine = lambda rows: rows.where("error is null or error = ''")
    left = fine(transcripts).select("course", "item", "ts").withWatermark("ts", delay)
    right = fine(compressed).select(F.col("course").alias("c_course"), F.col("item").alias("c_item"), F.col("ts").alias("c_ts")).withWatermark("c_ts", delay)
    return left.join(right, (F.col("course") == F.col("c_course")) & (F.col("item") == F.col("c_item")) & _within(within), how)


def exported_parts(transcripts: DataFrame, compressed: DataFrame, plan: DataFrame, within: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """(course, part) of the streams ``transcripts`` and ``compressed`` (course, item, ts, error), in order, as parts become whole.

    An item is ready when it has been transcribed and then, ``within`` that time, compressed. ``plan(course, item, part)``, a
    table, says which items make a part, numbered from 0 in each course. A part with an item that failed, came later than the
    watermark's ``delay``, or never came holds back all after it. State is let go as the watermark passes and as parts come out.
    """
    of = plan.groupBy("course", "part").agg(F.count("*").alias("items_of_part"))
    named = plan.join(of, ["course", "part"]).select(F.col("course").alias("p_course"), F.col("item").alias("p_item"), F.col("part").cast("long").alias("part"), "items_of_part")
    ready = _both(transcripts, compressed, within, delay, "inner").select("course", F.col("item").cast("long").alias("item"))
    placed = ready.join(named, (F.col("course") == F.col("p_course")) & (F.col("item") == F.col("p_item"))).select(F.col("course").cast("string").alias("course"), "item", "part", "items_of_part")
    return placed.groupBy("course").transformWithStateInPandas(statefulProcessor=WholeParts(), outputStructType="course string, part long", outputMode="append", timeMode="none")


def stalled(transcripts: DataFrame, compressed: DataFrame, within: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """(course, item, ts): transcribed items that no compression followed ``within`` that time, told once the watermark is past it."""
    return _both(transcripts, compressed, within, delay, "left_outer").where("c_item is null").select("course", "item", "ts")
