"""Streaming: admission under sliding quotas, contiguous release of ready parts, and deduplicated logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from docloom.functions import numbers as N
from docloom.sources.shared import materialize, scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY, MINUTE = 86_400_000_000, 60_000_000


class Admission(StatefulProcessor):
    """Admits a key's requests in time order under limits a minute, a day and of tokens a minute.

    State holds the admitted requests of the last 25 hours, as far as a limit can still need them. A minute's lower bound is
    open, days are UTC, and a refused request holds nothing.
    """

    def __init__(self, per_minute: int, tokens_per_minute: int, per_day: int):
        self.per_minute, self.tokens_per_minute, self.per_day = per_minute, tokens_per_minute, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", StructType([StructField("at", LongType()), StructField("tokens", LongType())]))
        self.day = handle.getValueState("day", StructType([StructField("day", LongType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"], kind="stable")
        recent = deque((a, t) for a, t in self.recent.get())
        live = sum(t for _, t in recent)
        day, used = self.day.get() or (-1, 0)
        said = []
        for event, at, tokens in zip(batch.event_id, batch["at"], batch.tokens, strict=True):
            at, tokens = int(at), int(tokens)
            while recent and recent[0][0] <= at - MINUTE:
                live -= recent.popleft()[1]
            if at // DAY != day:
                day, used = at // DAY, 0
            reason = ""
            if self.per_day > 0 and used >= self.per_day:
                reason = "day"
            elif self.per_minute > 0 and len(recent) >= self.per_minute:
                reason = "minute"
            elif self.tokens_per_minute > 0 and live + tokens > self.tokens_per_minute:
                reason = "tokens"
            if not reason:
                recent.append((at, tokens))
                live += tokens
                used += 1
            said.append((*key, int(event), not reason, reason))
        self.recent.put(list(recent))
        self.day.update((day, used))
        yield pd.DataFrame(said, columns=["key", "event_id", "admitted", "reason"])

    def close(self) -> None:
        pass


def admitted(events: DataFrame, per_minute: int = 0, tokens_per_minute: int = 0, per_day: int = 0) -> DataFrame:
    """(key, event_id, admitted, reason) of a stream of (key, event_id, ts, tokens); needs the RocksDB state store."""
    rows = events.select(F.col("key").cast("string").alias("key"), "event_id", N.micros(F.col("ts")).alias("at"), "tokens")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Admission(per_minute, tokens_per_minute, per_day), outputStructType="key string, event_id long, admitted boolean, reason string", outputMode="append", timeMode="none"
    )


def admitted_batch(events: DataFrame, per_minute: int = 0, tokens_per_minute: int = 0, per_day: int = 0) -> DataFrame:
    """The same over a whole table: each key's requests replayed in time order.

    A task replays one day of a key, after the requests admitted in the last minute of the day before. Days are first
    replayed as if nothing came before, then again with what their day before admitted, until that no longer changes; the
    first day of a key is right at once and each further round settles at least the next.
    """

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "event_id"], kind="stable")
        before = pdf[pdf.carried]
        kept: list[tuple[int, int]] = list(zip(before["at"].tolist(), before.tokens.tolist(), strict=True))
        first, used, said = 0, 0, []
        live = sum(t for _, t in kept)
        for event, at, tokens in pdf[~pdf.carried][["event_id", "at", "tokens"]].itertuples(index=False):
            while first < len(kept) and kept[first][0] <= at - MINUTE:
                live -= kept[first][1]
                first += 1
            over = [(per_day > 0 and used >= per_day, "day"), (per_minute > 0 and len(kept) - first >= per_minute, "minute"), (tokens_per_minute > 0 and live + tokens > tokens_per_minute, "tokens")]
            reason = next((r for hit, r in over if hit), "")
            if not reason:
                kept.append((at, tokens))
                live += tokens
                used += 1
            said.append((pdf.key.iloc[0], event, not reason, reason, int(pdf.day.iloc[0]), at, tokens))
        return pd.DataFrame(said, columns=["key", "event_id", "admitted", "reason", "day", "at", "tokens"])

    at = N.micros(F.col("ts"))
    rows = events.select(F.col("key").cast("string").alias("key"), (at - F.pmod(at, F.lit(DAY))).alias("day"), "event_id", at.alias("at"), "tokens", F.lit(False).alias("carried"))
    kinds = dict(rows.dtypes)
    schema = f"key string, event_id {kinds['event_id']}, admitted boolean, reason string, day long, at long, tokens {kinds['tokens']}"
    days = rows.select("key", "day").distinct()
    carried = rows.limit(0)
    while True:
        said = materialize(rows.unionByName(carried).groupBy("key", "day").applyInPandas(replay, schema))
        late = said.where(F.col("admitted") & (F.col("at") > F.col("day") + DAY - MINUTE)).withColumn("day", F.col("day") + DAY)
        late = materialize(late.join(days, ["key", "day"], "left_semi").select("key", "day", "event_id", "at", "tokens", F.lit(True).alias("carried")))
        if late.exceptAll(carried).isEmpty() and carried.exceptAll(late).isEmpty():
            return said.select("key", F.col("event_id").cast("long").alias("event_id"), "admitted", "reason")
        carried = late


class ReadyPrefix(StatefulProcessor):
    """Releases a course's parts in order: a part comes out once it and all before it are ready."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", StructType([StructField("part", LongType())]), StructType([StructField("ready", LongType())]))
        self.next = handle.getValueState("next", StructType([StructField("part", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        following = (self.next.get() or (0,))[0]
        for pdf in rows:
            for part in pdf.part.tolist():
                if part >= following:
                    self.waiting.updateValue((int(part),), (1,))
        out = []
        while self.waiting.containsKey((following,)):
            self.waiting.removeKey((following,))
            out.append((*key, following))
            following += 1
        self.next.update((following,))
        yield pd.DataFrame(out, columns=["course", "part"])

    def close(self) -> None:
        pass


def released(parts: DataFrame) -> DataFrame:
    """(course, part) of a stream of ready parts (course, part from 0), in order and without gaps."""
    return parts.select("course", "part").groupBy("course").transformWithStateInPandas(statefulProcessor=ReadyPrefix(), outputStructType="course string, part long", outputMode="append", timeMode="none")


def distinct_log(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of log rows (id, ts, ...) without those repeated within the delay."""
    return lines.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def windowed_usage(events: DataFrame, length: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """(key, start, requests, tokens) of tumbling windows of a stream, late rows up to the delay."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("key", F.window("ts", length).alias("w"))
        .agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
        .select("key", F.col("w.start").alias("start"), "requests", "tokens")
    )


def streamed(rows: DataFrame | list[DataFrame], flow: Callable[..., DataFrame]) -> DataFrame:
    """What ``flow`` makes of tables as streams that end: written once to the shared folder, run with a checkpoint there, and read back.

    State is kept by RocksDB. A flow that waits for the watermark needs a last row late enough to move it.
    """
    every = rows if isinstance(rows, list) else [rows]
    spark = every[0].sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = scratch_path(spark)
    made = flow(*[spark.readStream.schema(r.schema).parquet(materialize(r)._docloom_path) for r in every])
    q = made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows")
