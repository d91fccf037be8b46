"""The limiter of a stream in full: quotas, cooldowns and slots in use, with requests that wait for their turn."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from docloom.functions import numbers as N

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000
#: What frees a slot goes first among rows of one time. Rows that a task holds before it puts them into state.
TURN, HELD_ROWS = {"release": 0, "limited": 1, "request": 2}, 100_000
#: The window of a minute, what is added to its waits, and how long usage is kept: fixed values.
MINUTE, HEADROOM, RETENTION = 60 * SECOND, SECOND, 25 * 3_600 * SECOND
OUTPUT = "key string, event_id long, asked_at long, decided_at long, admitted boolean, reason string"


def longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


class Limiter(StatefulProcessor):
    """Decides a key's requests in time order; see ``limited``. Times are microseconds of events.

    ``live``: rows are taken as they come, state expires by its time to live and timers follow the clock. Otherwise rows wait
    in state until the watermark has passed them, so neither their order of arrival nor the batches matter.
    """

    def __init__(self, per_minute: int, tokens_per_minute: int, per_day: int, slots: int, cooldown_s: int, timeout_s: int, patience_s: int, live: bool):
        self.per_minute, self.tokens_per_minute, self.per_day, self.slots = per_minute, tokens_per_minute, per_day, slots
        self.cooldown, self.timeout, self.patience, self.live = cooldown_s * SECOND, timeout_s * SECOND, patience_s * SECOND, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        keep = lambda us: us // 1000 if self.live else None
        self.handle = handle
        self.usage_state = handle.getListState("usage", longs("at", "tokens"), keep(RETENTION))
        self.active_state = handle.getMapState("active", longs("event_id"), longs("at"), keep(self.timeout))
        self.waiting_state = handle.getListState("waiting", longs("retry_at", "asked_at", "event_id", "tokens"))
        self.pending_state = handle.getMapState("pending", longs("hour", "nth"), StructType([StructField("rows", BinaryType())]))  # (at, event_id, tokens, turn) of some of an hour's rows
        self.hours_state = handle.getMapState("hours", longs("hour"), longs("parts", "first"))
        self.until_state = handle.getValueState("until", longs("at"), keep(max(SECOND, self.cooldown)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.live:
            fresh = [tuple(r) for pdf in rows for r in self.numbers(pdf).tolist()]
            yield self.moved(key, fresh, max(a for a, *_ in fresh))
            return
        held, n, first = [], 0, None
        for pdf in rows:
            held.append(self.numbers(pdf))
            n += len(pdf)
            low = int(pdf["at"].min())
            first = low if first is None else min(low, first)
            if n >= HELD_ROWS:
                self.hold(np.concatenate(held))
                held, n = [], 0
        if held:
            self.hold(np.concatenate(held))
        self.wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.live:
            yield self.moved(key, [], expiredTimerInfo.getExpiryTimeInMs() * 1000)
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        hours = sorted((h, parts, first) for (h,), (parts, first) in self.hours_state.iterator())
        following = min((first for *_, first in hours if first > now), default=None)
        for hour, parts, _ in [x for x in hours if x[2] <= now]:  # an hour at a time, however many wait
            rows = np.concatenate([np.frombuffer(self.pending_state.getValue((hour, k))[0], np.int64).reshape(-1, 4) for k in range(parts)])
            for k in range(parts):
                self.pending_state.removeKey((hour, k))
            self.hours_state.removeKey((hour,))
            if len(later := rows[rows[:, 0] > now]):
                self.hold(later)
                following = min(int(later[:, 0].min()), following or 1 << 62)
            yield self.moved(key, [tuple(r) for r in rows[rows[:, 0] <= now].tolist()], min(now, (hour + 1) * HOUR - 1), wakes=False)
        yield self.moved(key, [], now, following)

    def numbers(self, pdf: pd.DataFrame) -> np.ndarray:
        """(at, event_id, tokens, turn) of rows; what frees a slot has an earlier turn."""
        return np.stack([pdf["at"].to_numpy(np.int64), pdf.event_id.to_numpy(np.int64), pdf.tokens.to_numpy(np.int64), np.fromiter((TURN[k] for k in pdf.kind), np.int64, len(pdf))], axis=1)

    def hold(self, rows: np.ndarray) -> None:
        """Keep rows in state until the watermark has passed them, by hour."""
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        for some in np.split(rows, np.flatnonzero(np.diff(rows[:, 0] // HOUR)) + 1):
            hour, first = int(some[0, 0] // HOUR), int(some[0, 0])
            parts, least = self.hours_state.getValue((hour,)) if self.hours_state.containsKey((hour,)) else (0, first)
            self.pending_state.updateValue((hour, parts), (some.tobytes(),))
            self.hours_state.updateValue((hour,), (parts + 1, min(first, least)))

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def moved(self, key: tuple, rows: list[tuple], now: int, following: int | None = None, wakes: bool = True) -> pd.DataFrame:
        """What is decided until ``now``: by ``rows`` and by requests whose time to ask again has come, all in time order."""
        self.usage = [(a, t) for a, t in self.usage_state.get()]
        self.active = {e: a for (e,), (a,) in self.active_state.iterator()}
        self.until = (self.until_state.get() or (0,))[0]
        waiting = sorted(self.waiting_state.get())
        self.counted = self.per_minute > 0 or self.tokens_per_minute > 0 or self.per_day > 0
        was, held, out = list(self.usage), set(self.active), []
        rows = sorted(rows, key=lambda r: (r[0], r[3], r[1]))

        def ask(at: int, asked_at: int, event: int, tokens: int) -> None:
            reason, wait = self.checked(at, tokens)
            if not reason:
                if self.counted:
                    self.usage.append((at, tokens))
                if self.slots > 0:
                    self.active[event] = at
            elif wait is not None and (retry := min(at + wait, asked_at + self.patience) if reason == "busy" else at + wait) <= asked_at + self.patience and retry > at:
                waiting.append((retry, asked_at, event, tokens))
                waiting.sort()
                return
            out.append((*key, event, asked_at, at, not reason, reason))

        i = 0
        while i < len(rows) or (waiting and waiting[0][0] <= now):
            if waiting and waiting[0][0] <= now and (i == len(rows) or waiting[0][0] <= rows[i][0]):
                ask(*waiting.pop(0))
                continue
            at, event, tokens, kind = rows[i]
            i += 1
            if kind == TURN["request"]:
                ask(at, at, event, tokens)
                continue
            self.active.pop(event, None)
            if kind == TURN["limited"]:
                self.until = at + self.cooldown
            waiting[:] = sorted((at, *w[1:]) for w in waiting)  # all ask again
        old = bisect_right(self.usage, (now - RETENTION, 1 << 62))
        if old:
            self.usage = self.usage[old:]
            self.usage_state.put(self.usage) if self.usage else self.usage_state.clear()
        elif len(self.usage) > len(was):
            self.usage_state.appendList(self.usage[len(was) :])
        for e in held - set(self.active):
            self.active_state.removeKey((e,))
        for e in set(self.active) - held:
            self.active_state.updateValue((e,), (self.active[e],))
        self.waiting_state.put(waiting) if waiting else self.waiting_state.clear()
        self.until_state.update((self.until,))
        nearest = [t for t in (waiting[0][0] if waiting else None, following) if t is not None]
        if nearest and wakes:
            self.wake(min(nearest))
        elif self.usage and wakes and not self.live:
            self.wake(self.usage[-1][0] + RETENTION)  # an idle key lets go of its usage
        return pd.DataFrame(out, columns=["key", "event_id", "asked_at", "decided_at", "admitted", "reason"])

    def checked(self, now: int, tokens: int) -> tuple[str, int | None]:
        """(why a request can't start now, '' if it can; after how long to ask again, None if that is no use)."""
        if now < self.until:
            return "cooldown", self.until - now
        self.active = {e: a for e, a in self.active.items() if a + self.timeout > now}
        if 0 < self.slots <= len(self.active):
            return "busy", min(self.active.values()) + self.timeout - now
        if self.per_day > 0 and len(self.usage) - bisect_left(self.usage, (now - now % DAY,)) >= self.per_day:
            return "day", None
        recent = self.usage[bisect_left(self.usage, (now - MINUTE + 1,)) :]
        reason, wait = "", 0
        if 0 < self.per_minute <= len(recent):
            reason, wait = "minute", recent[0][0] + MINUTE + HEADROOM - now
        used = sum(t for _, t in recent)
        if 0 < self.tokens_per_minute < used + tokens:
            free = MINUTE + HEADROOM
            for a, t in recent:
                used -= t
                if used + tokens <= self.tokens_per_minute:
                    free = a + MINUTE + HEADROOM - now
                    break
            if free > wait:
                reason, wait = reason or "tokens", free
        return reason, wait

    def close(self) -> None:
        pass


def limited(
    events: DataFrame, per_minute: int = 0, tokens_per_minute: int = 0, per_day: int = 0, slots: int = 0, cooldown_s: int = 14_400, timeout_s: int = 120, patience_s: int = 0, live: bool = False, delay: str = "1 minute"
) -> DataFrame:
    """(key, event_id, asked_at, decided_at, admitted, reason) of a stream of (key, event_id, ts, tokens, kind).

    ``kind`` is request, release (the request of that event_id is done) or limited (it was refused upstream: done, and the
    key cools down). A request starts if its key isn't cooling down, has a free slot (one unreleased for ``timeout_s`` counts
    as free) and is within the limits a minute, of tokens a minute and a UTC day; a limit of 0 is none. Else it waits: until the
    cooldown ends, until usage leaves the last minute and a second more, or until a slot may be free, and whenever something
    is released all ask again, in order of asking. A request is refused that would have to wait over ``patience_s`` from its
    time, that has no slot by then, or whose day is used up. Usage is kept 25 hours. Null tokens are 0, null kinds are requests.

    ``live``: for streams at the clock's time, with state that expires by itself and timers by processing time. Otherwise
    results depend on the events alone, late ones up to ``delay`` included, and come once the watermark has passed.
    """
    rows = events if live else events.withWatermark("ts", delay)
    at = N.micros(F.col("ts"))
    rows = rows.select(
        F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), at.alias("at"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), F.coalesce("kind", F.lit("request")).alias("kind"), "ts"
    )
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Limiter(per_minute, tokens_per_minute, per_day, slots, cooldown_s, timeout_s, patience_s, live), outputStructType=OUTPUT, outputMode="append", timeMode="processingTime" if live else "eventTime"
    )
