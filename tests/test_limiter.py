"""The stream limiter: decisions by hand, independence of batches and order, restarts, and the live mode's timers."""

import random
import time
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from docloom.streaming import limiter

SCHEMA = "key string, event_id long, ts timestamp, tokens long, kind string"
T0 = datetime(2024, 1, 1, 12)


def run(spark, path, name, checkpoint, **limits):
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    out = limiter.limited(stream, **limits)
    q = out.writeStream.format("parquet").option("path", f"{checkpoint}/out").option("checkpointLocation", f"{checkpoint}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def written(spark, path, rows, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{n}")


def told(spark, checkpoint):
    rows = spark.read.parquet(f"{checkpoint}/out").collect()
    base = round((T0 - datetime(1970, 1, 1)).total_seconds())
    return {(r.key, r.event_id): (r.admitted, r.reason, r.decided_at // 1_000_000 - base) for r in rows}


def at(s, event, kind="request", tokens=0, key="a"):
    return (key, event, T0 + timedelta(seconds=s), tokens, kind)


def flush(key="z"):
    return [at(10_000, 999, key=key)]


def test_limits_by_hand(spark, tmp_path):
    rows = [
        at(0, 1, tokens=60), at(1, 2, tokens=30), at(2, 3, tokens=20), at(3, 4, tokens=500),  # 3 and 4 wait for a slot
        at(100, 5, key="b"), at(101, 5, "limited", key="b"), at(105, 6, key="b"), at(161, 7, key="b"),  # 6 waits for the cooldown's end
        at(0, 8, key="c"), at(1, 9, key="c"), at(2, 10, key="c"), at(7, 8, "release", key="c"),  # two slots
    ]
    written(spark, f"{tmp_path}/in", rows + flush(), 0)
    run(spark, f"{tmp_path}/in/*", "hand", f"{tmp_path}/c", tokens_per_minute=100, slots=2, cooldown_s=60, timeout_s=1000, patience_s=90)
    got = told(spark, f"{tmp_path}/c")
    assert {e: got["a", e] for e in (1, 2)} == {1: (True, "", 0), 2: (True, "", 1)}
    assert got["a", 3] == (False, "busy", 92) and got["a", 4] == (False, "busy", 93)  # both slots are taken and nothing is released in time
    assert {e: got["b", e] for e in (5, 6, 7)} == {5: (True, "", 100), 6: (True, "", 161), 7: (True, "", 161)}
    assert {e: got["c", e] for e in (8, 9, 10)} == {8: (True, "", 0), 9: (True, "", 1), 10: (True, "", 7)}


def test_waits_for_tokens_and_refuses_by_day(spark, tmp_path):
    rows = [at(0, 1, tokens=60), at(1, 2, tokens=30), at(2, 3, tokens=20), at(3, 4, tokens=500), *[at(200 + i, 10 + i) for i in range(3)]]
    written(spark, f"{tmp_path}/in", rows + flush(), 0)
    run(spark, f"{tmp_path}/in/*", "tokens", f"{tmp_path}/c", tokens_per_minute=100, per_day=5, patience_s=90)
    got = told(spark, f"{tmp_path}/c")
    assert got["a", 3] == (True, "", 61)  # a minute after the first, and a second
    assert got["a", 4][0] is False and got["a", 4][1] == "tokens"
    assert [got["a", 10 + i] for i in range(3)] == [(True, "", 200), (True, "", 201), (False, "day", 202)]


def test_restarts_and_order_change_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows, s = [], 0
    for i in range(160):
        s += rng.randint(0, 6)
        key = rng.choice("ab")
        rows.append(at(s, i, tokens=rng.randint(1, 40), key=key))
        if rng.random() < 0.6:
            rows.append(at(s + rng.randint(1, 20), i, "limited" if rng.random() < 0.1 else "release", key=key))
    limits = {"per_minute": 6, "tokens_per_minute": 120, "slots": 3, "cooldown_s": 30, "timeout_s": 40, "patience_s": 120}
    written(spark, f"{tmp_path}/one", rows + flush(), 0)
    run(spark, f"{tmp_path}/one/*", "whole", f"{tmp_path}/w", **limits)
    want = told(spark, f"{tmp_path}/w")
    near = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randint(0, 25)))  # late ones within the delay
    cut = [near[:90], near[90:200], near[200:] + flush()]
    for n, some in enumerate(cut):  # each run goes on from the checkpoint of the one before
        written(spark, f"{tmp_path}/many", some, n)
        run(spark, f"{tmp_path}/many/*", f"part{n}", f"{tmp_path}/m", **limits)
    assert told(spark, f"{tmp_path}/m") == want
    assert {r for _, r, _ in want.values()} >= {"", "busy"} and any(d > 0 for _, _, d in want.values()) and len(want) == 160


def test_live_cooldown_ends_by_timer(spark, tmp_path):
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = [("a", 1, now, 0, "request"), ("a", 1, now + timedelta(milliseconds=10), 0, "limited"), ("a", 2, now + timedelta(milliseconds=20), 0, "request")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = limiter.limited(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), slots=5, cooldown_s=4, patience_s=60, live=True)
    q = out.writeStream.format("memory").queryName("live").outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("live").count() < 2:
            time.sleep(1)
        got = {r.event_id: (r.admitted, r.decided_at - r.asked_at) for r in spark.table("live").where(F.col("key") == "a").collect()}
    finally:
        q.stop()
    assert got[1] == (True, 0) and got[2][0] and got[2][1] == 3_990_000


class Held(dict):
    def containsKey(self, k):  # noqa: N802, N803
        return k in self

    def getValue(self, k):  # noqa: N802, N803
        return self[k]

    def updateValue(self, k, v):  # noqa: N802, N803
        self[k] = v

    def removeKey(self, k):  # noqa: N802, N803
        del self[k]

    def iterator(self):
        return iter(list(self.items()))


def test_what_waits_is_decided_hour_by_hour(monkeypatch):
    """Before, all rows of a key that wait were one list in the memory of its task."""
    n, hour, asked, woken = 5000, limiter.HOUR, [], []
    p = limiter.Limiter(1, 0, 0, 0, 0, 0, 0, live=False)
    p.pending_state, p.hours_state, p.wake = Held(), Held(), woken.append
    p.moved = lambda key, rows, now, following=None, wakes=True: asked.append((rows, now, following)) or pd.DataFrame()
    monkeypatch.setattr(limiter, "HELD_ROWS", 700)
    at = [i * hour // 50 for i in random.Random(3).sample(range(n), n)]
    pdf = pd.DataFrame({"at": at, "event_id": range(n), "tokens": 1, "kind": "request"})
    assert list(p.handleInputRows(("a",), iter([pdf[k : k + 300] for k in range(0, n, 300)]), None)) == [] and woken == [0]
    times = type("Times", (), {"getCurrentWatermarkInMs": lambda self: (40 * hour + hour // 2) // 1000})()
    list(p.handleExpiredTimer(("a",), times, None))
    assert max(len(r) for r, *_ in asked) == 50 and [len(r) for r, *_ in asked[-2:]] == [26, 0]
    assert [x[0] for r, *_ in asked for x in sorted(r)] == [i * hour // 50 for i in range(40 * 50 + 26)] and asked[-1][2] == 40 * hour + hour // 50 * 26
    assert sum(len(v[0]) for v in p.pending_state.values()) == (n - 40 * 50 - 26) * 32
