"""Events as calls, usage and subtitles."""

from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators import aggregates, packing, windows
from docloom.plans.registry import query
from docloom.streaming import limiter, quota, stages


def _rate(seconds: int):
    sql = f"""
SELECT event_id, count(*) OVER w AS window_requests, (sum(CAST(floor(value) AS BIGINT)) OVER w)::BIGINT AS window_tokens FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW)"""

    def run(t):
        e = t("events").select("event_id", "event_type", "ts", F.floor("value").alias("tokens"))
        return windows.trailing_usage(e, ["event_type"], seconds).select("event_id", "window_requests", "window_tokens")

    return sql, run


for _name, _seconds in (("rate_window_60s", 60), ("rate_window_1h", 3600)):
    _sql, _run = _rate(_seconds)
    _run.__name__ = _name
    query(_sql)(_run)


@query("SELECT event_type, (ts::DATE)::VARCHAR AS day, count(*) AS requests FROM events GROUP BY 1, 2")
def rate_daily(t):
    return windows.daily_usage(t("events"), ["event_type"]).withColumn("day", F.col("day").cast("string"))


@query("""
WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS live FROM events, n WHERE epoch_us(ts) > epoch_us(now) - 25 * 3600000000 GROUP BY 1""")
def usage_retention(t):
    e = t("events")
    now = e.agg(F.max("ts").alias("now"))
    live = windows.recent(e.crossJoin(F.broadcast(now)), F.col("now"))  # one row
    return live.groupBy("event_type").agg(F.count("*").alias("live"))


_BLOCKS = """
WITH b AS (SELECT user_id AS file, epoch_us(ts) // 100000 AS start_ms, epoch_us(ts) // 100000 + CAST(floor(value * 1000) AS BIGINT) - 5000 AS end_ms, event_id::VARCHAR AS text FROM events),
s1 AS (SELECT *, CASE WHEN end_ms <= start_ms THEN start_ms + 1000 ELSE end_ms END AS e1, lead(start_ms) OVER w AS nxt FROM b WINDOW w AS (PARTITION BY file ORDER BY start_ms, CASE WHEN end_ms <= start_ms THEN start_ms + 1000 ELSE end_ms END, text)),
s2 AS (SELECT *, CASE WHEN nxt > start_ms AND e1 > nxt THEN nxt - 1 ELSE e1 END AS e2 FROM s1), s3 AS (SELECT *, CASE WHEN e2 - start_ms > 120000 THEN start_ms + 120000 ELSE e2 END AS e3 FROM s2),
fixed AS (SELECT file, start_ms, CASE WHEN e3 <= start_ms THEN start_ms + 1000 ELSE e3 END AS end_ms, text FROM s3)
"""


def _blocks(t):
    start = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 100).cast("long")
    return t("events").select(F.col("user_id").alias("file"), start.alias("start_ms"), (start + F.floor(F.col("value") * 1000).cast("long") - 5000).alias("end_ms"), F.col("event_id").cast("string").alias("text"))


@query(_BLOCKS + "SELECT text, file, start_ms, end_ms FROM fixed")
def interval_repair(t):
    """Each user's events as subtitle blocks, repaired."""
    return windows.repair_intervals(_blocks(t)).select("text", "file", "start_ms", "end_ms")


@query(
    _BLOCKS
    + """, items AS (SELECT file, row_number() OVER (ORDER BY file) AS item, max(end_ms) AS last, count(*) AS n FROM fixed GROUP BY file),
p AS (SELECT *, coalesce(sum(last) OVER (ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, coalesce(sum(n) OVER (ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM items)
SELECT p.item, (bef + row_number() OVER (PARTITION BY f.file ORDER BY start_ms, end_ms, text))::BIGINT AS number, start_ms + off AS start_ms, end_ms + off AS end_ms, text FROM fixed f JOIN p USING (file)"""
)
def interval_offset(t):
    """The repaired blocks of all users as one recording."""
    blocks = windows.repair_intervals(_blocks(t))
    items = _blocks(t).select("file", F.lit(None).cast("long").alias("duration_ms")).distinct()
    return windows.offset_segments(blocks, items)


@query("""
SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS shown, ms AS parsed FROM (SELECT event_id, ((epoch_us(ts) // 1000) % 86400000)::BIGINT AS ms FROM events)""")
def subtitle_times(t):
    """Milliseconds of the day as subtitle times, and read back."""
    shown = T.style_time((F.unix_millis(F.col("ts").cast("timestamp")) % 86_400_000).cast("long"))
    return t("events").select("event_id", shown.alias("shown"), T.parse_time(shown).alias("parsed"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value > 40) AS errors FROM events GROUP BY ROLLUP (event_type)")
def rollup_calls(t):
    return aggregates.api_calls(t("events").select("event_type", (F.col("value") > 40).alias("failed")), "event_type")


@query("SELECT event_id, TRY_CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def json_extract(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
WITH g AS (SELECT event_type, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
SELECT event_id, round(coalesce(greatest(0, 61 - gap), 0), 6)::DOUBLE AS wait_s FROM g""")
def quota_gate(t):
    """How long each call should have waited to keep 61 seconds from the one before."""
    return windows.call_gaps(t("events"), ["event_type"]).select("event_id", F.round("wait_s", 6).alias("wait_s"))


@query("""
SELECT user_id, count(*) AS events, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean,
  count(DISTINCT event_type) = 1 AND count(*) FILTER (value <= 40) = count(*) AS stable FROM events GROUP BY user_id""")
def percentile_rates(t):
    e = t("events")
    some = e.groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))
    stable = aggregates.stability(e, "user_id", "event_type", F.col("value") <= 40)
    return some.join(stable.select("user_id", "stable"), "user_id")


@query("""
SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def type_percentiles(t):
    """Percentiles of a few types that hold all events, by ranks over running counts."""
    out = aggregates.exact_percentiles(t("events"), ["event_type"], "value", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p05", "median", "p95")])


@query("""
SELECT event_id, CASE WHEN value >= 30 AND value / 50 >= 0.05 AND value / 50 < 1 THEN CAST(round(value / (value / 50) * (1 - value / 50)) AS BIGINT) END AS eta,
  greatest(0, least(1, value / 50 - 0.2))::DOUBLE AS clamped, round(value * 100) / 100 AS rounded FROM events""")
def progress_eta(t):
    v = F.col("value")
    return t("events").select("event_id", N.eta_seconds(v / 50, v, F.lit(1)).alias("eta"), N.clamp(v / 50 - 0.2, 0.0, 1.0).alias("clamped"), N.round_to(v, 2).alias("rounded"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, coalesce(value, 0)::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, v AS used, 0::BIGINT AS part FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN r.used + e.v > 120 THEN e.v ELSE r.used + e.v END, r.part + (r.used + e.v > 120)::BIGINT FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, part FROM r""")
def pack_duration(t):
    """Each user's events packed next-fit into parts of 120 seconds."""
    return packing.next_fit(t("events").select("user_id", "event_id", "value"), "user_id", "value", 120.0, "event_id").select("user_id", "event_id", "part")


_ADMITTED = """
WITH RECURSIVE e AS (SELECT event_type AS key, event_id, epoch_us(ts) AS us, floor(value)::BIGINT AS tokens, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT key, 0::BIGINT AS n, 0::BIGINT AS event_id, '' AS reason, []::STRUCT(a BIGINT, t BIGINT)[] AS kept, -1::BIGINT AS day, 0::BIGINT AS used FROM e
  UNION ALL SELECT key, n, event_id, why, CASE WHEN why = '' THEN list_append(live, {'a': us, 't': tokens}) ELSE live END, day, used + (why = '')::BIGINT FROM (
    SELECT *, CASE WHEN used >= 40 THEN 'day' WHEN len(live) >= 2 THEN 'minute' WHEN coalesce(list_sum(list_transform(live, lambda x: x.t)), 0) + tokens > 100 THEN 'tokens' ELSE '' END AS why FROM (
      SELECT e.key, e.n, e.event_id, e.us, e.tokens, list_filter(r.kept, lambda x: x.a > e.us - 60000000) AS live, e.us // 86400000000 AS day, CASE WHEN e.us // 86400000000 = r.day THEN r.used ELSE 0 END AS used
      FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)))
SELECT key, event_id, reason = '' AS admitted, reason FROM r WHERE n > 0"""


@query(_ADMITTED)
def admission(t):
    """Which events of each type a limit of two a minute, a hundred tokens a minute and forty a day admits."""
    e = t("events").select(F.col("event_type").alias("key"), "event_id", "ts", F.floor("value").alias("tokens"))
    return quota.admitted_batch(e, per_minute=2, tokens_per_minute=100, per_day=40)


@query(_ADMITTED)
def admission_stream(t):
    """The same decisions by the limiter of a stream, which the events run through to its end."""
    e = t("events").select(F.col("event_type").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.floor("value").alias("tokens"), F.lit("request").alias("kind"))
    ends = e.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(F.lit(None).cast("string").alias("key"), F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(0).cast("long").alias("tokens"), F.lit("release").alias("kind"))
    out = quota.streamed(e.unionByName(ends), lambda stream: limiter.limited(stream, per_minute=2, tokens_per_minute=100, per_day=40))
    return out.where("key is not null").select("key", "event_id", "admitted", "reason")


@query("""
WITH e AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS part FROM events),
p AS (SELECT user_id, part, count(*) FILTER (event_id % 61 = 5 OR event_id % 73 = 7) AS lacks FROM e GROUP BY 1, 2)
SELECT user_id::VARCHAR AS course, part::BIGINT AS part FROM (SELECT *, sum(lacks) OVER (PARTITION BY user_id ORDER BY part) AS so_far FROM p) WHERE so_far = 0""")
def course_parts(t):
    """Users' events as items of courses, four a part: transcribed, then compressed, some of either missing, as two streams."""
    e = t("events").select(F.col("user_id").cast("string").alias("course"), F.col("event_id").alias("item"), F.col("ts").cast("timestamp").alias("ts"), "value")
    plan = windows.row_batches(e.select("course", "item"), 4, ["course"], ["item"]).withColumnRenamed("batch", "part")
    transcripts = e.select("course", "item", "ts", F.when(F.col("item") % 61 == 5, "no audio").alias("error"))
    done = e.where("item % 73 <> 7").select("course", "item", (F.col("ts") + F.expr("interval 5 minutes")).alias("ts"), F.lit("").alias("error"))
    return quota.streamed([transcripts, done], lambda a, b: stages.exported_parts(a, b, plan, "1 hour", "1 day"))


@query("""
WITH e AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'context canceled' WHEN 1 THEN 'Post: context deadline exceeded' WHEN 2 THEN 'too many Requests' WHEN 3 THEN 'connection refused' WHEN 4 THEN 'Temporarily unavailable'
  WHEN 5 THEN '' WHEN 6 THEN 'i/o timeout' ELSE 'HTTP ' || (400 + event_id % 120) END AS error FROM events)
SELECT event_id, CASE WHEN error = '' THEN NULL WHEN event_id % 9 < 2 THEN 'cancelled' WHEN regexp_matches(lower(error), '429|too many requests|rate limit|500|502|503|504|timeout|temporarily unavailable') THEN 'transient' ELSE 'permanent' END AS kind FROM e""")
def failure_kinds(t):
    """Made-up errors of calls by kind."""
    i = F.col("event_id")
    said = ["context canceled", "Post: context deadline exceeded", "too many Requests", "connection refused", "Temporarily unavailable", "", "i/o timeout"]
    error = F.coalesce(*[F.when(i % 9 == k, text) for k, text in enumerate(said)], F.concat(F.lit("HTTP "), (400 + i % 120).cast("string")))
    return t("events").select("event_id", T.failure_kind(error).alias("kind"))


@query("""
SELECT event_type, (ts::DATE)::VARCHAR AS day, count(*) AS items, count(*) FILTER (value > 10) AS completed, count(*) FILTER (value <= 2) AS failed,
 CASE WHEN count(*) FILTER (value > 10 OR value <= 2) < count(*) THEN 'running' WHEN count(*) FILTER (value <= 2) = 0 THEN 'completed' WHEN count(*) FILTER (value > 10) = 0 THEN 'failed' ELSE 'partial_failed' END AS status,
 (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY 1, 2""")
def batch_outcomes(t):
    v = F.col("value")
    e = t("events").select(F.concat_ws("|", "event_type", F.to_date("ts").cast("string")).alias("batch_id"), F.when(v > 10, "completed").when(v <= 2, "failed").otherwise("queued").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"))
    out = aggregates.batch_outcome(e)
    return out.select(F.split_part("batch_id", F.lit("|"), F.lit(1)).alias("event_type"), F.split_part("batch_id", F.lit("|"), F.lit(2)).alias("day"), "items", "completed", "failed", "status", "seconds")
