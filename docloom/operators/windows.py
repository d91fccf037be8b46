"""Gaps and islands, repaired intervals, trailing quotas and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.sources.shared import materialize

#: Subtitle limits in milliseconds, fixed values.
LEAST_MS, MOST_MS = 1_000, 120_000


def boundary(value: Column) -> Column:
    low = F.lower(T.trim_ws(T.or_blank(value)))
    return F.when(low.isin("new", "continuation"), low).otherwise("uncertain")


def merge_islands(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Questions of each document: every continuation block joins the block before.

    ``blocks``: doc, pos, label, title, text, source_pages, status, boundary, confidence. A first block that is a
    continuation becomes uncertain. The merged confidence is the least, the title the first that isn't blank, texts are
    joined by a blank line, and a merged question needs review if a part does, is uncertain or is below 0.7.
    """
    turn = Window.partitionBy(doc).orderBy("pos")
    made = blocks.withColumn("boundary", boundary(F.col("boundary"))).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    starts = (F.col("boundary") != "continuation") | (F.row_number().over(turn) == 1)
    made = made.withColumn("starts", starts).withColumn("island", F.sum(F.col("starts").cast("long")).over(turn))
    made = made.withColumn("boundary", F.when(F.col("starts") & (F.col("boundary") == "continuation"), "uncertain").otherwise(F.col("boundary")))
    doubt = (F.col("status") == "needs review") | (F.col("confidence") < 0.7) | (F.col("starts") & (F.col("boundary") == "uncertain"))
    part = F.struct("pos", "label", "title", "text", "source_pages", "status", "boundary", doubt.alias("doubt"))
    parts = made.groupBy(doc, "island").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("confidence").alias("confidence"))
    head = F.col("parts")[0]
    titles = F.filter(F.transform("parts", lambda p: p["title"]), lambda t: t != "")
    return parts.select(
        doc,
        "island",
        head["label"].alias("label"),
        F.coalesce(F.get(titles, F.lit(0)), F.lit("")).alias("title"),
        T.trim_ws(F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")).alias("text"),
        F.array_distinct(F.flatten(F.transform("parts", lambda p: p["source_pages"]))).alias("source_pages"),
        F.when(F.exists("parts", lambda p: p["doubt"]), "needs review").otherwise(head["status"]).alias("status"),
        head["boundary"].alias("boundary"),
        "confidence",
    )


def unique_suffix(rows: DataFrame, base: str, scope: list[str], *order: Column, joint: str = "-") -> DataFrame:
    """Rows with ``unique_id``: the base, and for its n-th occurrence in scope ``-n``."""
    n = F.row_number().over(Window.partitionBy(*scope, base).orderBy(*order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(joint), n.cast("string"))))


def repair_intervals(blocks: DataFrame, file: str = "file") -> DataFrame:
    """Subtitle blocks (file, start_ms, end_ms, text) in order, none empty, overlapping the next or over two minutes.

    In turn: an end not after its start moves a second past it; an end past the next start moves to a millisecond before;
    a block over two minutes is cut; and the first rule again.
    """
    turn = Window.partitionBy(file).orderBy("start_ms", "end_ms", "text")
    start, following = F.col("start_ms"), F.lead("start_ms").over(turn)
    at_least = lambda end: F.when(end <= start, start + LEAST_MS).otherwise(end)
    clipped = F.when((following > start) & (F.col("end_ms") > following), following - 1).otherwise(F.col("end_ms"))
    return (
        blocks.withColumn("end_ms", at_least(F.col("end_ms")))
        .withColumn("end_ms", clipped)
        .withColumn("end_ms", F.when(F.col("end_ms") - start > MOST_MS, start + MOST_MS).otherwise(F.col("end_ms")))
        .withColumn("end_ms", at_least(F.col("end_ms")))
    )


def offset_segments(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """One numbered sequence of the blocks of many files. ``items``: item, file, duration_ms (null: unknown).

    A file lasts for the longer of its duration and its last block; each block moves by the lasts of the files before.
    Items without ``item`` are numbered from 1 in order of file. The blocks are computed once; files and blocks are summed
    part by part, in no single window.
    """
    blocks, order = materialize(blocks.select("file", "start_ms", "end_ms", "text")), "item" if "item" in items.columns else "file"
    ends = blocks.groupBy("file").agg(F.max("end_ms").alias("last_ms"), F.count("*").alias("n"))
    lasts = items.join(ends, "file", "left").select(*items.columns, F.greatest(F.coalesce("duration_ms", F.lit(0)), F.coalesce("last_ms", F.lit(0))).alias("lasts"), F.coalesce("n", F.lit(0)).alias("n"))
    plan = before_each(lasts, [], [order], offset_ms=F.col("lasts"), before=F.col("n"), index=F.lit(1).cast("long"))
    plan = plan.select((F.col("item") if order == "item" else F.col("index") + 1).alias("item"), "file", "offset_ms", "before")
    own = before_each(blocks, ["file"], ["start_ms", "end_ms", "text"], own=F.lit(1).cast("long"))
    return own.join(plan, "file").select(
        "item", (F.col("before") + F.col("own") + 1).alias("number"), (F.col("start_ms") + F.col("offset_ms")).alias("start_ms"), (F.col("end_ms") + F.col("offset_ms")).alias("end_ms"), "text"
    )


def in_slices(events: DataFrame, at: Column, reach_us: int) -> DataFrame:
    """``events`` with ``_slice``, a time slice, and ``_own``: events of a slice's last ``reach_us`` also come, not own, in the next.

    A window that looks back no further than ``reach_us`` is so computed inside slices, and a key with most of the
    events is spread over time.
    """
    length = 8 * reach_us
    own = F.floor(at / length).cast("long")
    both = F.when(at >= (own + 1) * length - reach_us, F.array(own, own + 1)).otherwise(F.array(own))
    return events.withColumn("_slice", F.explode(both)).withColumn("_own", F.col("_slice").eqNullSafe(own))


def trailing_usage(events: DataFrame, keys: list[str], seconds: int = 60, ts: str = "ts", tokens: str = "tokens") -> DataFrame:
    """Events with requests and tokens of their key in the ``seconds`` up to and with each; the window's start is open.

    An event enters its slice and, if still within it, leaves ``seconds`` later as a row of its own; running sums over
    both, leavers first, are what the window holds. Time doesn't grow with the events of a window. Only tokens of floating
    point, which don't subtract exactly, are added up window by window.
    """
    at, reach = N.micros(F.col(ts)), seconds * 1_000_000
    leaves = F.floor((at + reach) / (8 * reach)).cast("long") == F.col("_slice")
    turns = in_slices(events, at, reach).withColumn("_turn", F.explode(F.when(leaves, F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(1)))))
    turns = turns.withColumn("_at", at + F.when(F.col("_turn") < 0, reach).otherwise(0))
    held = Window.partitionBy(*keys, "_slice").orderBy("_at", "_turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    signed = lambda x: F.sum(F.when(F.col("_turn") < 0, -x).otherwise(x)).over(held)
    known = F.col(tokens).isNotNull().cast("long")
    if events.select(tokens).dtypes[0][1] in ("float", "double"):
        span = Window.partitionBy(*keys, "_slice", "_turn").orderBy("_at").rangeBetween(1 - reach, Window.currentRow)
        total = F.sum(tokens).over(span)
    else:
        total = F.when(signed(known) > 0, signed(F.col(tokens)))
    out = turns.withColumn("window_requests", signed(F.lit(1).cast("long"))).withColumn("window_tokens", total)
    return out.where("_own and _turn > 0").drop("_slice", "_own", "_turn", "_at")


def daily_usage(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, day, requests): requests of each UTC day."""
    return events.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("requests"))


def recent(events: DataFrame, now: Column, hours: int = 25, ts: str = "ts") -> DataFrame:
    return events.where(N.micros(F.col(ts)) > N.micros(now) - hours * 3_600_000_000)


def token_wait(events: DataFrame, reserved: int, limit: int, now: Column, keys: list[str], headroom_s: int = 1) -> DataFrame:
    """(keys, wait_s): when a reservation fits: after the earliest event whose leaving makes room, plus a second.

    Events of the last minute leave in their order. A reservation over the limit never fits and waits out the minute.
    """
    live = events.where((F.col("ts") > now - F.expr("interval 60 seconds")) & (F.col("ts") <= now))
    line = Window.partitionBy(*keys).orderBy("ts", "tokens").rowsBetween(Window.currentRow + 1, Window.unboundedFollowing)
    left = F.coalesce(F.sum("tokens").over(line), F.lit(0))
    made = live.withColumn("fits", left + reserved <= limit)
    total = made.groupBy(*keys).agg(F.sum("tokens").alias("now_tokens"), F.min(F.when(F.col("fits"), F.col("ts"))).alias("free_at"))
    wait = (N.micros(F.coalesce("free_at", now)) + (60 + headroom_s) * 1_000_000 - N.micros(now)) / 1e6
    return total.select(*keys, F.when(F.col("now_tokens") + reserved <= limit, F.lit(0.0)).otherwise(wait).alias("wait_s"))


def page_chunks(n_pages: Column, size: int = 4, step: int = 2) -> Column:
    """array<struct<first, last>>: overlapping page windows that cover 1 to n; none for no page."""
    starts = F.sequence(F.lit(1), F.greatest(n_pages - (size - step), F.lit(1)), F.lit(step))
    chunks = F.transform(starts, lambda s: F.struct(s.cast("long").alias("first"), F.least(s + size - 1, n_pages).cast("long").alias("last")))
    return F.when(n_pages > 0, chunks).otherwise(F.array().cast("array<struct<first: long, last: long>>"))


def round_robin(targets: DataFrame, turn: int, scope: list[str]) -> DataFrame:
    """Targets with ``place``: in each run of equal priority the order is rotated by ``turn``."""
    run = Window.partitionBy(*scope, "priority")
    n = F.count("*").over(run)
    at = F.pmod(F.row_number().over(run.orderBy("pos")) - 1 - F.lit(turn), n)
    placed = targets.withColumn("turn", at)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy("priority", "turn")).cast("long")).drop("turn")


def call_gaps(calls: DataFrame, keys: list[str], spacing_s: int = 61) -> DataFrame:
    """Calls with ``wait_s``: how long each should have waited to keep the spacing after the one before of its key."""
    at = N.micros(F.col("ts"))
    before = F.lag("ts").over(Window.partitionBy(*keys, "_slice").orderBy("ts", "event_id"))
    gap = (at - N.micros(before)) / 1e6
    out = in_slices(calls, at, spacing_s * 1_000_000).withColumn("wait_s", F.coalesce(F.greatest(F.lit(0.0), spacing_s - gap), F.lit(0.0)))
    return out.where("_own").drop("_slice", "_own")


def before_each(rows: DataFrame, scope: list[str], order: list[str], **values: Column) -> DataFrame:
    """Rows with the sum of each of ``values`` over the rows before it in its scope, 0 for the first.

    Rows are dealt by ranges of scope and order to parts; the parts' sums are summed first, and each part then adds its
    own rows. A scope with most of the rows is so spread over many parts. ``order`` must tell a scope's rows apart.
    """
    cut = rows.withColumns({f"_{n}": v for n, v in values.items()})
    cut = materialize(cut.repartitionByRange(*scope, *order).withColumn("_part", F.spark_partition_id()))
    sums = cut.groupBy(*scope, "_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in values])
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda n, w: F.coalesce(F.sum(f"_{n}").over(w), F.lit(0))
    parts = sums.select(*[F.col(c).alias(f"_of_{c}") for c in scope], F.col("_part").alias("_of_part"), *[earlier(n, upto(*scope).orderBy("_part")).alias(f"_to_{n}") for n in values])
    here = cut.withColumns({n: earlier(n, upto(*scope, "_part").orderBy(*order)) for n in values})
    same = F.col("_part") == F.col("_of_part")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return here.join(parts, same).select(*rows.columns, *[(F.col(n) + F.col(f"_to_{n}")).alias(n) for n in values])


def running_units(items: DataFrame, course: str = "course") -> DataFrame:
    """Items with ``units``, the whole seconds of each, and ``units_before`` of those before it in its course."""
    units = F.greatest(F.lit(1), F.ceil(F.coalesce("duration_s", F.lit(0.0)))).cast("long")
    return before_each(items.withColumn("units", units), [course], ["pos"], units_before=F.col("units"))


def row_batches(rows: DataFrame, size: int, scope: list[str], order: list[str]) -> DataFrame:
    """Rows with ``batch``: consecutive runs of ``size`` rows within scope, in ``order``, which must tell them apart."""
    return before_each(rows, scope, order, batch=F.lit(1).cast("long")).withColumn("batch", F.floor(F.col("batch") / size).cast("long"))
