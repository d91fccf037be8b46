"""Numbers, progress, durations and quotas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without a time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null when whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def round_to(x: Column, places: int) -> Column:
    """x rounded by scaling in binary floating point, half away from zero."""
    return F.round(x * 10.0**places) / 10.0**places


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent of part in whole, 0 for nothing, within 0 and 100."""
    return F.when(whole <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.round(part * 100.0 / whole)))).cast("long")


def request_tokens(n_bytes: Column, max_tokens: Column) -> Column:
    """Tokens to reserve: a third of the bytes, and room for the output: max_tokens, or from 4096 or 15 % of the input."""
    given = F.greatest(F.lit(1), F.ceil(n_bytes / 3)).cast("long")
    reserve = F.when(max_tokens < 4096, F.greatest(F.lit(4096), F.floor(given * 15 / 100))).otherwise(max_tokens)
    return (given + reserve).cast("long")


def token_cost(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Price of a call, prices being per million tokens."""
    return (input_tokens * input_price + output_tokens * output_price) / 1e6


def eta_seconds(progress: Column, elapsed_s: Column, steps: Column) -> Column:
    """Seconds left by extrapolation; null before 30 s, one step or 5 %, and when done."""
    enough = (elapsed_s >= 30) & (steps >= 1) & (progress >= 0.05) & (progress < 1)
    return F.when(enough, F.round(elapsed_s / progress * (1 - progress)).cast("long"))


def progress_update(mode: Column, total: Column, done: Column, started: Column, ends: Column, created: Column, now: Column) -> Column:
    """struct<mode, completed_units, total_units, progress> of a job after an update.

    Determinate with a total over 0: the units done, within 0 and the total, and their share. Timed with an end after the
    start (else the job's creation, else now): the share of the time gone, within 0 and 1, and no units. Everything else is
    indeterminate with nothing done.
    """
    begin = F.coalesce(started, created, now)
    units = F.greatest(F.lit(0), F.least(done, total)).cast("long")
    none = F.lit(0).cast("long")
    span = (micros(ends) - micros(begin)).cast("double")
    share = clamp((micros(now) - micros(begin)) / span, 0.0, 1.0)
    as_ = lambda kind, done, total, share: F.struct(F.lit(kind).alias("mode"), done.alias("completed_units"), total.alias("total_units"), share.alias("progress"))
    return (
        F.when((mode == "determinate") & (total > 0), as_("determinate", units, total.cast("long"), units / total))
        .when((mode == "timed") & (ends > begin), as_("timed", none, none, share))
        .otherwise(as_("indeterminate", none, none, F.lit(0.0)))
    )


def duration_text(seconds: Column) -> Column:
    """``1h 2m``, ``2m 3s`` or ``3s``."""
    s = F.greatest(F.lit(0), F.round(seconds)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def duration_close(expected_s: Column, actual_s: Column) -> Column:
    """Whether two durations agree within 120 s or 0.5 %."""
    return F.abs(expected_s - actual_s) <= F.greatest(F.lit(120.0), expected_s * 0.005)


def score_number(value: Column, low: float, high: float, places: int = 0) -> Column:
    """A score read from text: rounded half away from zero and clamped; null if it isn't a finite number."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), clamp(round_to(x, places), low, high))


def in_range(x: Column, low: float = 0, high: float = 1000) -> Column:
    """Whether x is finite and within range; null counts as out of it."""
    return F.coalesce(x.between(low, high) & ~F.isnan(x.cast("double")), F.lit(False))


def page_limit(asked: int | None, default: int, most: int) -> int:
    """A list limit: the default for none or less than one, and no more than the maximum."""
    return default if asked is None or asked <= 0 else min(asked, most)


#: Default and largest list limits, fixed values.
LIMITS = {"jobs": (20, 200), "reviews": (30, 200), "copies": (80, 500), "batches": (10, 100)}


def tile_boxes(width: Column, height: Column, share: float = 0.42) -> Column:
    """array<struct<row, col, x0, y0, x1, y1>>: nine overlapping tiles of ``share`` of each side, rounded up: at the start, the middle (rounded down) and the end."""
    side = lambda full: F.least(full, F.ceil(full * share)).cast("long")
    at = lambda full, k: F.floor((full - side(full)) * k / 2).cast("long")
    tiles = [
        F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), at(width, c).alias("x0"), at(height, r).alias("y0"), (at(width, c) + side(width)).alias("x1"), (at(height, r) + side(height)).alias("y1"))
        for r in range(3)
        for c in range(3)
    ]
    return F.array(*tiles)
