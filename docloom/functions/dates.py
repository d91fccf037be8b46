"""Schedules, retry delays and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Layouts of a local time that a schedule may have, fixed list in order.
LOCAL = ["yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss"]
MOST_RETRY_S = 120


def scheduled_at(value: Column, zone: str = "Asia/Kolkata") -> Column:
    """The instant of a time with an offset, or of a local time in ``zone``; null for anything else."""
    v = T.trim_ws(T.or_blank(value))
    with_offset = F.when(v.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), v.try_cast("timestamp"))
    local = F.coalesce(*[F.when(F.length(v) == len(layout.replace("'", "")), F.try_to_timestamp(v, F.lit(layout))) for layout in LOCAL])
    return F.coalesce(with_offset, F.to_utc_timestamp(local, zone))


#: Seconds of a duration's units, fixed values.
UNIT_S = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ns": 1e-9}


def duration_seconds(value: Column) -> Column:
    """Seconds of a duration such as ``1m30s``, ``500ms`` or ``1.5h``, with a sign or none; null for anything else."""
    v, number, unit = T.trim_ws(T.or_blank(value)), r"(\d+\.?\d*|\.\d+)", "(ns|us|µs|μs|ms|s|m|h)"
    amounts, units = (F.regexp_extract_all(v, F.lit(number + unit), F.lit(k)) for k in (1, 2))
    seconds = F.create_map(*[F.lit(x) for pair in UNIT_S.items() for x in pair])
    total = F.aggregate(F.zip_with(amounts, units, lambda n, u: n.cast("double") * F.try_element_at(seconds, u)), F.lit(0.0), lambda s, x: s + x)
    return F.when(v.rlike("^[+-]?0$"), F.lit(0.0)).when(v.rlike(f"^[+-]?({number}{unit})+$"), F.when(v.startswith("-"), -total).otherwise(total))


def retry_delay(status: Column, retry_after: Column, body: Column, attempt: Column, now: Column, most: int = MOST_RETRY_S) -> Column:
    """Seconds to wait before another try; null if the status isn't worth one.

    The header comes first (seconds or a date), then the delay in the JSON body, then a minute for 429 and 2^attempt seconds
    for server errors; no more than ``most``, but for the plain minute.
    """
    header = T.trim_ws(T.or_blank(retry_after))
    when = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    asked = F.coalesce(F.when(header.rlike(r"^\d+$"), header.try_cast("double")), F.when(when.isNotNull(), F.greatest(F.lit(0.0), when.cast("double") - now.cast("timestamp").cast("double"))))
    details = F.from_json(body, "error struct<details: array<struct<retryDelay: string>>>")["error"]["details"]
    delays = F.filter(F.transform(details, lambda d: duration_seconds(d["retryDelay"])), lambda d: d >= 0)
    told = F.coalesce(asked, F.get(delays, F.lit(0)))
    other = F.when(status == 429, F.lit(60.0)).otherwise(F.least(F.lit(float(most)), F.pow(F.lit(2.0), attempt)))
    return F.when(status.isin(429, 500, 502, 503, 504), F.coalesce(F.when(told.isNotNull(), F.least(F.lit(float(most)), told)), other))


def query_link(base: str, **values: Column) -> Column:
    """A link with URL-encoded query values."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(T.or_blank(v))) for k, v in values.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))


def data_bytes(value: Column) -> Column:
    """Bytes of a base64 text or data URL; null if it isn't one."""
    return F.try_to_binary(F.regexp_replace(T.trim_ws(T.or_blank(value)), r"^data:[^,]*;base64,", ""), F.lit("base64"))
