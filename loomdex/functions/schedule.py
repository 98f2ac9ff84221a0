"""Retry, backoff and rate arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG


def retry_delay_ms(attempt: Column, delays: list[int] | None = None, zero_based: bool = False) -> Column:
    """Delay before attempt n: the n-th delay, the last one beyond the list.

    ``zero_based=True`` indexes the list with the attempt itself, so that the first retry waits the second delay.
    """
    delays = delays or CONFIG.retry_delays_ms
    at = F.least(F.greatest(attempt + (1 if zero_based else 0), F.lit(1)), F.lit(len(delays)))
    return F.element_at(F.array(*[F.lit(d).cast("long") for d in delays]), at.cast("int"))


def backoff_ms(attempt: Column, rate_limited: Column, base_ms: int = 1000, max_ms: int = 10_000) -> Column:
    """Wait after failed try n: base * 2^(n-1), a doubled base for rate-limit errors, at most ``max_ms``."""
    base = F.when(rate_limited, F.lit(2 * base_ms)).otherwise(F.lit(base_ms))
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(float(max_ms))).cast("long")


def is_dead_link(error: Column) -> Column:
    return error.rlike("404|Not Found|410|Gone|503|Service Unavailable")


def is_rate_limit_error(status: Column, message: Column) -> Column:
    return F.coalesce(status.isin(429, 503, 504), F.lit(False)) | F.coalesce(F.lower(message).rlike("too many requests|rate limit|429|service unavailable"), F.lit(False))


def error_route(error: Column, source: Column, attempt: Column, max_attempts: Column) -> Column:
    """Struct (action, next_attempt): dead, retry or drop.

    Dead links are dropped for good; a first failure becomes attempt 1; a retry goes on until its
    ``max_attempts`` (3 if null) are used up.
    """
    most = F.coalesce(F.nullif(max_attempts, F.lit(0)), F.lit(CONFIG.max_retries))
    tried = F.coalesce(attempt, F.lit(1))
    again = (source == "retry") & (tried < most)
    first = F.coalesce(source != "retry", F.lit(True))
    action = F.when(is_dead_link(error), "dead").when(first | again, "retry").otherwise("drop")
    return F.struct(action.alias("action"), F.when(action == "retry", F.when(first, F.lit(1)).otherwise(tried + 1)).cast("int").alias("next_attempt"))


def render_workers(queued: Column, most: int = 2) -> Column:
    """Workers wanted for a render queue: one for each twenty jobs, at most ``most``."""
    return F.least(F.lit(most), F.ceil(queued / 20)).cast("int")
