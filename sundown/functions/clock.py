"""Trusted-clock rules over RFC-3339 texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sundown.functions.checks import first_code
from sundown.vocabulary import FUTURE_SKEW_SECONDS, SOURCE_SKEW_SECONDS

# Fixed value: date, time and a zone; a time without zone is no trusted time.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def trusted_time(text: Column) -> Column:
    """The timestamp, or null when the text is invalid or names no zone."""
    spaced = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(RFC3339), F.replace(spaced, F.lit(","), F.lit(".")).try_cast("timestamp"))


def untrusted(text: Column) -> Column:
    return text.isNotNull() & trusted_time(text).isNull()


def clock_checks(
    now: Column,
    observed: Column | None = None,
    last: Column | None = None,
    source: Column | None = None,
    expires: Column | None = None,
    expired_code: str = "EVIDENCE_RECEIPT_EXPIRED",
) -> list[tuple[Column, str]]:
    """Failure conditions over timestamp columns, in order: rollback, future, skew, expiry; null times pass."""
    checks: list[tuple[Column, str]] = []
    if last is not None:
        checks.append((now < last, "RUNTIME_CLOCK_ROLLBACK"))
    if observed is not None:
        checks.append((observed > now + F.make_dt_interval(secs=F.lit(FUTURE_SKEW_SECONDS)), "RUNTIME_CLOCK_FUTURE"))
    if source is not None:
        apart = F.abs(F.unix_micros(source) - F.unix_micros(now))
        checks.append((apart > SOURCE_SKEW_SECONDS * 1_000_000, "RUNTIME_CLOCK_SKEW"))
    if expires is not None:
        checks.append((now >= expires, expired_code))
    return [(F.coalesce(condition, F.lit(False)), code) for condition, code in checks]


def text_clock_checks(
    now: Column, observed: str, expires: str, last: Column | None = None, expired_code: str = "EVIDENCE_RECEIPT_EXPIRED"
) -> list[tuple[Column, str]]:
    """The same over text columns; an unreadable one fails first, a missing expiry never expires."""
    unreadable = F.col(observed).isNull() | untrusted(F.col(observed)) | untrusted(F.col(expires))
    return [
        (unreadable, "RUNTIME_CLOCK_INVALID"),
        *clock_checks(now, trusted_time(F.col(observed)), last, None, trusted_time(F.col(expires)), expired_code),
    ]


def clock_code(now: Column, observed: Column, last: Column, source: Column, expires: Column) -> Column:
    """First failing clock rule of four text columns, or null."""
    unreadable = untrusted(observed) | untrusted(last) | untrusted(source) | untrusted(expires)
    return first_code(
        [
            (unreadable, "RUNTIME_CLOCK_INVALID"),
            *clock_checks(now, trusted_time(observed), trusted_time(last), trusted_time(source), trusted_time(expires)),
        ]
    )
