"""Opening hours as minutes since midnight."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAYS

_OPEN, _CLOSE = r"(\d+):(\d+)-", r"-(\d+):(\d+)"


def _minutes(text: Column, pattern: str) -> Column:
    hour, minute = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
    return hour * 60 + minute


def open_minutes(text: Column) -> Column:
    """`9:0-17:30` to 540; text without that shape to NULL."""
    return _minutes(text, _OPEN)


def close_minutes(text: Column) -> Column:
    return _minutes(text, _CLOSE)


def day_columns(day: str) -> tuple[str, str]:
    return f"{day}_open_mins", f"{day}_close_mins"


def pack_hours() -> Column:
    """The 14 minute columns as one array, Monday's opening first."""
    return F.array(*[F.col(c) for d in DAYS for c in day_columns(d)])


def open_at(opens: Column, closes: Column, prev_opens: Column, prev_closes: Column, minutes: Column) -> Column:
    """Open on the day itself (closing later, or past midnight), or still open from the day before.
    The closing minute is outside; equal times mean open all day; missing hours mean not known open."""
    today = (opens <= minutes) & ((closes > minutes) | (closes <= opens))
    carried_over = (prev_closes <= prev_opens) & (prev_closes > minutes)
    return F.coalesce(today, F.lit(False)) | F.coalesce(carried_over, F.lit(False))


def packed_open_at(hours: Column, day: Column, minutes: Column) -> Column:
    """`open_at` over a packed array, for a day index that is itself a column."""
    before = (day + 6) % 7
    return open_at(
        F.get(hours, day * 2), F.get(hours, day * 2 + 1),
        F.get(hours, before * 2), F.get(hours, before * 2 + 1), minutes,
    )
