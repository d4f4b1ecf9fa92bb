"""Text to time, as Column expressions only. Times of day are long microseconds since midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_SECONDS = 86_400
DAY_MICROS = DAY_SECONDS * 1_000_000

# Accepted date and datetime spellings, in the order they are tried.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy")
DATETIME_FORMATS = ("yyyy/M/d H:m:s", "d/M/yyyy H:m:s", "M/d/yyyy H:m:s", "yyyy-M-d H:m", "yyyy/M/d H:m")
# First instants after the accepted epoch range (the year 2100), per unit.
EPOCH_LIMITS = {"s": 4_102_444_800, "ms": 4_102_444_800_000, "us": 4_102_444_800_000_000, "ns": 4_102_444_800_000_000_000}

ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,9})?$"
ZONED_SHAPE = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
OTHER_SHAPE = r"^\d{1,4}[/-]\d{1,2}[/-]\d{1,4} \d{1,2}:\d{1,2}(:\d{1,2})?$"
DATE_SHAPE = r"^\d{1,4}[/-]\d{1,2}[/-]\d{1,4}$"
CLOCK_SHAPE = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d+))?)?$"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def micros_of_day(value: Column, allow_hm: bool = False) -> Column:
    """`HH:MM:SS[.f]` (optionally `HH:MM`) to microseconds since midnight; NULL when it is no time.

    The fraction is scaled by its digit count; digits past the sixth are cut.
    """
    part = lambda i: F.regexp_extract(value, CLOCK_SHAPE, i)
    hour, minute = _int(part(1)), _int(part(2))
    second = F.when(part(3) == "", F.lit(0)).otherwise(_int(part(3)))
    fraction = F.rpad(F.substring(part(4), 1, 6), 6, "0").try_cast("long")
    ok = value.rlike(CLOCK_SHAPE) & (hour < 24) & (minute < 60) & (second < 60)
    if not allow_hm:
        ok = ok & (part(3) != "")
    total = (hour * 3600 + minute * 60 + second).cast("long") * 1_000_000
    return F.when(ok, total + F.coalesce(fraction, F.lit(0)))


def clock_text(micros: Column, digits: int = 0) -> Column:
    """Microseconds since midnight as `HH:MM:SS` with a fixed number of fraction digits (0 to 6)."""
    seconds = F.floor(micros / 1_000_000).cast("long")
    text = F.format_string(
        "%02d:%02d:%02d", F.floor(seconds / 3600).cast("long"), F.floor(seconds / 60).cast("long") % 60, seconds % 60
    )
    if digits:
        text = F.concat(text, F.lit("."), F.substring(F.format_string("%06d", micros % 1_000_000), 1, digits))
    return F.when(micros.isNotNull(), text)


def _in_order(formats, order: str | None):
    """The formats of one order of day and month (`dmy` or `mdy`), years first included; all of them without an order."""
    other = {"dmy": "M", "mdy": "d"}.get(order)
    return [f for f in formats if f[0] != other]


def parse_datetime(value: Column, order: str | None = None) -> Column:
    """The accepted datetime spellings to TIMESTAMP_NTZ, else NULL. Uses the real calendar."""
    # One look at the shape decides which parser runs at all.
    return F.when(value.rlike(ISO_SHAPE), value.try_cast("timestamp_ntz")).when(
        value.rlike(OTHER_SHAPE), F.coalesce(*[_try_ntz(value, f) for f in _in_order(DATETIME_FORMATS, order)])
    )


def parse_instant(value: Column, order: str | None = None) -> Column:
    """Like `parse_datetime`, and also an ISO text with a zone, moved to UTC."""
    zoned = F.to_utc_timestamp(value.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return F.when(value.rlike(ZONED_SHAPE), zoned).otherwise(parse_datetime(value, order))


def parse_date(value: Column, order: str | None = None) -> Column:
    tries = [_try_ntz(value, f).cast("date") for f in _in_order(DATE_FORMATS, order)]
    return F.when(value.rlike(DATE_SHAPE), F.coalesce(*tries))


def _try_ntz(value: Column, fmt: str) -> Column:
    return F.try_to_timestamp(value, F.lit(fmt)).cast("timestamp_ntz")


def parse_seconds(value: Column) -> Column:
    """Any time text to whole seconds: integer epoch, datetime (seconds since 1970), time of day (since midnight)."""
    text = F.trim(value)
    epoch = F.when(text.rlike(r"^[+-]?\d{1,19}$"), text).try_cast("long")
    instant = F.floor(ntz_micros(parse_instant(text)) / 1_000_000).cast("long")
    clock = F.floor(micros_of_day(text, allow_hm=True) / 1_000_000).cast("long")
    return F.coalesce(epoch, instant, clock)


def parse_micros(value: Column) -> Column:
    """Like `parse_seconds`, in microseconds: fractions of a second are kept, and an epoch whose microseconds leave 64 bits is NULL."""
    text = F.trim(value)
    epoch = F.try_multiply(F.when(text.rlike(r"^[+-]?\d{1,19}$"), text).try_cast("long"), F.lit(1_000_000).cast("long"))
    return F.coalesce(epoch, ntz_micros(parse_instant(text)), micros_of_day(text, allow_hm=True))


def micros_of(column: Column, data_type: T.DataType) -> Column:
    """Microseconds of a typed or text time column."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(data_type, T.TimestampNTZType):
        return ntz_micros(column)
    if isinstance(data_type, T.StringType):
        return parse_micros(column)
    return seconds_of(column, data_type) * 1_000_000


def ntz_micros(value: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), value)


def seconds_of(column: Column, data_type: T.DataType) -> Column:
    """Whole seconds of a typed or text time column."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_seconds(column)
    if isinstance(data_type, T.TimestampNTZType):
        return F.floor(ntz_micros(column) / 1_000_000).cast("long")
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("long") * DAY_SECONDS
    if isinstance(data_type, T.StringType):
        return parse_seconds(column)
    if isinstance(data_type, T.IntegralType):
        return column.cast("long")
    raise ValueError(f"not a time column: {data_type.simpleString()}")


def duration_seconds(text: str | int) -> int:
    """An interval given as seconds, `MM:SS` or `HH:MM:SS`."""
    parts = [int(p) for p in str(text).strip().split(":")]
    if not 1 <= len(parts) <= 3 or any(p < 0 for p in parts):
        raise ValueError(f"not an interval: {text!r}")
    seconds = 0
    for p in parts:
        seconds = seconds * 60 + p
    return seconds


def boundary_seconds(text: str | int) -> int:
    """A time of day given as seconds since midnight, `HH:MM` or `HH:MM:SS`."""
    parts = str(text).strip().split(":")
    if len(parts) == 2:
        parts.append("0")
    return duration_seconds(":".join(parts))


def fraction_digits(value: Column) -> Column:
    return F.length(F.regexp_extract(value, CLOCK_SHAPE, 4))


def pad_fraction(value: Column, digits: int) -> Column:
    """Pad a time text to `digits` fraction digits; anything that is no time stays as it is."""
    if digits <= 0:
        return value
    head = F.regexp_extract(value, r"^([^.]*)", 1)
    return F.when(
        micros_of_day(value).isNotNull(),
        F.concat(head, F.lit("."), F.rpad(F.regexp_extract(value, CLOCK_SHAPE, 4), digits, "0")),
    ).otherwise(value)
