"""Column types of text tables: null tokens, inference, typed conversion, validation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colforge.functions.timeparse import (
    CLOCK_SHAPE,
    DATE_SHAPE,
    EPOCH_LIMITS,
    ISO_SHAPE,
    OTHER_SHAPE,
    ZONED_SHAPE,
    fraction_digits,
    micros_of_day,
    pad_fraction,
    parse_date,
    parse_instant,
)

# Cell texts that mean "no value" (case is ignored) and the accepted booleans.
NULL_TOKENS = ("", "NULL", "N/A", "-")
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")

# Unit words in headers, longest unit name first, and how many units make a second.
UNIT_WORDS = {
    "ns": ("ns", "nsec", "nanoseconds"),
    "us": ("us", "μs", "µs", "usec", "microseconds"),
    "ms": ("ms", "msec", "milliseconds"),
    "s": ("s", "sec", "seconds"),
}
PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}

TYPES = ("integer", "real", "text", "boolean", "date", "datetime", "time_s", "time_ms", "time_us", "time_ns", "blob")
SIMPLE_TYPES = ("integer", "real", "text")
SPARK_TYPES = {
    "integer": "bigint", "real": "double", "text": "string", "boolean": "boolean", "date": "date",
    "datetime": "timestamp_ntz", "time_s": "bigint", "time_ms": "bigint", "time_us": "bigint", "time_ns": "bigint", "blob": "binary",
}

# SQL names accepted when a table is declared; anything else is text.
SQL_NAMES = {
    "INTEGER": "integer", "INT": "integer", "BIGINT": "integer", "REAL": "real", "DOUBLE": "real", "FLOAT": "real",
    "BOOLEAN": "boolean", "BOOL": "boolean", "TEXT": "text", "VARCHAR": "text", "STRING": "text", "TIMESTAMP": "datetime",
}

FIRST_LOOK = 1000
# Day first is the reading of a column in which both fit every cell.
ORDERS = ("dmy", "mdy")

_INTEGER = r"^[+-]?\d{1,19}$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_WORD_NUMBER = r"(?i)^[+-]?(inf|infinity|nan)$"


def blank_nulls(value: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """NULL instead of any null token."""
    wanted = sorted({t.strip().lower() for t in tokens})
    return F.when(~F.lower(F.trim(value)).isin(wanted), value) if wanted else value


def _integer(value):
    return F.when(value.rlike(_INTEGER), value).try_cast("bigint")


def _real(value):
    word = F.regexp_replace(value, r"(?i)inf(inity)?$", "Infinity")
    return F.when(value.rlike(_NUMBER), value.try_cast("double")).when(value.rlike(_WORD_NUMBER), word.try_cast("double"))


def _boolean(value):
    word = F.lower(value)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def convert(value: Column, kind: str, order: str | None = None) -> Column:
    """The text as a typed value; NULL when it is no such value. `order` is that of day and month, `dmy` or `mdy`.

    Times become microseconds since midnight. A whole number counts as seconds in a datetime column and
    as the column's own unit in a time column.
    """
    text = F.trim(value)
    if kind == "integer":
        return _integer(text)
    if kind == "real":
        return _real(text)
    if kind == "boolean":
        return _boolean(text)
    if kind == "date":
        return parse_date(text, order)
    if kind == "datetime":
        return F.coalesce(parse_instant(text, order), F.timestamp_seconds(_integer(text)).cast("timestamp_ntz"))
    if kind.startswith("time_"):
        per_second = PER_SECOND[kind[5:]]
        number = _integer(text)
        micros = number * (1_000_000 // per_second) if per_second <= 1_000_000 else F.floor(number / (per_second // 1_000_000)).cast("long")
        in_range = (number >= 0) & (number < EPOCH_LIMITS[kind[5:]])
        return F.coalesce(micros_of_day(text), F.when(in_range, micros))
    if kind == "blob":
        return value.cast("binary")
    if kind == "text":
        return value
    raise ValueError(f"unknown type {kind!r}; one of {TYPES}")


def can_parse(value: Column, kind: str) -> Column:
    """True when the text is a value of the type. Whole numbers in the epoch range count as datetimes."""
    if kind in ("text", "blob"):
        return F.lit(True)
    if kind == "datetime":
        number = _integer(F.trim(value))
        return convert(value, kind).isNotNull() & (number.isNull() | ((number >= 0) & (number < EPOCH_LIMITS["ms"])))
    return convert(value, kind).isNotNull()


def header_unit(name: str) -> str | None:
    """The time unit a header names, as a word of its own: `duration (ms)` yes, `section` no."""
    words = set(re.findall(r"[a-zµμ]+", name.lower()))
    bracketed = set(re.findall(r"\(\s*([a-zµμ]+)\s*\)", name.lower()))
    for unit, names in UNIT_WORDS.items():
        # A bare letter such as s or ms is a unit only in brackets.
        if bracketed & set(names) or words & {n for n in names if len(n) > 2}:
            return unit
    return None


@dataclass(frozen=True)
class ColumnType:
    """`order`: how all days and months of a date column are ordered, where its cells show it."""

    kind: str
    digits: int = 0
    order: str | None = None


def infer_types(
    df: DataFrame, headers: Sequence[str] | None = None, kinds: Sequence[str] = TYPES, declared: dict[str, str] | None = None
) -> dict[str, ColumnType]:
    """Types of text columns whose null tokens are already NULL.

    First match wins: boolean, integer, real, datetime, date, time, text. A unit in the header turns a
    whole-number column that fits the unit into a time column.

    The shapes of the first rows rule out most types of most columns; one aggregate over `df` then tests
    only what is left.

    `declared` names columns of `df` that are `date` or `datetime` whatever their cells; the same aggregate finds the order
    of day and month that reads all their dates. A column with dates of both orders is refused.
    """
    declared = declared or {}
    units = [header_unit(h) for h in (headers or df.columns)]
    head = df.take(FIRST_LOOK) if len(declared) < len(df.columns) else []
    possible = [
        [] if c in declared else _possible([r[i].strip(" ") for r in head if r[i] is not None], u) for i, (c, u) in enumerate(zip(df.columns, units))
    ]
    row = _facts(df, units, possible, declared)
    names = dict(zip(df.columns, headers or df.columns))
    return {
        c: _declared_order(names[c], declared[c], row[i].asDict()) if c in declared else _decide(row[i].asDict(), units[i], kinds)
        for i, c in enumerate(df.columns)
    }


def _declared_order(name: str, kind: str, fact: dict) -> ColumnType:
    fit = [o for o in ORDERS if fact[f"{kind}_{o}"] is not False]
    if not fit:
        raise ValueError(f"column {name!r} has dates with the day first and others with the month first; declare ColumnType({kind!r}, order=...)")
    return ColumnType(kind, order=fit[0])


def _possible(values: list[str], unit: str | None) -> list[str]:
    """Types whose shape all the values have. A shape is needed by its type but does not prove it."""
    words = {*TRUE_WORDS, *FALSE_WORDS}
    shapes = {
        "boolean": lambda v: v.lower() in words,
        "integer": lambda v: re.match(_INTEGER, v),
        "real": lambda v: re.match(_NUMBER, v) or re.match(_WORD_NUMBER, v),
        "datetime": lambda v: re.match(ISO_SHAPE, v) or re.match(ZONED_SHAPE, v) or re.match(OTHER_SHAPE, v),
        "date": lambda v: re.match(DATE_SHAPE, v),
        "time": lambda v: re.match(CLOCK_SHAPE, v),
    }
    if unit:
        shapes["unit"] = lambda v: re.match(_INTEGER, v) or re.match(CLOCK_SHAPE, v)
    return [k for k, fits in shapes.items() if all(fits(v) for v in values)]


def _test(text: Column, kind: str, unit: str | None) -> Column:
    if kind == "unit":
        return can_parse(text, f"time_{unit}")
    if kind == "time":
        return micros_of_day(text).isNotNull()
    if kind == "datetime":
        return parse_instant(text).isNotNull()
    return convert(text, kind).isNotNull()


def _facts(df: DataFrame, units, possible, declared):
    """Per column: filled cells, fraction digits, and for each type still possible whether all cells have it."""
    facts = []
    for i, c in enumerate(df.columns):
        value = F.col(f"`{c}`")
        text = F.trim(value)
        fields = [F.count(value).alias("n")]
        if "time" in possible[i]:
            fields.append(F.max(fraction_digits(text)).alias("digits"))
        fields += [
            F.coalesce(F.bool_and(F.when(value.isNotNull(), _test(text, k, units[i]))), F.lit(True)).alias(k) for k in possible[i]
        ]
        # Do all cells agree on one order of day and month?
        parsers = {"date": parse_date, "datetime": parse_instant}
        fields += [F.bool_and(F.when(value.isNotNull(), parsers[k](text, order).isNotNull())).alias(f"{k}_{order}") for k in parsers if k in possible[i] for order in ORDERS]
        if c in declared:  # cells that are no date in any order do not count
            read = parsers[declared[c]]
            fields += [F.bool_and(F.when(read(text).isNotNull(), read(text, order).isNotNull())).alias(f"{declared[c]}_{order}") for order in ORDERS]
        facts.append(F.struct(*fields).alias(f"c{i}"))
    return df.agg(*facts).first()


def _decide(fact, unit, kinds) -> ColumnType:
    if not fact["n"]:
        return ColumnType("text")
    digits = fact.get("digits") or 0
    if unit and fact.get("unit") and f"time_{unit}" in kinds:
        return ColumnType(f"time_{unit}", digits)
    for kind in ("boolean", "integer", "real", "datetime", "date"):
        if kind in kinds and fact.get(kind):
            return ColumnType(kind, order=next((o for o in ORDERS if fact.get(f"{kind}_{o}")), None))
    if fact.get("time") and "time_s" in kinds:
        return ColumnType("time_s" if digits == 0 else "time_ms" if digits <= 3 else "time_us" if digits <= 6 else "time_ns", digits)
    return ColumnType("text")


def invalid_values(
    df: DataFrame, column: str, kind: str, tokens: Sequence[str] = NULL_TOKENS, n: int = 5, *, order_by: Sequence[str] | None = None
) -> DataFrame:
    """The first `n` rows whose text is no value of the chosen type (none: the type fits), with their place.

    `order_by` gives the order, by default the place columns of a file where `df` has them.
    """
    value = blank_nulls(F.col(column), tokens)
    order = list(order_by) if order_by else [c for c in ("__file", "__block", "__line") if c in df.columns]
    bad = df.filter(value.isNotNull() & ~can_parse(value, kind))
    return bad.orderBy(*order).limit(n) if order else bad.limit(n)


def max_fraction_digits(df: DataFrame, column: str) -> int:
    return df.agg(F.max(fraction_digits(F.trim(F.col(column))))).first()[0] or 0


def pad_times(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    """Pad all times of a text column to the longest fraction found in it."""
    digits = max_fraction_digits(df, column) if digits is None else digits
    return df.withColumn(column, pad_fraction(F.trim(F.col(column)), digits))
