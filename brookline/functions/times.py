"""Timestamps as milliseconds since 1970, and durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.functions.jmespath import Value, is_number

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
#: strftime letters and the patterns that stand for them; fixed values.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "I": "hh", "p": "a", "f": "SSSSSS", "z": "xx", "Z": "VV", "%": "%"}
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: str) -> int:
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text.strip())
    if not m:
        raise ValueError(f"{text!r} is not a duration such as 500ms, 30s, 5m, 1h, 1d")
    return int(m[1]) * _UNITS[m[2]]


def pattern(strftime: str) -> str:
    """A strftime format as a Spark pattern."""
    out, literal = "", ""
    for piece in re.findall(r"%.|[^%]", strftime.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S")):
        if piece[0] == "%" and len(piece) == 2:
            if piece[1] not in STRFTIME:
                raise ValueError(f"{piece} in {strftime!r} is not supported")
            out += (f"'{literal}'" if literal else "") + STRFTIME[piece[1]]
            literal = ""
        elif piece.isalpha():
            literal += piece
        else:
            out += (f"'{literal}'" if literal else "") + ("''" if piece == "'" else piece)
            literal = ""
    return out + (f"'{literal}'" if literal else "")


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def rfc3339_ms(s: Column) -> Column:
    return F.when(s.rlike(RFC3339), _ms(F.try_to_timestamp(F.upper(s))))


def event_ms(v: Value, fmt: str | None = None) -> Column:
    """Timestamps as they are, strings by the format, or else as RFC 3339."""
    if isinstance(v.t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return _ms(v.c)
    if not isinstance(v.t, T.StringType):
        return F.lit(None).cast("long")
    return _ms(F.try_to_timestamp(v.c, F.lit(pattern(fmt)))) if fmt else rfc3339_ms(v.c)


def window_ms(v: Value, fmt: str | None = None) -> Column:
    """As event_ms, and also whole numbers (fractions are dropped) and number strings (kept to the millisecond); over 10^12 they are milliseconds, else seconds."""
    scaled = lambda n: F.when(n > 1_000_000_000_000, n).otherwise(n * 1000)
    if is_number(v.t):
        return scaled(v.c.cast("long"))
    if not isinstance(v.t, T.StringType):
        return event_ms(v)
    first = [event_ms(v, fmt)] if fmt else []
    whole = F.when(v.c.rlike(r"^[+-]?\d+$"), scaled(v.c.try_cast("long")))
    part = F.when(v.c.rlike(r"^[+-]?\d*\.\d+$|^[+-]?\d+\.$"), (v.c.try_cast("double") * 1000).cast("long"))
    return F.coalesce(*first, rfc3339_ms(v.c), whole, part)


def rfc3339(ms: Column) -> Column:
    """Text of milliseconds with +00:00; a fraction only where there is one."""
    ts = F.timestamp_millis(ms)
    return F.when(F.pmod(ms, F.lit(1000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx"))
