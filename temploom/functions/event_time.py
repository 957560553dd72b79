"""Event timestamps to unix milliseconds, natively."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from temploom.errors import InvalidConfig

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})\z"
_JAVA = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "h": "MMM", "B": "MMMM", "z": "xx", "y": "yy", "e": "d", "j": "DDD", "I": "hh", "p": "a", "a": "EEE", "A": "EEEE", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm"}
_FIELDS = {"Y": "d", "m": "d", "d": "d", "b": "d", "B": "d", "h": "d", "y": "d", "e": "d", "j": "d", "F": "D", "D": "D", "H": "t", "I": "t", "M": "t", "T": "T", "R": "T"}


def scale_epoch(n: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds by magnitude; negative gives null."""
    return (
        F.when(n < 0, None)
        .when(n < 100_000_000_000, n * 1000)
        .when(n < 100_000_000_000_000, n)
        .when(n < 100_000_000_000_000_000, F.call_function("div", n, F.lit(1000)))
        .otherwise(F.call_function("div", n, F.lit(1_000_000)))
    )


def java_format(strftime: str) -> str:
    """A Spark datetime pattern for a strftime one; formats without a full date and an hour and minute are rejected."""
    out, i, have = [], 0, ""
    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            i += 1
            key = strftime[i]
            if key == ":" and strftime[i : i + 2] == ":z":
                out.append("xxx")
                i += 1
            elif key == "%":
                out.append("%")
            elif key == "." and strftime[i + 1 : i + 2] == "f":
                out.append("[.SSSSSSSSS][.SSSSSS][.SSS]")
                i += 1
            elif key in _JAVA:
                out.append(_JAVA[key])
                have += _FIELDS.get(key, "")
            else:
                raise InvalidConfig(f"unsupported time format specifier %{key}")
        else:
            out.append("''" if c == "'" else f"'{c}'" if c.isalpha() else c)
        i += 1
    if not ("D" in have or have.count("d") >= 3 or "j" in strftime) or not ("T" in have or have.count("t") >= 2):
        raise InvalidConfig("a time format needs a date and a time of day")
    return "".join(out)


def parse_event_ms(col: Column, time_format: str | None = None) -> Column:
    """Unix milliseconds or null: by the format if there is one (zoneless means UTC), else an epoch integer, else RFC 3339."""
    v = F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")
    epoch = v.try_cast("bigint")
    whole = F.when(v.rlike(r"^[+-]?\d+\z"), epoch)
    if time_format == "%s":
        return F.when(whole >= 0, whole * 1000)
    if time_format:
        ms = F.unix_millis(F.try_to_timestamp(v, F.lit(java_format(time_format))))
        return F.when(ms >= 0, ms)
    ms = F.unix_millis(F.when(v.rlike(_RFC3339), F.upper(v).try_cast("timestamp")))
    return F.when(whole.isNotNull(), scale_epoch(whole)).otherwise(F.when(ms >= 0, ms))
