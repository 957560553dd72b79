"""Dot-path extraction from JSON records; objects only, arrays can't be indexed."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _reject(_: str) -> None:
    raise ValueError


def extract_value(line: str | None, path: list[str]) -> str | None:
    """The value as text: strings bare, other values as compact JSON with sorted keys; null, absent or malformed gives None."""
    try:
        cur = json.loads(line, parse_constant=_reject) if line is not None else None
    except (ValueError, RecursionError):
        return None
    for key in path:
        if not isinstance(cur, dict) or key not in cur:
            return None
        cur = cur[key]
    if cur is None or isinstance(cur, str):
        return cur
    return json.dumps(cur, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def extract_field(col: Column, path: str, exact: bool = True) -> Column:
    """exact: strict JSON in an Arrow-batched UDF. Otherwise native ``get_json_object``, which is lenient with malformed lines."""
    keys = path.split(".")
    if not exact:
        return F.get_json_object(col, "$" + "".join(f"['{k}']" for k in keys))

    @F.pandas_udf("string")
    def strict(s: pd.Series) -> pd.Series:
        return s.map(lambda x: extract_value(x, keys), na_action="ignore")

    return strict(col)
