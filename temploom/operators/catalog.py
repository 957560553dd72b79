"""Filters, orders and line formats of a catalog."""
from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temploom.errors import InvalidConfig
from temploom.functions.expr import csv_escape
from temploom.operators.mine import with_rates
from temploom.operators.numbering import numbered

CSV_HEADER = "id,size,rate_per_min,template,created_at,updated_at,event_first_seen,event_last_seen,event_rate_per_min,members,suffix"
SORTS = {
    "size": [F.desc, "size"], "template": [F.asc, "template"], "id": [F.asc, "id"], "rate": [F.desc, "lines_per_minute"],
}


def min_size(catalog: DataFrame, n: int) -> DataFrame:
    return catalog.filter(F.col("size") >= n)


def ordered(catalog: DataFrame, by: str = "size") -> DataFrame:
    """size and rate descend, template and id ascend; id breaks ties."""
    if by not in SORTS:
        raise InvalidConfig(f"unknown sort {by!r}")
    way, name = SORTS[by]
    return with_rates(catalog).orderBy(way(name), "id")


def placed(catalog: DataFrame, by: str = "size") -> DataFrame:
    """The catalog with each row's number in the order of ``ordered`` as place. Rows are persisted, as they are read three times."""
    if by not in SORTS:
        raise InvalidConfig(f"unknown sort {by!r}")
    way, name = SORTS[by]
    key = F.negative(F.col(name)) if way is F.desc else F.col(name)
    return numbered(with_rates(catalog).persist(), [key, F.col("id")] if name != "id" else [key], "place")


def cluster_by_id(catalog: DataFrame, cluster_id: int) -> DataFrame:
    return catalog.filter(F.col("id") == cluster_id)


def size_of(catalog: DataFrame) -> int:
    """Number of templates."""
    return catalog.count()


def is_empty(catalog: DataFrame) -> bool:
    return catalog.isEmpty()


def compression(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("templates"), F.coalesce(F.sum("size"), F.lit(0)).alias("lines"), (F.sum("size") / F.count(F.lit(1))).alias("ratio"))


def json_lines(catalog: DataFrame) -> DataFrame:
    """One JSON object per cluster, keys in alphabetical order, nulls written."""
    c = with_rates(catalog)
    obj = F.struct(
        F.col("created_ms").alias("createdAt"), F.col("event_first_ms").alias("eventFirstSeen"), F.col("event_last_ms").alias("eventLastSeen"), F.col("event_lines_per_minute").alias("eventRatePerMinute"), "id",
        F.col("lines_per_minute").alias("linesPerMinute"), F.coalesce("members", F.array().cast("array<string>")).alias("members"), "size", "suffix", "template", F.col("updated_ms").alias("updatedAt"),
    )
    return c.select("id", F.to_json(obj, {"ignoreNullFields": "false"}).alias("line"))


def csv_lines(catalog: DataFrame) -> DataFrame:
    """CSV records without the header; rates with one decimal, unset values empty."""
    c = with_rates(catalog)
    s = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    rate = lambda x: F.coalesce(F.format_string("%.1f", F.col(x)), F.lit(""))
    event_rate = F.when(F.col("event_lines_per_minute").isNull(), F.lit("")).otherwise(rate("event_lines_per_minute"))
    cols = [s("id"), s("size"), rate("lines_per_minute"), csv_escape(F.col("template")), s("created_ms"), s("updated_ms"), s("event_first_ms"), s("event_last_ms"), event_rate, csv_escape(F.coalesce(F.array_join("members", ";"), F.lit(""))), csv_escape(F.coalesce("suffix", F.lit("")))]
    return c.select("id", F.concat_ws(",", *cols).alias("line"))


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Write formatted lines in id order as text, on the cluster."""
    out = lines.orderBy("id").select("line")
    if header is not None:
        out = lines.sparkSession.createDataFrame([(header,)], "line string").coalesce(1).unionAll(out)
    out.write.mode("overwrite").text(path)


def _object(r) -> dict:
    return {"createdAt": r.created_ms, "eventFirstSeen": r.event_first_ms, "eventLastSeen": r.event_last_ms, "eventRatePerMinute": r.event_lines_per_minute, "id": r.id, "linesPerMinute": r.lines_per_minute, "members": list(r.members or []), "size": r.size, "suffix": r.suffix, "template": r.template, "updatedAt": r.updated_ms}


def _json_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place and the lines of each object within the array that ``render`` writes, without the comma after it."""
    for b in batches:
        rows = [SimpleNamespace(**r) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r.place for r in rows], pa.int64()), pa.array([["  " + x for x in json.dumps(_object(r), indent=2, ensure_ascii=False).split("\n")] for r in rows], pa.list_(pa.string()))], ["place", "lines"])


def page(catalog: DataFrame, fmt: str = "text", by: str = "size") -> DataFrame:
    """Rows n, line: what ``render`` gives for text and json, cut at line feeds, made by the cluster. A template holds no line feed."""
    p = placed(catalog, by)
    spark, row = catalog.sparkSession, "n long, line string"
    if fmt == "json":
        blocks = p.select("place", "id", "size", "template", "created_ms", "updated_ms", "event_first_ms", "event_last_ms", "lines_per_minute", "event_lines_per_minute", "members", "suffix").mapInArrow(_json_blocks, "place long, lines array<string>").persist()
        size = blocks.agg(F.max("place"), F.sum(F.size("lines"))).head()
        if not size[0]:
            return spark.createDataFrame([(0, "[]")], row)
        last = F.col("pos") == F.size("lines") - 1
        lines = blocks.select("place", "lines", F.posexplode("lines").alias("pos", "line")).select("place", "pos", F.when(last & (F.col("place") < size[0]), F.concat("line", F.lit(","))).otherwise(F.col("line")).alias("line"))
        return numbered(lines, [F.col("place"), F.col("pos")], "n").select("n", "line").unionByName(spark.createDataFrame([(0, "["), (size[1] + 1, "]")], row))
    if fmt != "text":
        raise InvalidConfig(f"no page of format {fmt!r}")
    wide = p.agg(F.count(F.lit(1)), F.max(F.length(F.col("id").cast("string"))), F.max(F.length(F.col("size").cast("string"))), F.max((F.col("lines_per_minute") > 0) | (F.coalesce("event_lines_per_minute", F.lit(0.0)) > 0))).head()
    wi, ws, rated = max(2, wide[1] or 0), max(4, wide[2] or 0), bool(wide[3])
    right = lambda c, w: F.format_string(f"%{w}s", c)
    rate = [F.format_string("%8s", F.format_string("%.1f", F.coalesce("event_lines_per_minute", "lines_per_minute")))] if rated else []
    body = p.select(F.col("place").alias("n"), F.concat_ws("  ", right(F.col("id"), wi), right(F.col("size"), ws), *rate, "template").alias("line"))
    head = f"{'ID':>{wi}}  {'SIZE':>{ws}}  " + ("RATE/MIN  " if rated else "") + "TEMPLATE"
    return body.unionByName(spark.createDataFrame([(0, head), (wide[0] + 1, "")], row))


def render(catalog: DataFrame, fmt: str = "text", by: str = "size") -> str:
    """The whole catalog as one string for a terminal: it has a row per template, which the driver is taken to hold.

    Catalogs beyond that go through ``page`` or ``write_lines``.
    """
    rows = ordered(catalog, by).collect()
    if fmt == "json":
        return json.dumps([_object(r) for r in rows], indent=2, ensure_ascii=False)
    if fmt in ("jsonl", "ndjson"):
        return "".join(json.dumps(_object(r), separators=(",", ":"), ensure_ascii=False) + "\n" for r in rows)
    if fmt == "csv":
        q = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') else x
        v = lambda x: "" if x is None else str(x)
        body = [",".join([str(r.id), str(r.size), f"{r.lines_per_minute:.1f}", q(r.template), v(r.created_ms), v(r.updated_ms), v(r.event_first_ms), v(r.event_last_ms), "" if r.event_lines_per_minute is None else f"{r.event_lines_per_minute:.1f}", q(";".join(r.members or [])), q(r.suffix or "")]) for r in rows]
        return "\n".join([CSV_HEADER, *body]) + "\n"
    if fmt != "text":
        raise InvalidConfig(f"unknown format {fmt!r}")
    wi, ws = max([2, *(len(str(r.id)) for r in rows)]), max([4, *(len(str(r.size)) for r in rows)])
    rated = any(r.lines_per_minute > 0 or (r.event_lines_per_minute or 0) > 0 for r in rows)
    rate = lambda r: f"{r.event_lines_per_minute if r.event_lines_per_minute is not None else r.lines_per_minute:.1f}"
    head = f"{'ID':>{wi}}  {'SIZE':>{ws}}  " + ("RATE/MIN  " if rated else "") + "TEMPLATE"
    return "\n".join([head, *(f"{r.id:>{wi}}  {r.size:>{ws}}  " + (f"{rate(r):>8}  " if rated else "") + r.template for r in rows)]) + "\n"
