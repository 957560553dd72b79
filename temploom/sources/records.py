"""Readers and record assembly: everything ends as RECORDS (source, seq, record)."""
from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from temploom.errors import InvalidConfig

_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "\\": "\\"}


def unescape(s: str) -> str:
    """``\\n \\r \\t \\0 \\\\`` to their characters; other escapes and a last lone backslash stay."""
    out, i = [], 0
    while i < len(s):
        if s[i] == "\\" and i + 1 < len(s) and s[i + 1] in _ESCAPES:
            out.append(_ESCAPES[s[i + 1]])
            i += 2
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def _numbered(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """Records of each path in argument order. seq: the path's ordinal in the high bits, the record's place in its file below.

    Each file is read by one task (``wholetext`` isn't used; splits are switched off by a large ``maxPartitionBytes`` at read time in
    the caller's session), so the place in the partition follows the order in the file.
    """
    parts = []
    for k, path in enumerate(paths):
        df = spark.read.option("lineSep", sep).text(path)
        df = df.select(F.lit(path).alias("source"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"), F.col("value").alias("record"))
        parts.append(df.withColumn("_k", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # A split's block start orders splits of a file; inside a split the running id follows the reader.
    counts = out.groupBy("_k", "_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_k", "_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return out.join(offsets, ["_k", "_f", "_b"]).select("source", (F.col("_off") + F.col("_m") - F.col("_first")).alias("seq"), "record")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One physical line per record; one carriage return before the line feed is stripped. Bytes that aren't UTF-8 are an error."""
    df = _numbered(spark, paths, "\n")
    line = F.when(F.is_valid_utf8("record"), F.col("record")).otherwise(F.raise_error(F.lit("a line is not valid UTF-8")))
    return df.withColumn("record", F.regexp_replace(line, r"\r\z", ""))


def read_separated(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    """Records between occurrences of a literal separator (escapes allowed). Bytes that aren't UTF-8 become U+FFFD."""
    sep = unescape(separator)
    if not sep:
        raise InvalidConfig("the record separator is empty")
    return _numbered(spark, paths, sep).withColumn("record", F.make_valid_utf8("record"))


#: Lines are counted in ranges of so many seq values, so that a large source isn't one task.
RANGE = 100_000


def assemble_multiline(lines: DataFrame, start: str) -> DataFrame:
    """Join lines to records: a line matching ``start`` opens one; leading empty lines of a record without an opener are dropped.

    A line's record is the number of openers up to it: those of the ranges before, by prefix sums over one row a range, and those of its
    own range. So no task sorts more than a range of a source's lines, or one record.
    """
    from temploom.functions.masks import java_pattern

    upto = lambda *keys: Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select("source", "seq", "record").withColumn("_open", F.col("record").rlike(java_pattern(start))).withColumn("_range", F.floor(F.col("seq") / RANGE))
    counts = rows.groupBy("source", "_range").agg(F.count_if("_open").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    g = rows.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    g = g.withColumn("_g", F.col("_before") + F.sum(F.col("_open").cast("long")).over(upto("source", "_range")))
    g = g.withColumn("_text", F.max(((F.col("record") != "") | F.col("_open")).cast("int")).over(upto("source", "_g"))).filter(F.col("_text") == 1)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "record"))), lambda x: x["record"]), "\n")
    return g.groupBy("source", "_g").agg(F.min("seq").alias("seq"), joined.alias("record")).select("source", "seq", "record")


def read_records(spark: SparkSession, paths: list[str], *, separator: str | None = None, multiline_start: str | None = None) -> DataFrame:
    """Route by strategy: separator, else multi-line, else lines. No paths: the driver's stdin."""
    if separator is not None and multiline_start is not None:
        raise InvalidConfig("a record separator and a multi-line start exclude each other")
    if not paths:
        data = sys.stdin.read()
        sep = unescape(separator) if separator is not None else "\n"
        rows = data.split(sep)
        rows = rows[:-1] if rows and rows[-1] == "" else rows
        df = spark.createDataFrame([("stdin", i, r.removesuffix("\r") if separator is None else r) for i, r in enumerate(rows)], "source string, seq long, record string")
    elif separator is not None:
        return read_separated(spark, paths, separator)
    else:
        df = read_lines(spark, paths)
    return assemble_multiline(df, multiline_start) if multiline_start is not None else df


def drop_blank(df: DataFrame, col: str = "record") -> DataFrame:
    return df.filter(~is_blank(F.col(col)))


def is_blank(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*\z")
