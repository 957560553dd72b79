"""What several operators share: the shared work folder, hot-key joins, word patterns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temploom.sources.store import scratch

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds at least this share of all rows; so at most 1/HOT_SHARE keys are, which bounds what is broadcast.
HOT_SHARE = 1 / 1000


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder of the session."""
    return scratch(spark, "llm")


def parts_for(df: DataFrame, part_bytes: int = 64_000_000) -> int:
    """Partitions of an exchange whose parts each meet one task: they follow the input's size as Spark estimates it from its files."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return max(least, -(-size // part_bytes)) if size < 1 << 56 else least  # more: a source that can't tell


def written(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors and is computed once."""
    path = f"{base or work_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, n_rows: int, how: str = "left") -> DataFrame:
    """rows joined with keyed (one row a key, ``count`` its number of rows) on key: hot keys by broadcast, the others by shuffle.

    The hot side has at most 1 / HOT_SHARE rows whatever the data, so its broadcast is bounded; no shuffled key then holds more than
    HOT_SHARE of the rows.
    """
    least = max(2.0, n_rows * HOT_SHARE)
    hot = F.broadcast(keyed.filter(F.col(count) >= least))
    marks = F.broadcast(keyed.filter(F.col(count) >= least).select(F.col(key).alias("_hot")))
    first = rows.join(hot, key, "inner")
    rest = rows.join(marks, rows[key] == F.col("_hot"), "left_anti").join(keyed.filter(F.col(count) < least), key, how)
    return first.unionByName(rest)
