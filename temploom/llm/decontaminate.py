"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are lower-cased (A-Z) runs outside ASCII punctuation and space. Of the k-gram hashes inside each window of ``window`` words the
minimum is the window's fingerprint, on both sides. Equal windows have equal fingerprints, so joining fingerprints misses no shared span
of ``window`` words or more. A hit is then extended: every document window with that fingerprint is compared word for word with the
benchmark's windows, and overlapping hits unite to spans. An item of fewer than ``window`` words, but not none, is one window of its own
length; fingerprints of those lengths (at most window - 1 of them, read from the benchmark) are made as well.

Up to ``in_plan`` fingerprints of the benchmark are part of the plan as a set of constants, and documents are filtered by them inside
their own rows, first by their k-grams and then by their windows' minima. More are joined by a shuffle of (row key, fingerprint) alone, and what joins goes back to its documents by the row key;
in both cases windows are cut only for fingerprints that the benchmark has. The benchmark's windows are broadcast while they take at
most ``broadcast_bytes``, measured; else that join shuffles too.

Nulls: a null text has no words; a null doc_id is a value of its own; a null item_id is not listed but its windows hit. Rows with equal
doc_id and text merge in the grouping and are given back as often as they came. Empty benchmark: n_hit 0 everywhere. Empty documents: no
rows. Ties of the minimum don't matter, as the value and not the place is the fingerprint.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temploom.llm.common import work_dir, written

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Null gives an empty array. Split, at a third of what regexp_extract_all takes with these classes."""
    return F.coalesce(F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda x: x != ""), F.array().cast("array<string>"))


def window_minima(w: Column, length: int, k: int, known: list[int] | None = None) -> Column:
    """Fingerprint of each window of ``length`` words, in order; empty for shorter texts.

    With known, also empty if no k-gram's hash is among those: then no window's minimum is.
    """
    k = min(k, length)
    span = length - k + 1
    n = F.size(w)

    def seq(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))

    grams = F.transform(seq(n - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    if span == 1:
        return grams

    def minima(h: Column) -> Column:
        every = F.transform(seq(n - (length - 1)), lambda i: F.array_min(F.slice(h, i, span)))
        return every if known is None else F.when(F.exists(h, lambda x: x.isin(known)), every).otherwise(F.array().cast("array<bigint>"))

    return _let(grams, minima)


def _windows(w: Column, minima: Column, fp: Column, length: int) -> Column:
    """The windows with fingerprint fp: start (from 1) and text."""
    at = F.filter(F.transform(minima, lambda m, i: F.when(m == fp, i + 1)), lambda x: x.isNotNull())
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.array_join(F.slice(w, i, length), " ").alias("window")))


def benchmark_windows(benchmark: DataFrame, window: int, k: int) -> tuple[DataFrame, list[int]]:
    """Distinct windows (length, fp, window, items) and the lengths that occur."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("length", F.least(F.size("w"), F.lit(window)))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``window`` values
    parts = []
    for length in lengths:
        own = items.filter(F.col("length") == length)
        m = _let(F.col("w"), lambda w: F.transform(window_minima(w, length, k), lambda fp, i: F.struct(fp.alias("fp"), F.array_join(F.slice(w, i + 1, length), " ").alias("window"))))  # noqa: B023
        parts.append(own.select("item_id", F.lit(length).alias("length"), F.explode(m).alias("x")).select("item_id", "length", "x.fp", "x.window"))
    if not parts:
        return benchmark.sparkSession.createDataFrame([], "length int, fp long, window string, items array<string>"), []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("length", "fp", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items")), lengths


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, in_plan: int = 20_000, broadcast_bytes: int = 16_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted array), spans (array of start, end in words from 0), contaminated."""
    base = work_dir(docs.sparkSession)
    bench, lengths = benchmark_windows(benchmark, window, k)
    bench = written(bench, "windows", base)
    prints = bench.select("length", "fp").distinct()
    few = prints.limit(in_plan + 1).collect()
    small = len(few) <= in_plan
    takes = bench.agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("items", ",")) + 64)).head()[0] or 0
    side = F.broadcast if takes <= broadcast_bytes else lambda x: x

    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.coalesce(F.length("text"), F.lit(-1)).alias("_l"), words(F.col("text")).alias("w"))
    known: dict[int, list[int]] = {}
    for r in few if small else []:
        known.setdefault(r.length, []).append(r.fp)
    minima = F.array(*[F.struct(F.lit(n).alias("length"), window_minima(F.col("w"), n, k, known.get(n, []) if small else None).alias("m")) for n in lengths]) if lengths else F.array().cast("array<struct<length:int,m:array<bigint>>>")
    rows = rows.withColumn("mins", minima)
    def entries() -> Column:
        """Distinct (length, fp) of the row, of those known if they are in the plan."""
        parts = []
        for i, n in enumerate(lengths):
            m = F.array_distinct(F.get(F.col("mins"), F.lit(i))["m"])
            m = F.filter(m, lambda fp: fp.isin(known.get(n, []))) if small else m  # noqa: B023
            parts.append(F.transform(m, lambda fp: F.struct(F.lit(n).alias("length"), fp.alias("fp"))))  # noqa: B023
        return F.concat(*parts) if parts else F.array().cast("array<struct<length:int,fp:bigint>>")

    same = ["doc_id", "_h", "_l"]
    if small:
        rows = rows.withColumn("_p", entries())
    else:
        met = rows.select(*same, F.explode(entries()).alias("p")).select(*same, "p.length", "p.fp").join(prints, ["length", "fp"], "left_semi")
        met = met.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.collect_set(F.struct("length", "fp")).alias("_p"))
        rows = rows.join(met, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_h") == F.col("__h")) & (F.col("_l") == F.col("__l")), "left")
        rows = rows.withColumn("_p", F.coalesce("_p", F.array().cast("array<struct<length:int,fp:bigint>>")))
    # The null entry keeps one row per document.
    one = F.array(F.lit(None).cast("struct<length:int,fp:bigint>"))
    rows = rows.withColumn("n_words", F.size("w").cast("long")).withColumn("p", F.explode(F.concat(one, "_p")))
    rows = rows.withColumn("length", F.col("p.length")).withColumn("fp", F.col("p.fp"))
    cases = F.lit(None).cast("array<struct<start:int,window:string>>")
    for i, n in enumerate(lengths):
        cases = F.when(F.col("length") == n, _windows(F.col("w"), F.get(F.col("mins"), F.lit(i))["m"], F.col("fp"), n)).otherwise(cases)
    rows = rows.select(*same, "n_words", "length", "fp", cases.alias("x"))
    hits = rows.select("doc_id", "_h", "_l", "n_words", "length", F.explode_outer("x").alias("x"))
    hits = hits.select("doc_id", "_h", "_l", "n_words", "length", F.col("x.start").alias("start"), F.col("x.window").alias("window"))
    hits = hits.join(side(bench.select("length", "window", "items")), ["length", "window"], "left")
    span = F.when(F.col("items").isNotNull(), F.struct((F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.col("length")).alias("end")))
    found = hits.groupBy("doc_id", "_h", "_l", "n_words").agg(
        F.sort_array(F.collect_set(span)).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("window").isNull()).alias("_copies")
    )
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(None).cast("struct<start:int,end:int>").alias("cur"))

    def unite(acc: Column, x: Column) -> Column:
        joined = F.struct(acc["cur"]["start"].alias("start"), F.greatest(acc["cur"]["end"], x["end"]).alias("end"))
        new = F.when(acc["cur"].isNull(), F.struct(acc["out"].alias("out"), x.alias("cur"))).when(x["start"] <= acc["cur"]["end"], F.struct(acc["out"].alias("out"), joined.alias("cur")))
        return new.otherwise(F.struct(F.concat(acc["out"], F.array(acc["cur"])).alias("out"), x.alias("cur")))

    spans = F.aggregate("s", start, unite, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    out = found.withColumn("spans", spans).withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_copies"), F.lit(1)).cast("int"))))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", bad.alias("contaminated"), "_h", "_l")
