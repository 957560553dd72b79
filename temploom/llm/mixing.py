"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A source's target is its share of ``budget`` times all words, by weight, at most ``cap`` times the source's own words; the excess goes
to the other sources by weight until none is above (water filling, in closed form over the sorted sources). Complete epochs come first:
every document ``floor(target / size)`` times. The rest is a sample without replacement: documents in ascending order of the exponential
key -ln(u) / quality, u uniform from the md5 of the doc_id, are taken while more than half of a document fits into what is left.

A source's prefix sums are taken in two levels, so a hot source never meets one task: sums by key bucket first, then document by document
only inside the one bucket where the budget ends. Buckets are STEPS to an octave of the key: a weight moves a document's key along
them without crowding it, so a bucket has about 0.15 % of its source, whatever the weights, and a source some thousand buckets.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null doc_id has the md5 of the empty string; a null or
non-positive quality counts as 1. Documents of size 0 are taken once an epoch and 0 words each. Repeated rows are separate documents
with equal keys: any of them may come first, with the same result. Empty table: no rows. Reruns agree on any partitioning.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temploom.llm.common import word_count, work_dir, written

STEPS = 256  # buckets by octave of the key


def uniform(doc_id: Column) -> Column:
    """(0, 1) from the first 13 hexadecimal digits of the md5 of the id."""
    h = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return (h + 1) / F.lit(float(2**52 + 2))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size to source, source_size, target. One row a source; weights repeat over sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * cap)
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    # Sources fill up in order of cap / weight: the level after the first k are full is what remains over the weights that remain.
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_total", F.sum("source_size").over(all_) * budget).withColumn("_rest", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_left", F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("_level", F.col("_rest") / F.col("_left"))
    s = s.withColumn("_at", F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source", F.col("_level").alias("level")))).over(all_))
    return s.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_at.level") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, cap: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs, sampled, taken, carry. quality: doc_id, weight (one row a doc_id)."""
    base = work_dir(docs.sparkSession)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry)
    if quality is not None:
        q = quality.groupBy(F.col("doc_id").alias("_q")).agg(F.max("weight").alias("_weight"))
        rows = rows.join(q, rows["doc_id"] == F.col("_q"), "left").withColumn("_weight", F.when(F.col("_weight") > 0, F.col("_weight")).otherwise(1.0)).drop("_q")
    else:
        rows = rows.withColumn("_weight", F.lit(1.0))
    key = -F.log(uniform(F.col("doc_id"))) / F.col("_weight")
    rows = rows.withColumn("_key", key).withColumn("_bucket", F.floor(F.log2("_key") * STEPS).cast("int"))  # monotone in the key
    rows = written(rows, "sizes", base)
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    sizes = buckets.groupBy("source").agg(F.sum("_words").alias("source_size"))
    plan = targets(sizes, weights, budget, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    same = F.col("_s").eqNullSafe(F.col("source"))
    plan = plan.withColumnRenamed("source", "_s")
    cum = F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = buckets.withColumn("_upto", cum).withColumn("_before", F.col("_upto") - F.col("_words")).join(plan, same)
    # The bucket where the budget ends; buckets before it are taken whole. There is at most one row a source.
    cut = cut.filter((F.col("_upto") >= F.col("_rest")) & (F.col("_before") < F.col("_rest"))).groupBy("_s").agg(F.min("_bucket").alias("_cut"), F.min("_before").alias("_cut_before"))
    plan = plan.join(cut.withColumnRenamed("_s", "_c"), F.col("_c").eqNullSafe(F.col("_s")), "left").drop("_c")
    plan = written(plan, "plan", base)  # one row a source
    rows = rows.join(plan, same).drop("_s")
    inside = rows.filter(F.col("_bucket") == F.col("_cut"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_cut_before")
    inside = inside.withColumn("sampled", upto - F.col("size") / 2.0 <= F.col("_rest"))
    others = rows.filter(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut"))).withColumn("sampled", (F.col("_rest") > 0) & F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)))
    out = inside.unionByName(others)
    taken = F.col("size") * (F.col("epochs") + F.col("sampled").cast("long"))
    return out.withColumn("taken", taken).select("doc_id", "source", "size", "source_size", "target", "epochs", "sampled", "taken", *carry)


def quality_weights(labels: DataFrame) -> DataFrame:
    """Labelled good documents weigh 2, bad ones 0.5; mix() gives 1 to the rest."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.when(F.max("quality") == 1, 2.0).otherwise(0.5).alias("weight"))
