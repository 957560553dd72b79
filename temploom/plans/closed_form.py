"""Exact catalogs without the fold at the two ends of the threshold, skew-proof by partial aggregation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temploom.functions.tokens import with_tokens
from temploom.operators.mine import fold_input
from temploom.operators.options import MinerOptions
from temploom.operators.zero import leaf_parts


def catalog_threshold_zero(records: DataFrame, opts: MinerOptions) -> DataFrame:
    """sim_threshold 0: one template per leaf; a position is the wildcard where the leaf has more than one text.

    Lines are merged where they lie and then by leaf: each is shuffled once at most, and a hot leaf never reaches one task unmerged.
    """
    parts = leaf_parts(fold_input(with_tokens(records, opts), opts).withColumns({x: F.lit(None).cast(k) for x, k in (("member", "string"), ("event_ms", "long"), ("observed_ms", "long"))}), opts.wildcard)
    return parts.select("n_tokens", "leaf", F.col("texts").alias("template"), "size", F.col("created_seq").alias("first_seq"), "suffix")


def catalog_threshold_one(records: DataFrame, opts: MinerOptions) -> DataFrame:
    """sim_threshold 1 without evictions: one template per distinct token vector."""
    tok = with_tokens(records, opts)
    return tok.groupBy("n_tokens", F.array_join("tokens.text", " ").alias("template")).agg(F.count(F.lit(1)).alias("size"), F.min("seq").alias("first_seq"))
