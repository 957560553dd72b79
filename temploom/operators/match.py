"""Read-only classification against a learned catalog: an equi-join on the leaf, then the earliest best similarity."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temploom.functions.expr import extract_parameters, similarity
from temploom.functions.tokens import leaf_keys, with_tokens
from temploom.operators.options import MinerOptions

#: A catalog of at most so many templates is broadcast; a larger one is joined by shuffle.
BROADCAST_TEMPLATES = 50_000


def match(probes: DataFrame, catalog: DataFrame, opts: MinerOptions = MinerOptions(), *, broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """Probe columns (seq, record) plus cluster_id and params; both null on a miss. Nothing is learned.

    The templates of a leaf are gathered into one array, in scan order, before the join: a probe meets one row and the best is found
    in place, so there is no row per pair and no second shuffle. The catalog bounds the array (``max_clusters_per_leaf``).
    """
    keys = F.array_join(leaf_keys(F.col("tokens.text"), opts), " ")
    leaves = (
        catalog.select(F.size("tokens").alias("_n"), keys.alias("_leaf"), F.struct("leaf_pos", "id", F.col("tokens.text").alias("texts")).alias("c"))
        .groupBy("_n", "_leaf").agg(F.sort_array(F.collect_list("c")).alias("_cands"))
    )
    if catalog.limit(broadcast_templates + 1).count() <= broadcast_templates:
        leaves = F.broadcast(leaves)
    texts = F.col("tokens.text")
    tok = with_tokens(probes, opts).withColumn("_n", F.col("n_tokens")).withColumn("_leaf", F.array_join("leaf_keys", " "))
    # Each candidate is compared once; of equals the first in scan order is the greatest.
    scored = F.transform("_cands", lambda c: F.struct(similarity(c["texts"], texts, opts.wildcard).alias("sim"), (-c["leaf_pos"]).alias("at"), c["id"].alias("id"), c["texts"].alias("texts")))
    # Generated, so that a filter on the result isn't pushed below, where the best would be searched twice.
    hit = tok.join(leaves, ["_n", "_leaf"], "left").withColumn("_best", F.explode(F.array(F.array_max(scored))))
    ok = F.col("_best.sim") >= opts.sim_threshold
    return hit.select(*probes.columns, F.when(ok, F.col("_best.id")).alias("cluster_id"), F.when(ok, extract_parameters(F.col("_best.texts"), texts, opts.wildcard)).alias("params"))
