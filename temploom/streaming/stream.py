"""Mining an unbounded stream: the same leaf fold as keyed state, one key per leaf."""
from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from temploom.functions.tokens import with_tokens
from temploom.operators.fold import Cluster, LeafFold
from temploom.operators.mine import fold_input
from temploom.operators.options import MinerOptions
from temploom.streaming.runs import SeqSorter

OUTPUT = "n_tokens int, leaf string, seq long, created_seq long, update string, texts string, size long"

ROWS = pa.schema([(x, pa.int64() if x in ("seq", "event_ms", "observed_ms") else pa.string()) for x in ("seq", "vec", "lead", "trail", "suffix", "event_ms", "observed_ms", "member")])


class LeafProcessor(StatefulProcessor):
    """State: the leaf's clusters in scan order. Rows of a micro-batch are folded in seq order, sorted on disk where they are many; batches in arrival order."""

    def __init__(self, threshold: float, cap: int, wildcard: str) -> None:
        self.args = (threshold, cap, wildcard)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clusters", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold, sorter = LeafFold(*self.args), SeqSorter()
        if self.state.exists():
            for x in json.loads(self.state.get()[0]):
                fold.put(Cluster(**(x | {"members": dict.fromkeys(x["members"])})))
        for df in rows:
            sorter.add(pa.table([pa.Array.from_pandas(df[f.name], type=f.type) for f in ROWS], schema=ROWS))
        n, leaf = int(key[0]), key[1]
        for b in sorter.batches():
            keys, _, updates, size, texts = fold.add_block(n, {f.name: b.column(f.name) for f in ROWS})
            yield pd.DataFrame({"n_tokens": n, "leaf": leaf, "seq": b.column("seq").to_numpy(), "created_seq": keys, "update": updates, "texts": texts, "size": size})
        self.state.update((json.dumps([asdict(c) | {"members": list(c.members)} for c in fold.clusters]),))

    def close(self) -> None:
        pass


def mine_stream(records: DataFrame, opts: MinerOptions = MinerOptions()) -> DataFrame:
    """A row per record, in append mode. A cluster's stable id is the seq of the record that created it (``created_seq``).

    The session needs the RocksDB state store provider.
    """
    rows = fold_input(with_tokens(records, opts), opts).drop("ord", "seed")
    return rows.groupBy("n_tokens", "leaf").transformWithStateInPandas(LeafProcessor(opts.sim_threshold, opts.max_clusters_per_leaf, opts.wildcard), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def created_feed(assigned: DataFrame) -> DataFrame:
    """Alerts: records that opened a new template."""
    return assigned.filter("update = 'Created'")
