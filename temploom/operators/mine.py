"""Online template mining over a batch DataFrame: a stateful fold per leaf after one shuffle on the leaf."""
from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temploom.functions.expr import per_minute, render_template
from temploom.functions.tokens import leaf_keys, with_tokens
from temploom.operators.fold import Cluster, LeafFold
from temploom.operators.numbering import numbered
from temploom.operators.options import MinerOptions
from temploom.operators.zero import leaf_parts

FOLD_SCHEMA = (
    "kind string, n_tokens int, leaf string, seq long, created_seq long, seed_id long, update string, texts string, lead string, trail string,"
    " size long, created_ms long, updated_ms long, event_first_ms long, event_last_ms long, suffix string, members array<string>, leaf_pos int, last_used long"
)
_NAMES = ["kind", "n_tokens", "leaf", "seq", "created_seq", "seed_id", "update", "texts", "lead", "trail", "size", "created_ms", "updated_ms", "event_first_ms", "event_last_ms", "suffix", "members", "leaf_pos", "last_used"]
_ARROW = pa.schema([pa.field(n, pa.list_(pa.string()) if n == "members" else pa.int32() if n in ("n_tokens", "leaf_pos") else pa.string() if n in ("kind", "leaf", "update", "texts", "lead", "trail", "suffix") else pa.int64()) for n in _NAMES])


def _opt(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _joined(tokens: Column, part: str) -> Column:
    """Delimiters of all tokens, null if no token has one. Token parts hold no white space, so a space parts them without loss."""
    every = F.transform(tokens, lambda t: F.coalesce(t[part], F.lit("")))
    return F.when(F.exists(tokens, lambda t: t[part].isNotNull()), F.array_join(every, " "))


def fold_input(tok: DataFrame, opts: MinerOptions) -> DataFrame:
    """What the fold reads of tokenized records."""
    part = lambda x: _joined(F.col("tokens"), x) if opts.active_delimiters else F.lit(None).cast("string")
    return tok.select(
        F.lit(1).alias("ord"), "n_tokens", F.array_join("leaf_keys", " ").alias("leaf"), F.col("seq").cast("long").alias("seq"), F.array_join("tokens.text", " ").alias("vec"),
        part("lead").alias("lead"), part("trail").alias("trail"), "suffix",
        _opt(tok, "event_ms", "long").alias("event_ms"), _opt(tok, "observed_ms", "long").alias("observed_ms"), _opt(tok, "member", "string").alias("member"), F.lit(None).cast("string").alias("seed"),
    )


def seed_rows(catalog: DataFrame, opts: MinerOptions) -> DataFrame:
    """A stored catalog as the fold's first rows. Leaf keys follow this run's options; recency starts at 0 for all."""
    keys = F.array_join(leaf_keys(F.col("tokens.text"), opts), " ")
    seed = F.to_json(F.struct("id", "size", "created_ms", "updated_ms", "event_first_ms", "event_last_ms", "members"))
    return catalog.select(
        F.lit(0).alias("ord"), F.size("tokens").alias("n_tokens"), keys.alias("leaf"), F.col("leaf_pos").cast("long").alias("seq"), F.array_join("tokens.text", " ").alias("vec"),
        _joined(F.col("tokens"), "lead").alias("lead"), _joined(F.col("tokens"), "trail").alias("trail"), "suffix",
        F.lit(None).cast("long").alias("event_ms"), F.lit(None).cast("long").alias("observed_ms"), F.lit(None).cast("string").alias("member"), seed.alias("seed"),
    )


def _catalog_rows(n: int, leaf: str, fold: LeafFold) -> Iterator[tuple]:
    for pos, c in enumerate(fold.clusters):
        yield ("C", n, leaf, None, c.key, c.seed_id, None, " ".join(c.texts), c.lead, c.trail, c.size, c.created_ms, c.updated_ms, c.first_ms, c.last_ms, c.suffix, list(c.members), pos, c.last_used)


#: Records of one leaf in a batch from which they are folded as a block.
HOT = 256


def _runs(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The batch in parts, with whether a part is a long run of one leaf's records."""
    n, leaf = b.column("n_tokens").to_numpy(), b.column("leaf").dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (leaf[1:] != leaf[:-1]), [True]])) if len(n) else np.zeros(1, int)
    done = 0
    for k in np.flatnonzero(np.diff(edges) >= HOT):
        lo, hi = int(edges[k]), int(edges[k + 1])
        if pc.min(b.column("ord").slice(lo, hi - lo)).as_py():
            if lo > done:
                yield b.slice(done, lo - done), False
            yield b.slice(lo, hi - lo), True
            done = hi
    if done < len(n):
        yield b.slice(done), False


def leaf_folder(threshold: float, cap: int, wildcard: str):
    """The function for ``mapInArrow``: rows come sorted by leaf, then order; memory holds one leaf's templates and one batch."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fold, out = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in _NAMES]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
            out.clear()
            return batch

        def rows(b: pa.RecordBatch) -> None:
            nonlocal at, fold
            cols = [[None] * b.num_rows if (c := b.column(x)).null_count == b.num_rows else c.to_pylist() for x in ("ord", "n_tokens", "leaf", "seq", "vec", "lead", "trail", "suffix", "event_ms", "observed_ms", "member", "seed")]
            for o, n, leaf, seq, vec, lead, trail, suffix, ev, ob, member, seed in zip(*cols):
                if (n, leaf) != at:
                    turn(n, leaf)
                texts = vec.split(" ") if n else []
                if not o:
                    s = json.loads(seed)
                    fold.seed(Cluster(None, s["id"], texts, lead, trail, suffix, s["size"], s.get("created_ms"), s.get("updated_ms"), s.get("event_first_ms"), s.get("event_last_ms"), 0, dict.fromkeys(s.get("members") or [])))
                    continue
                c, update = fold.add(vec, texts, seq, lead=lead, trail=trail, suffix=suffix, event_ms=ev, observed_ms=ob, member=member)
                out.append(("A", n, leaf, seq, c.key, c.seed_id, update, *[None] * 12))

        def turn(n: int, leaf: str) -> None:
            nonlocal at, fold
            if fold is not None:
                out.extend(_catalog_rows(*at, fold))
            at, fold = (n, leaf), LeafFold(threshold, cap, wildcard)

        def block(b: pa.RecordBatch) -> pa.RecordBatch:
            n, leaf = b.column("n_tokens")[0].as_py(), b.column("leaf")[0].as_py()
            if (n, leaf) != at:
                turn(n, leaf)
            keys, seeds, updates, _, _ = fold.add_block(n, {x: b.column(x) for x in ("seq", "vec", "lead", "trail", "suffix", "event_ms", "observed_ms", "member")})
            made = {"kind": pa.repeat("A", b.num_rows), "n_tokens": b.column("n_tokens"), "leaf": b.column("leaf"), "seq": b.column("seq"), "created_seq": pa.array(keys, pa.int64()), "seed_id": pa.array(seeds, pa.int64()), "update": pa.array(updates, pa.string())}
            return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(b.num_rows, f.type) for f in _ARROW], schema=_ARROW)

        for b in batches:
            for part, hot in _runs(b):
                if hot:
                    yield block(part)
                else:
                    rows(part)
            yield flush()
        if fold is not None:
            out.extend(_catalog_rows(*at, fold))
            yield flush()

    return run


def _split(c: Column, n: Column) -> Column:
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.split(c, " "))


def _token_structs() -> Column:
    n = F.col("n_tokens")
    part = lambda x: F.coalesce(_split(F.col(x), n), F.transform(_split(F.col("texts"), n), lambda _: F.lit("")))
    return F.transform(F.arrays_zip(_split(F.col("texts"), n).alias("text"), part("lead").alias("lead"), part("trail").alias("trail")), lambda t: F.struct(t["text"].alias("text"), F.nullif(t["lead"], F.lit("")).alias("lead"), F.nullif(t["trail"], F.lit("")).alias("trail")))


class MineResult:
    """assigned and catalog are built when first asked for, each from what it needs."""

    def __init__(self, rows: DataFrame, opts: MinerOptions, seeded: bool, counter: int, partitions: int | None, persist: bool) -> None:
        self.rows, self.opts, self.seeded, self.counter, self.partitions, self.persist, self.held = rows, opts, seeded, counter, partitions, persist, []

    def _hold(self, df: DataFrame) -> DataFrame:
        if self.persist:
            self.held.append(df.persist())
        return df

    @cached_property
    def raw(self) -> DataFrame:
        """The fold's rows: A for a record, C for a template that is left."""
        keys = ("n_tokens", "leaf")
        rows = (self.rows.repartition(self.partitions, *keys) if self.partitions else self.rows.repartition(*keys)).sortWithinPartitions(*keys, "ord", "seq")
        return self._hold(rows.mapInArrow(leaf_folder(self.opts.sim_threshold, self.opts.max_clusters_per_leaf, self.opts.wildcard), FOLD_SCHEMA))

    def _id(self, df: DataFrame) -> DataFrame:
        return numbered(df, [F.col("created_seq")], "new_id").withColumn("new_id", F.col("new_id") + self.counter)

    @cached_property
    def _ids(self) -> DataFrame:
        return self._id(self.raw.filter("kind = 'A' and update = 'Created'").select(F.col("seq").alias("created_seq")))

    def _with_id(self, df: DataFrame) -> DataFrame:
        return df.join(self._ids, "created_seq", "left").withColumn("cluster_id", F.coalesce("seed_id", "new_id"))

    @cached_property
    def assigned(self) -> DataFrame:
        return self._with_id(self.raw.filter("kind = 'A'").select("seq", "created_seq", "seed_id", "update", "n_tokens", "leaf")).select("seq", "cluster_id", "update", "n_tokens", "leaf")

    @cached_property
    def catalog(self) -> DataFrame:
        if self.opts.sim_threshold == 0 and not self.seeded:
            # A template for each leaf, whatever the order: no fold. Every creating record has its row.
            cat = self._id(self._hold(leaf_parts(self.rows, self.opts.wildcard))).withColumn("cluster_id", F.col("new_id")).withColumn("leaf_pos", F.lit(0))
        else:
            cat = self._with_id(self.raw.filter("kind = 'C'").drop("seq"))
        # Without delimiters a template is its texts with spaces between.
        plain = F.col("lead").isNull() & F.col("trail").isNull()
        template = F.when(plain, F.col("texts")).otherwise(render_template(F.col("tokens")))
        return cat.withColumn("tokens", _token_structs()).select(
            F.col("cluster_id").alias("id"), template.alias("template"), "tokens", "size", "created_ms", "updated_ms", "event_first_ms", "event_last_ms", "suffix", F.coalesce("members", F.array().cast("array<string>")).alias("members"), "n_tokens",
            leaf_keys(F.col("tokens.text"), self.opts).alias("leaf_keys"), "leaf_pos", "last_used",
        )

    def unpersist(self) -> None:
        for df in self.held:
            df.unpersist()


def mine(records: DataFrame, opts: MinerOptions = MinerOptions(), *, initial: DataFrame | None = None, counter: int = 0, partitions: int | None = None, persist: bool = True) -> MineResult:
    """Learn templates from RECORDS (seq unique, record; optionally source, event_ms, observed_ms, member).

    assigned: seq, cluster_id, update, n_tokens, leaf. catalog: one row per template that is left at the end. The result equals a
    single-threaded run in seq order: a record's leaf is a function of the record alone, so leaves are folded independently, each by
    one task; at threshold 0 the catalog needs no fold. Ids are ranks of creating records, evicted ones included, after ``counter``.
    """
    rows = fold_input(with_tokens(records, opts), opts)
    if initial is not None:
        rows = rows.unionByName(seed_rows(initial, opts))
    return MineResult(rows, opts, initial is not None, counter, partitions, persist)


def with_rates(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("lines_per_minute", F.coalesce(per_minute(F.col("size"), F.col("created_ms"), F.col("updated_ms")), F.lit(0.0))).withColumn("event_lines_per_minute", per_minute(F.col("size"), F.col("event_first_ms"), F.col("event_last_ms")))
