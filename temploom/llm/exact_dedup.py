"""Exact dedup against a minimal perfect hash of historical distinct digests.

Digests of equal length (sha256) are sharded by a hash; each shard of about SHARD digests gets a minimal perfect hash (a cascade of bit
arrays whose rank is the slot). A slot holds the full digest, the winner's locator (its doc_id) and the group's size. A lookup compares
the whole digest in the slot byte by byte: members get the historical winner merged with their own, nonmembers group among themselves.

Nulls: a null text counts as empty; a null doc_id loses to any other and stays only in a group that has no other. Repeated rows (same
doc_id and text) tie; one of them stays. An empty table gives no rows. Columns of the input other than doc_id and text are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temploom.llm.common import hot_join, work_dir, written

SHARD = 65_536
GAMMA = 2.0
INDEX = "shard int, n long, sizes array<long>, bits binary, digests binary, winners binary, has_winner binary, counts binary"
FOUND = "digest binary, keep_id long, group_size long, member boolean"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _word(d: np.ndarray, level: int) -> np.ndarray:
    """Level-dependent 64 bits of 32-byte digests: all four words of a digest come into play over the levels."""
    w = d.view("<u8").reshape(len(d), -1)
    return _mix(w[:, level % w.shape[1]] + np.uint64(level // w.shape[1]), level)


def mph_build(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their concatenated bits, for distinct digests (n x 32 bytes)."""
    sizes, bits, left, level = [], [], digests, 0
    while len(left):
        size = max(8, int(len(left) * GAMMA))
        at = (_word(left, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left, level = left[~alone[at]], level + 1
        if level > 200:
            raise ValueError("digests repeat")
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def mph_slots(sizes: list[int], bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Each digest's slot; -1 for some nonmembers, any slot for the others."""
    rank = np.cumsum(bits) - 1
    out, open_, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = (_word(digests[open_], level) % np.uint64(size)).astype(np.int64) + base
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return out


def _digests(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 32)


def _build(table: pa.Table) -> pa.Table:
    d = _digests(table["digest"])
    sizes, bits = mph_build(d)
    slot = mph_slots(sizes, bits, d)
    at = np.argsort(slot)
    win = np.array(table["max_id"].fill_null(0), np.int64)[at]
    has = np.array(table["max_id"].is_valid(), bool)[at]
    return pa.table({
        "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "n": pa.array([len(d)], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "digests": pa.array([d[at].tobytes()], pa.binary()),
        "winners": pa.array([win.tobytes()], pa.binary()), "has_winner": pa.array([np.packbits(has).tobytes()], pa.binary()), "counts": pa.array([np.array(table["n"], np.int64)[at].tobytes()], pa.binary()),
    })


def _look_up(old: bool):
    def run(new: pa.Table, index: pa.Table) -> pa.Table:
        d = _digests(new["digest"])
        ids, valid, n = np.array(new["max_id"].fill_null(0), np.int64), np.array(new["max_id"].is_valid(), bool), np.array(new["n"], np.int64)
        member = np.zeros(len(d), bool)
        if len(index) and len(d):
            r = {k: index[k][0].as_py() for k in index.column_names}
            size, total = r["n"], sum(r["sizes"])
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=total).astype(bool)
            slot = mph_slots(r["sizes"], bits, d)
            held = np.frombuffer(r["digests"], np.uint8).reshape(size, 32)
            at = np.maximum(slot, 0)
            member = (slot >= 0) & (held[at] == d).all(axis=1)
            win, has, cnt = np.frombuffer(r["winners"], np.int64)[at], np.unpackbits(np.frombuffer(r["has_winner"], np.uint8), count=size).astype(bool)[at], np.frombuffer(r["counts"], np.int64)[at]
            take = member & has & (~valid | (win > ids))
            ids, valid = np.where(take, win, ids), valid | take
            if not old:  # else the rows looked up are those the index counted
                n = n + np.where(member, cnt, 0)
            else:
                n = np.where(member, cnt, n)
        return pa.table({"digest": new["digest"].combine_chunks(), "keep_id": pa.array(ids, pa.int64(), mask=~valid), "group_size": pa.array(n, pa.int64()), "member": pa.array(member)})

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("max_id"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """The index table of a corpus, one row a shard, written below path."""
    groups = written(_grouped(docs.select("doc_id", digest(F.col("text")).alias("digest"))), "groups", path)
    shards = max(1, -(-groups.count() // SHARD))
    index = _sharded(groups, shards).groupBy("shard").applyInArrow(_build, INDEX)
    return written(index.withColumn("shards", F.lit(shards)), "index", path)


def look_up(docs: DataFrame, index: DataFrame, *, indexed: bool = False) -> DataFrame:
    """Per distinct digest of docs: the id that stays, the group's size over history and docs, membership.

    indexed: docs are themselves the history, so their rows are not counted twice. Rows are grouped by digest before any shuffle.
    """
    head = index.select("shards").head()
    shards = head[0] if head else 1
    new = _sharded(_grouped(docs.select("doc_id", digest(F.col("text")).alias("digest"))), shards)
    return new.groupBy("shard").cogroup(index.drop("shards").groupBy("shard")).applyInArrow(_look_up(indexed), FOUND)


def exact_dedup(docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, digest. Without an index, docs are indexed first and looked up in themselves.

    With an index, a text that history has with a larger doc_id isn't kept.
    """
    path = work_dir(docs.sparkSession)
    indexed = index is None
    if indexed:
        index = build_index(docs, path)
    found = written(look_up(docs, index, indexed=indexed), "found", path)
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    size = found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).head()[0]
    out = hot_join(rows, found, "digest", "group_size", size, "inner")
    # Ties only exist between rows of one doc_id; of those equal to the winner one stays.
    tie = Window.partitionBy("digest", "doc_id").orderBy(F.lit(0))
    first = F.row_number().over(tie) == 1
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).select("doc_id", "keep_id", "group_size", "kept", "digest")
