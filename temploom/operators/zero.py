"""Threshold 0: each leaf has one template, and parts of a leaf can be merged in any order."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A part: n_tokens, leaf, the seq, texts, delimiters, suffix and observed time of its first record, and what all its records give.
PART = (
    "n_tokens int, leaf string, created_seq long, texts string, lead string, trail string, suffix string, created_ms long, size long, last_used long, updated_seq long, updated_ms long,"
    " event_first_ms long, event_last_ms long, members array<string>, member_seqs array<long>"
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
_ARROW = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in PART.split(", ")])
#: Leaves and characters that a task holds before it hands its parts on.
LEAVES, CHARS = 20_000, 32_000_000


def _few(a, b, pick):
    return b if a is None else a if b is None else pick(a, b)


def _merge(a: list, b: list, wildcard: str) -> None:
    """Part B into A, of the same leaf. a[3] is a list of texts once they were merged."""
    if b[2] < a[2]:
        a[2], a[4:8] = b[2], b[4:8]
    if a[3] != b[3]:
        x = a[3] if isinstance(a[3], list) else a[3].split(" ")
        for i, t in enumerate(b[3].split(" ")):
            if x[i] != t:
                x[i] = wildcard
        a[3] = x
    a[8] += b[8]
    if b[9] > a[9]:
        a[9] = b[9]
    if b[10] is not None and (a[10] is None or b[10] > a[10]):
        a[10], a[11] = b[10], b[11]
    a[12], a[13] = _few(a[12], b[12], min), _few(a[13], b[13], max)
    if b[14]:
        if not isinstance(a[14], dict):
            a[14] = dict(zip(a[14] or [], a[15] or []))
        held = a[14]
        for m, s in zip(b[14], b[15]):
            if s < held.get(m, s + 1):
                held[m] = s


def _values(b: pa.RecordBatch) -> Iterator[list]:
    return map(list, zip(*[[None] * b.num_rows if c.null_count == b.num_rows else c.to_pylist() for c in b.columns]))


def merger(wildcard: str, ordered: bool):
    """The function for ``mapInArrow``: one part for each leaf. Rows that don't come ORDERED by leaf may give more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        chars = 0

        def flush(parts: list[list]) -> pa.RecordBatch:
            for a in parts:
                if isinstance(a[3], list):
                    a[3] = " ".join(a[3])
                if isinstance(a[14], dict):
                    order = sorted(a[14].items(), key=lambda x: x[1])
                    a[14], a[15] = [m for m, _ in order], [s for _, s in order]
            cols = list(zip(*parts)) if parts else [[]] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

        for b in batches:
            for r in _values(b):
                at = (r[0], r[1])
                if (a := held.get(at)) is not None:
                    _merge(a, r, wildcard)
                else:
                    held[at] = r
                    chars += len(r[3])
            if ordered:
                last = next(reversed(held), None)
                done = [v for k, v in held.items() if k != last]
                if done:
                    yield flush(done)
                    held = {last: held[last]}
            elif len(held) >= LEAVES or chars >= CHARS:
                yield flush(list(held.values()))
                held, chars = {}, 0
        if held:
            yield flush(list(held.values()))

    return run


def leaf_parts(rows: DataFrame, wildcard: str) -> DataFrame:
    """One row of PART for each leaf of ``fold_input``'s rows: merged where the records lie, then by leaf, so a hot leaf reaches one task as a part for each task before."""
    seq, seen = F.col("seq"), F.col("member").isNotNull()
    parts = rows.select(
        "n_tokens", "leaf", seq.alias("created_seq"), F.col("vec").alias("texts"), "lead", "trail", "suffix", F.col("observed_ms").alias("created_ms"), F.lit(1).cast("long").alias("size"), seq.alias("last_used"),
        F.when(F.col("observed_ms").isNotNull(), seq).alias("updated_seq"), F.col("observed_ms").alias("updated_ms"), F.col("event_ms").alias("event_first_ms"), F.col("event_ms").alias("event_last_ms"),
        F.when(seen, F.array("member")).alias("members"), F.when(seen, F.array(seq)).alias("member_seqs"),
    )
    near = parts.mapInArrow(merger(wildcard, False), PART)
    return near.repartition("n_tokens", "leaf").sortWithinPartitions("n_tokens", "leaf").mapInArrow(merger(wildcard, True), PART)
