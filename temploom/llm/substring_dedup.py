"""Substring dedup with fixed-block anchors.

Words are runs of anything but ASCII white space. With windows of ``window`` words and blocks of (window + 1) // 2, every occurrence of a
window wholly holds a block that starts at a multiple of the block length in its document. So the index takes only those
non-overlapping reference blocks; every rolling window of block length of every document probes it. Where a probed block content occurs at
another place too, the hit is extended: all windows of full length around it are compared with those around its other occurrences, by two
rolling hashes of 64 mixed bits with different bases over 64-bit word hashes (two different windows agree with probability 2**-128);
overlapping equal windows unite to maximal repeats, and each word in one is removed.

Both comparisons are one exchange: a task hashes a chunk of documents, keeps each distinct hash of the chunk once (so a passage that a
third of all documents share costs a hash a chunk, not a hash a document) with a flag for repeats inside, sends sorted hashes by range
and gets bits back in the same order, through tables in the shared folder. No pairs are formed. The documents are read three times. The
ranges are as many as the input's size asks for, so that one fits a task.

Chunks are cut by the rows' order in their input partition. The exchange checks in the later passes that chunks hold what they
held in the first (a different order of rows after a lost executor fails loudly instead of giving wrong bits); a plain table scan is
stable.

Nulls: a null text has no words. Texts shorter than the window are kept whole. Long texts are hashed in blocks. Repeated rows are
occurrences of their own, so both lose what they share. Empty table: no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temploom.llm.common import parts_for, work_dir

CHUNK = 6_000_000  # bytes of text in a chunk, but for a longer single text
BLOCK = 1_000_000  # bytes hashed at once
_M = 2**64
_R = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_Q2 = 0xA0761D6478BD642F | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SENT = "pid int, chunk int, part int, crc long, low binary, flags binary"
_BACK = "pid int, chunk int, part int, crc long, hits binary"
_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod 2**64."""
    have = _tables.get((base, 0))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _tables[base, 0] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * inverse[start]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in blocks that end at white space."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(at + BLOCK, n)
        while end < n and not _SPACE[data[end]]:
            end += 1
        a = np.frombuffer(data, np.uint8, end - at, at)
        word = np.concatenate([[False], ~_SPACE[a], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, stop = edge[::2], edge[1::2]
        prefix = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers(_R, len(a)), out=prefix[1:])
        out.append(_mix(_span_hashes(prefix, start, stop, _powers(pow(_R, -1, _M), len(a) + 1)) + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def rolling(wh: np.ndarray, n: int, base: int = _Q) -> np.ndarray:
    """Hash of each run of n words, by its start."""
    if len(wh) < n:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(wh) + 1, np.uint64)
    np.cumsum(wh * _powers(base, len(wh)), out=prefix[1:])
    start = np.arange(len(wh) - n + 1)
    return _mix(_span_hashes(prefix, start, start + n, _powers(pow(base, -1, _M), len(wh) + 1)))


class Chunk:
    """Documents hashed together. ids[i], texts[i]; words of all documents in one row with starts by document."""

    def __init__(self, rows: list[tuple], window: int) -> None:
        self.rows, self.window, self.block = rows, window, (window + 1) // 2
        each = [word_hashes(t) for _, t in rows]
        self.counts = np.array([len(x) for x in each], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])[:-1].astype(np.int64)
        self.wh = np.concatenate(each) if each else np.zeros(0, np.uint64)

    def _inside(self, n: int) -> np.ndarray:
        """Whether a run of n words that starts here stays in its document."""
        size = max(0, len(self.wh) - n + 1)
        ok = np.ones(len(self.wh) + 1, bool)
        for s, c in zip(self.starts, self.counts):
            ok[max(s, s + c - n + 1) : s + c] = False
        return ok[:size]

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all rolling blocks, their hashes, and which are reference blocks."""
        at = np.flatnonzero(self._inside(self.block))
        own = np.repeat(self.starts, self.counts)
        return at, rolling(self.wh, self.block)[at], (at - own[at]) % self.block == 0

    def candidates(self, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both hashes of the full windows that hold a hit block."""
        n, lag = self.window, self.window - self.block
        flag = np.zeros(len(self.wh) + 1, np.int64)
        flag[at[hit] + 1] = 1
        total = np.cumsum(flag)
        inside = self._inside(n)
        s = np.arange(len(inside))
        s = s[inside & (total[np.minimum(s + lag + 1, len(self.wh))] > total[s])]
        if not len(s):
            return s, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return s, rolling(self.wh, n)[s], rolling(_mix(self.wh), n, _Q2)[s]

    def covered(self, starts: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(self.wh) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Chunk]:
    rows, size = [], 0
    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        for i, t in zip(b.column("doc_id").to_pylist(), texts):
            t = t.as_py() or b""
            if rows and size + len(t) > CHUNK:
                yield Chunk(rows, window)
                rows, size = [], 0
            rows.append((i, t))
            size += len(t)
    if rows:
        yield Chunk(rows, window)


def _crc(u: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(_mix(u + np.arange(len(u), dtype=np.uint64)))) & 0x7FFFFFFFFFFFFFFF if len(u) else 0


def _groups(h: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hashes are neighbours, and the mask of each group's first."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if more is not None:
        t = more[order]
        if (~new[1:] & (t[1:] != t[:-1])).any():  # different windows with equal first halves
            order = np.lexsort((more, h))
            s, t = h[order], more[order]
            new[1:] = s[1:] != s[:-1]
        new[1:] |= t[1:] != t[:-1]
    return order, new


def _distinct(h: np.ndarray, first: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Sorted distinct hashes, flags (1: repeats here, 2: one of them is in first), the place of each hash among them, the second halves."""
    order, new = _groups(h, more)
    group = np.cumsum(new) - 1
    u = h[order][new]
    flags = (np.bincount(group, minlength=len(u)) > 1).astype(np.uint8)
    flags |= (np.bincount(group, weights=first[order], minlength=len(u)) > 0).astype(np.uint8) << 1
    back = np.empty(len(h), np.int64)
    back[order] = group
    return u, flags, back, None if more is None else more[order][new]


def _cuts(u: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(u, np.array([-(-(k << 64) // parts) for k in range(1, parts)], np.uint64))


def _send(pid: int, no: int, h: np.ndarray, first: np.ndarray, parts: int, more: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct hashes by range. With more, 128 bits go; otherwise the low 32, which the range completes in part."""
    u, flags, _, v = _distinct(h, first, more)
    crc, cut = _crc(u), _cuts(u, parts)
    low = [x.tobytes() for x in np.split((u & np.uint64(0xFFFFFFFF)).astype(np.uint32) if v is None else u, cut)]
    if v is not None:
        low = [a + b.tobytes() for a, b in zip(low, np.split(v, cut))]
    rows = [(pid, no, k, crc, x, f.tobytes()) for k, (x, f) in enumerate(zip(low, np.split(flags, cut))) if x]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["pid", "chunk", "part", "crc", "low", "flags"])


def _answer(wide: bool, reference: bool):
    """Bits for all chunks of one hash range: the hash occurs twice or more and, if asked, at a reference block."""

    def run(t: pa.Table) -> pa.Table:
        raw = t["low"].to_pylist()
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in t["flags"].to_pylist()])
        more = None
        if wide:
            both = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in raw]
            every, more, sizes = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]), [x.shape[1] for x in both]
        else:
            low = [np.frombuffer(x, np.uint32) for x in raw]
            every, sizes = np.concatenate(low), [len(x) for x in low]
        order, new = _groups(every, more)
        group = np.cumsum(new) - 1
        hit = np.bincount(group, weights=1 + (flags[order] & 1)) >= 2
        if reference:
            hit &= np.bincount(group, weights=flags[order] >> 1) > 0
        bits = np.empty(len(every), bool)
        bits[order] = hit[group]
        cut = np.split(bits, np.cumsum(sizes)[:-1])
        return pa.table({"pid": t["pid"], "chunk": t["chunk"], "part": t["part"], "crc": t["crc"], "hits": pa.array([np.packbits(x).tobytes() for x in cut], pa.binary())})

    return run


class _Back:
    """The answers for the chunks of one input partition."""

    def __init__(self, path: str, pid: int, parts: int) -> None:
        from temploom.llm.token_output import _fs

        f, root = _fs(f"{path}/pid={pid}")
        self.parts, self.rows = parts, {}
        if f.get_file_info(root).type.name != "NotFound":
            for r in ds.dataset(root, filesystem=f, format="parquet").to_table().to_pylist():
                self.rows[r["chunk"], r["part"]] = (r["crc"], r["hits"])

    def of(self, no: int, h: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """A bit per hash of the chunk."""
        u, _, back, _ = _distinct(h, np.zeros(len(h), bool), more)
        crc, out = _crc(u), []
        for k, x in enumerate(np.split(u, _cuts(u, self.parts))):
            if not len(x):
                continue
            held, hits = self.rows.get((no, k), (None, b""))
            if held != crc:
                raise RuntimeError("the documents came in another order than before; write them to a table first")
            out.append(np.unpackbits(np.frombuffer(hits, np.uint8), count=len(x)).astype(bool))
        return np.concatenate(out)[back] if out else np.zeros(0, bool)


def _exchange(docs: DataFrame, send, wide: bool, reference: bool, path: str, parts: int) -> None:
    back = docs.mapInArrow(send, _SENT).groupBy("part").applyInArrow(_answer(wide, reference), _BACK)
    back.repartition(parts, "pid").write.partitionBy("pid").parquet(path)


def _pid() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (the kept words joined by a space)."""
    spark = docs.sparkSession
    base = work_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, a, b = parts_for(rows), f"{base}/blocks", f"{base}/windows"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = _pid()
        for no, c in enumerate(chunks(batches, window)):
            _, h, ref = c.probes()
            yield from _send(pid, no, h, ref, parts, None)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = _pid()
        blocks = _Back(a, pid, parts)
        for no, c in enumerate(chunks(batches, window)):
            at, h, _ = c.probes()
            s, wide, more = c.candidates(at, blocks.of(no, h))
            yield from _send(pid, no, wide, np.zeros(len(wide), bool), parts, more)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = _pid()
        blocks, windows = _Back(a, pid, parts), _Back(b, pid, parts)
        for no, c in enumerate(chunks(batches, window)):
            at, h, _ = c.probes()
            s, wide, more = c.candidates(at, blocks.of(no, h))
            gone = c.covered(s[windows.of(no, wide, more)])
            out = []
            for (i, t), start, n in zip(c.rows, c.starts, c.counts):
                g = gone[start : start + n]
                words = t.split()
                out.append((i, int(n), int(g.sum()), b" ".join(compress(words, ~g) if g.any() else words).decode()))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    _exchange(rows, probe, False, True, a, parts)
    _exchange(rows, extend, True, False, b, parts)
    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
