"""Document quality by an interpolated modified Kneser-Ney model over characters, trained on trusted text.

N-grams are of ORDER characters (a text begins after ORDER - 1 start marks). Every trusted text is counted: a task counts a chunk of
texts at once, the counts are summed by n-gram, and lower orders hold the numbers of distinct left extensions. Discounts come
from the numbers of n-grams counted once to four times. The probability of an n-gram is (count - discount) / total of its context plus
the context's back-off weight times the probability of its suffix; all of that is joins of count tables keyed by n-gram.

For scoring, each chunk of documents sends hashes of its distinct n-grams, of all their suffixes and of all contexts, in ranges of the
hash, to where the model's rows of that range are, and gets probability and back-off weight of each back in the same order, through a
table in the shared folder: a hot n-gram costs a chunk one hash, not one row for each occurrence. What an order hasn't seen backs off
inside the chunk. A document's perplexity is exp of minus its mean log probability.

A document is kept if its perplexity is at most the ``quantile`` of its language's trusted, held-out documents (those not trained on;
where a language has none, all trusted ones' quantile). Quantiles are Spark's mergeable sketches.

Nulls: a null or empty text has null perplexity and isn't kept; a null lang is a language of its own. No trusted text: perplexity and
threshold are null and nothing is kept. Repeated rows count as often as they come. Empty table: no rows. Texts are counted in pieces of
BLOCK characters, so memory follows one chunk, or one text if that is longer.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temploom.llm.common import parts_for, work_dir, written
from temploom.llm.substring_dedup import _Back as _Answers
from temploom.llm.substring_dedup import _crc, _cuts, _mix, _pid

ORDER = 5
START = "\x02"
CHUNK = 12_000_000  # bytes sent at once, but for a longer single text
BLOCK = 1_000_000  # characters counted at once
BATCH = 100_000  # n-grams made strings at once
SYMBOLS = 1_114_112  # what the unigrams leave goes evenly to all of Unicode's code points
_SENT = "pid int, chunk int, part int, crc long, low binary"
_BACK = "pid int, chunk int, part int, crc long, hits binary"


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of all texts: code points (each piece after its ORDER - 1 characters of context), text number and length by piece."""
    at, size, held = [], 0, []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(c == 0, np.uint32(0xFFFD), c), np.array([i for i, _ in at], np.int64), np.array([n for _, n in at], np.int64)

    for i, t in enumerate(texts):
        for k in range(0, len(t), BLOCK):
            part = t[k : k + BLOCK]
            if held and size + len(part) > BLOCK:
                yield block()
                at, size, held = [], 0, []
            held.append((t[k - ORDER + 1 : k] if k else START * (ORDER - 1)) + part)
            at.append((i, len(part)))
            size += len(part)
    if held:
        yield block()


def _starts(n: np.ndarray) -> np.ndarray:
    """Places of the n-grams that lie in one piece."""
    size = n + ORDER - 1
    ok = np.ones(int(size.sum()), bool)
    ends = np.cumsum(size)
    for k in range(1, ORDER):
        ok[ends - k] = False
    return np.flatnonzero(ok)


def _keys(c: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """A number for the n-gram from each place that is equal just for equal n-grams, and the alphabet that decodes it.

    With too large an alphabet for that it is a 64-bit hash and can't be decoded.
    """
    count = np.bincount(c)
    alphabet = np.flatnonzero(count)
    size = len(c) - ORDER + 1
    if len(alphabet) ** ORDER >= 2**63:
        return _hash(np.lib.stride_tricks.sliding_window_view(c, ORDER)), None
    rank = np.zeros(len(count), np.uint64)
    rank[alphabet] = np.arange(len(alphabet))
    r, key = rank[c], np.zeros(size, np.uint64)
    for k in range(ORDER):
        key *= np.uint64(len(alphabet))
        key += r[k : k + size]
    return key, alphabet


def _hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of rows of code points, their number included; two different n-grams agree with probability 2**-64."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + grams[:, k].astype(np.uint64) + np.uint64(1))
    return h


def _distinct(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (rows of code points), their counts, their sorted keys and the key of each place."""
    keys, alphabet = _keys(c)
    keys = keys[at]
    if alphabet is None:
        u, first, count = np.unique(keys, return_index=True, return_counts=True)
        return c[at[first][:, None] + np.arange(ORDER)], count, u, keys
    u, count = np.unique(keys, return_counts=True)
    out, rest, base = np.empty((len(u), ORDER), np.uint32), u, np.uint64(len(alphabet))
    for k in range(ORDER - 1, -1, -1):
        rest, last = np.divmod(rest, base)
        out[:, k] = alphabet[last.astype(np.int64)]
    return out, count, u, keys


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with their texts, none of more than CHUNK bytes of UTF-8 unless a single text is."""
    for b in batches:
        texts = b.column(b.schema.get_field_index("text"))
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, side="right")))
            yield b.slice(at, end - at), [t or "" for t in texts.slice(at, end - at).to_pylist()]
            at = end


def _strings(grams: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel().tolist(), pa.string())


def _count(texts: DataFrame) -> DataFrame:
    """gram, c: distinct n-grams of all texts with their counts, block by block and then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in chunks(batches):
            for c, _, n in _pieces(t):
                grams, count, _, _ = _distinct(c, _starts(n))
                for k in range(0, len(grams), BATCH):
                    yield pa.RecordBatch.from_arrays([_strings(grams[k : k + BATCH]), pa.array(count[k : k + BATCH], pa.int64())], names=["gram", "c"])

    return texts.select("text").mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def model_tables(trusted: DataFrame, path: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Unigram-to-ORDER tables: probabilities (gram, p) by order, and back-off weights (ctx, g) by context length."""
    counts = [written(_count(trusted), "counts", path)]
    for n in range(ORDER - 1, 0, -1):  # continuation counts
        counts.append(counts[-1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    counts = counts[::-1]
    probs, backs = [], []
    for n, t in enumerate(counts, 1):
        k = t.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).head()
        y = k.n1 / (k.n1 + 2 * k.n2) if k.n1 and k.n2 else 0.5
        d = [min(i, max(0.05, i - (i + 1) * y * b / a)) if a and b else 0.5 for i, a, b in ((1, k.n1, k.n2), (2, k.n2, k.n3), (3, k.n3, k.n4))]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = t.withColumn("ctx", F.substring("gram", 1, n - 1)).withColumn("off", off)
        ctx = t.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("g"))
        t = t.join(ctx, "ctx").withColumn("own", (F.col("c") - F.col("off")) / F.col("total"))
        if n == 1:
            t = t.withColumn("p", F.col("own") + F.col("g") / SYMBOLS)
        else:
            t = t.join(probs[-1].withColumnRenamed("gram", "_s").withColumnRenamed("p", "_p"), F.substring("gram", 2, n - 1) == F.col("_s")).withColumn("p", F.col("own") + F.col("g") * F.col("_p"))
        probs.append(written(t.select("gram", "p"), f"p{n}", path))
        backs.append(written(ctx.select("ctx", "g"), f"g{n}", path))
    return probs, backs


def model_rows(probs: list[DataFrame], backs: list[DataFrame]) -> DataFrame:
    """gram, p (null: not seen), g (null: not seen as a context), for n-grams of all orders but the empty one."""
    out = None
    for n in range(1, ORDER + 1):
        t = probs[n - 1]
        if n < ORDER:
            t = t.join(backs[n].withColumnRenamed("ctx", "gram"), "gram", "full")
        else:
            t = t.withColumn("g", F.lit(None).cast("double"))
        out = t.select("gram", "p", "g") if out is None else out.unionByName(t.select("gram", "p", "g"))
    return out


class Grams:
    """The distinct n-grams of a chunk and, order by order, their distinct suffixes with what has to be looked up for them."""

    def __init__(self, grams: np.ndarray) -> None:
        self.orders = []  # (hash, hash of the context, place of the suffix in the next lower order), from ORDER down
        while True:
            own, ctx = _hash(grams), _hash(grams[:, :-1])
            if grams.shape[1] == 1:
                self.orders.append((own, None, None))
                break
            low = grams[:, 1:]
            _, first, place = np.unique(_hash(low), return_index=True, return_inverse=True)
            self.orders.append((own, ctx, place))
            grams = low[first]

    def keys(self) -> np.ndarray:
        return np.unique(np.concatenate([x for own, ctx, _ in self.orders for x in (own, ctx) if x is not None]))

    def logs(self, keys: np.ndarray, p: np.ndarray, g: np.ndarray, rest: float) -> np.ndarray:
        """Log probability of each n-gram from the looked up values, NaN where there are none; rest: what an unseen character gets."""
        low = None
        for own, ctx, place in reversed(self.orders):
            mine = p[np.searchsorted(keys, own)].astype(np.float64)
            if low is None:
                back = np.full(len(own), rest)
            else:
                w = g[np.searchsorted(keys, ctx)].astype(np.float64)
                back = np.where(np.isnan(w), 1.0, w) * low[place]
            low = np.where(np.isnan(mine), back, mine)
        return np.log(low)


class _Chunk:
    """Texts of a chunk as blocks over the chunk's distinct n-grams."""

    def __init__(self, texts: list[str], places: bool) -> None:
        blocks, every, hashes = [], [], []
        for c, text, n in _pieces(texts):
            grams, _, u, keys = _distinct(c, _starts(n))
            every.append(grams)
            hashes.append(_hash(grams))
            blocks.append((text, n, _places(u, keys) if places else None))
        self.grams = None
        if not blocks:
            return
        hashes_ = np.concatenate(hashes)
        u, first = np.unique(hashes_, return_index=True)
        self.grams = Grams(np.concatenate(every)[first])
        self.blocks = [(text, n, np.searchsorted(u, h), at) for (text, n, at), h in zip(blocks, hashes)]

    def sums(self, logp: np.ndarray, n_texts: int) -> np.ndarray:
        """Sum of the logs by text."""
        out = np.zeros(n_texts)
        for text, n, mine, at in self.blocks:
            each = logp[mine][at]
            np.add.at(out, text, np.add.reduceat(each, np.cumsum(n) - n))
        return out


def _asked(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    return [(k, x) for k, x in enumerate(np.split(keys, _cuts(keys, parts))) if len(x)]


def perplexities(docs: DataFrame, trusted: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Per document: doc_id, carry, n_chars, perplexity."""
    spark = docs.sparkSession
    path = path or work_dir(spark)
    rows = docs.select("doc_id", *carry, F.col("text").cast("string").alias("text"))
    parts = parts_for(rows)
    probs, backs = model_tables(trusted, path)
    over = backs[0].head()  # the empty context, one row
    rest = (over.g if over else 1.0) / SYMBOLS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([-(-(k << 64) // parts) for k in range(1, parts)], np.uint64)
        for b in batches:
            text = b.column(b.schema.get_field_index("gram")).to_pylist()
            size, h = np.array([len(x) for x in text]), np.zeros(len(text), np.uint64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                c = np.frombuffer("".join([text[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32)
                h[at] = _hash(c.reshape(-1, n))
            value = [b.column(b.schema.get_field_index(x)).cast(pa.float32()) for x in ("p", "g")]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, h, side="right"), pa.int32()), pa.array(h.view(np.int64)), *value], names=["part", "h", "p", "g"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = _pid()
        for no, (_, t) in enumerate(chunks(batches)):
            x = _Chunk(t, False)
            if x.grams:
                keys = x.grams.keys()
                crc = _crc(keys)
                out = [(pid, no, k, crc, y.tobytes()) for k, y in _asked(keys, parts)]
                yield pa.RecordBatch.from_arrays([pa.array(y, k) for y, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["pid", "chunk", "part", "crc", "low"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        h = np.array(known["h"], np.int64).view(np.uint64)
        order = np.argsort(h)
        h = h[order]
        values = [np.concatenate([known[x].to_numpy().astype(np.float32)[order], np.full(1, np.nan, np.float32)]) for x in ("p", "g")]
        hits = []
        for x in asked["low"].to_pylist():
            u = np.frombuffer(x, np.uint64)
            at = np.minimum(np.searchsorted(h, u), len(h))
            if len(h):
                at = np.where(h[np.minimum(at, len(h) - 1)] == u, at, len(h))
            hits.append(b"".join(v[at].tobytes() for v in values))
        return pa.table({"pid": asked["pid"], "chunk": asked["chunk"], "part": asked["part"], "crc": asked["crc"], "hits": pa.array(hits, pa.binary())})

    back = f"{path}/answers"
    known = model_rows(probs, backs).mapInArrow(hashed, "part int, h long, p float, g float")
    asked = rows.select("text").mapInArrow(send, _SENT)
    asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, _BACK).repartition(parts, "pid").write.partitionBy("pid").parquet(back)

    kinds = {f.name: f for f in rows.schema.fields}
    from pyspark.sql.pandas.types import to_arrow_type

    keep = ["doc_id", *carry]
    schema = pa.schema([*[pa.field(c, to_arrow_type(kinds[c].dataType)) for c in keep], pa.field("n_chars", pa.int64()), pa.field("perplexity", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Answers(back, _pid(), parts)
        for no, (b, t) in enumerate(chunks(batches)):
            x, n = _Chunk(t, True), [len(y) for y in t]
            value: list = [None] * len(t)
            if x.grams:
                keys = x.grams.keys()
                crc, p, g = _crc(keys), [], []
                for k, u in _asked(keys, parts):
                    was, hits = held.rows.get((no, k), (None, b""))
                    if was != crc:
                        raise RuntimeError("the documents came in another order than before; write them to a table first")
                    both = np.frombuffer(hits, np.float32)
                    p.append(both[: len(u)])
                    g.append(both[len(u) :])
                total = x.sums(x.grams.logs(keys, np.concatenate(p), np.concatenate(g), rest), len(t))
                value = [float(np.exp(-s / m)) if m else None for s, m in zip(total, n)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(n, pa.int64()), pa.array(value, pa.float64())], schema=schema)

    ddl = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(score, f"{ddl}, n_chars long, perplexity double")


def _places(u: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index in sorted u of each key: by a direct table on mixed bits, by search where several share a slot."""
    slot = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)
    table = np.zeros(1 << 20, np.int32)
    table[slot(u)] = np.arange(len(u))
    out = table[slot(keys)]
    miss = np.flatnonzero(u[out] != keys)
    out[miss] = np.searchsorted(u, keys[miss])
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, small: int = 2_000_000) -> DataFrame:
    """Per document: doc_id, lang, n_chars, perplexity, threshold, keep. Trusted: labelled quality 1 and not toxic."""
    base = work_dir(docs.sparkSession)
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t")).filter("_q = 1 and coalesce(_t, 0) = 0").select("doc_id")
    good = written(good, "trusted", base)
    side = F.broadcast(good) if good.count() <= small else good
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 0
    trusted = docs.join(side, "doc_id", "left_semi")
    scored = written(perplexities(docs, trusted.filter(~held).select("text"), base), "scored", base)
    if docs.sparkSession.read.parquet(f"{base}/counts").isEmpty():
        scored = scored.withColumn("perplexity", F.lit(None).cast("double"))
    mine = scored.join(side, "doc_id", "left_semi").filter(held & F.col("perplexity").isNotNull())
    by = mine.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("_own"))
    every = mine.agg(F.percentile_approx("perplexity", quantile, 10_000)).head()[0]
    out = scored.join(F.broadcast(by) if by.limit(10_001).count() <= 10_000 else by, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    out = out.withColumn("threshold", F.coalesce("_own", F.lit(every).cast("double")))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("keep"))
