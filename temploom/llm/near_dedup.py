"""SimHash near-dedup by the May-Ozerov recursion.

A text's shingles are runs of ``SHINGLE`` words (lower-cased in ASCII; a shorter text is one shingle); texts with equal shingle sets are one
representative. The fingerprint has 128 bits. In a repetition each level takes a strip of seven random coordinates and keeps, for
each of sixteen centres, the fingerprints whose partial weight after adding the centre is at most one; with the perfect code's words
(shifted at random) as centres these lists part their input evenly, and each list goes on to the next level's strip until lists are
short. Levels and repetitions follow the length of the list that is parted, all representatives at first; a list that is still longer than a block is
parted again, with fresh strips, levels and repetitions of its own. Short lists are compared by brute force. Repetitions go on until a
pair at the similarity bound is missed with a probability of at most 1 - ``recall``, on average over how many bits such a pair differs in
and by the radius too, for texts of few shingles (whose bits tie) as for long ones.

Lists of fingerprints that lie close together can't be parted by strips, nor need they be compared in pairs: ``LEADERS`` members of a long
list are compared with all; the rows within reach of the largest group of leaders are one group thereby, and only the rest is
compared with the whole list, block by block. The result is the same as that of all pairs, the work in proportion to the list.

Candidates (fingerprints within ``radius`` bits of texts whose numbers of shingles the bound allows) only form provisional groups; of a list a spanning forest is passed on, not its pairs. Inside a
provisional group every close pair that isn't linked yet is verified on the shingle sets (Jaccard of at least ``similarity``), so no link
is lost to the forest, and verified links alone make the classes; groups longer than a block go by leaders, as lists do. Connected
components are found by alternating star operations on tables in the shared folder; nothing but counts comes to the driver.

Nulls: a null text is empty. Texts without words are in no group: their class is their own doc_id. A class is named by its least
doc_id, so it is null only if all are. Repeated rows are copies of each other. Empty table: no rows. The rows are located
by their place in the input's partitions; the second pass checks that it sees the same texts there.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from temploom.llm.common import hot_join, parts_for, work_dir, written
from temploom.llm.substring_dedup import _mix, _pid, rolling, word_hashes

SHINGLE = 5
FEW = 16  # shingles; sets of no more are looked at one by one for their share of differing bits
LIST = 2000
BLOCK = 8192
VERIFY_BLOCK = 1024
LEADERS = 32
ROUNDS = 12
_G = np.array([0b1101000, 0b0110100, 0b1110010, 0b1010001], np.uint8)  # generators of the [7, 4] code


def _decode_table() -> np.ndarray:
    """Nearest code word (0-15) of each of the 128 strips."""
    words = [int(np.bitwise_xor.reduce(_G[[i for i in range(4) if m >> i & 1]])) if m else 0 for m in range(16)]
    return np.array([next(i for i, w in enumerate(words) if (w ^ x).bit_count() <= 1) for x in range(128)], np.int64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes."""
    wh = word_hashes((text or "").encode().lower())
    return np.unique(rolling(wh, min(SHINGLE, len(wh)))) if len(wh) else wh


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    out = []
    for x in (h, _mix(h + np.uint64(0x9E3779B97F4A7C15))):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(x), 65_536):
            ones += np.unpackbits(x[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h)).view("<i8")[0]))
    return out[0], out[1]


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """pid, idx, doc_id, digest of the shingle set, fingerprint words a and b, n (shingles), carry (as strings)."""
    schema = pa.schema([("pid", pa.int32()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), *((c, pa.string()) for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at = _pid(), 0
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingles(t)
                rows.append((pid, at, i, _digest(h), *fingerprint(h), len(h)))
                at += 1
            if rows:
                yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], *[b.column(2 + k).cast(pa.string()) for k in range(len(carry))]], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in carry])
    return rows.mapInArrow(run, ", ".join(["pid int, idx int, doc_id long, digest binary, a long, b long, n int", *[f"`{c}` string" for c in carry]]))


def _digest(h: np.ndarray) -> bytes:
    """128 bits of a shingle set."""
    import hashlib

    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _share(both: int, a: int, b: int) -> float:
    """Share of bits in which two sets differ that have ``both`` shingles in common and a and b of their own."""

    def ones(c: int, own: int) -> float:  # probability that a bit is set where c of the common shingles set it
        return sum(math.comb(own, x) for x in range(own + 1) if 2 * (c + x) > both + own) / 2**own

    return sum(math.comb(both, c) / 2**both * ((p := ones(c, a)) + (q := ones(c, b)) - 2 * p * q) for c in range(both + 1))


def worst_share(similarity: float) -> float:
    """Greatest share of differing bits of pairs at the bound or above: of large sets, or of sets of few shingles, where ties add."""
    few = [_share(both, a, b) for both in range(1, FEW + 1) for a in range(FEW + 1 - both) for b in range(a, FEW + 1 - both) if a + b and both >= similarity * (both + a + b)]
    return max([math.acos(2 * similarity / (1 + similarity)) / math.pi, *few])


def distances(p: float) -> list[float]:
    """Probability of each number of differing bits."""
    return [math.comb(128, d) * p**d * (1 - p) ** (128 - d) for d in range(129)]


def radius(recall: float, similarity: float) -> int:
    """Least number of bits beyond which at most a quarter of 1 - recall of the pairs at the bound lie."""
    w = distances(worst_share(similarity))
    return next(r for r in range(129) if sum(w[r + 1 :]) <= (1 - recall) / 4)


def plan(n: int, recall: float, similarity: float) -> tuple[int, int]:
    """Levels and repetitions for n representatives."""
    levels = max(0, math.ceil(math.log(max(1.0, n / LIST)) / math.log(16)))
    if not levels:
        return 0, 1
    w, most = distances(worst_share(similarity)), radius(recall, similarity)

    def stay(p: float) -> float:  # both in one ball of the code
        q = 1 - p
        return (q**7 + 7 * p * q**6) / 8 + 7 / 8 * (q**7 + p * q**6 + 6 * p * p * q**5)

    through = [stay(d / 128) ** levels for d in range(most + 1)]
    enough = lambda times: sum(w[most + 1 :]) + sum(v * (1 - s) ** times for v, s in zip(w, through)) <= 1 - recall
    high = 1
    while not enough(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return levels, high


def _spread(rows: DataFrame, recall: float, similarity: float, seed: int) -> DataFrame:
    """bucket, m, rid, a, b, n: rows in the lists that their list of m rows is parted into, with m as it was."""
    table, weights = _decode_table(), 1 << np.arange(6, -1, -1)
    sizes = {1 << k: plan(1 << k, recall, similarity) for k in range(44)}
    plans: dict[int, list] = {}

    def strips(size: int) -> list:
        """By length class, a power of two, so that all tasks part a list alike."""
        if size not in plans:
            levels, times = sizes[size]
            rnd = np.random.default_rng([seed, size])
            plans[size] = [(rnd.permutation(128)[: 7 * levels].reshape(levels, 7), rnd.integers(0, 128, levels)) for _ in range(times)]
        return plans[size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was, m, rid, a, b, n_ = (np.array(batch.column(batch.schema.get_field_index(x)), np.int64) for x in ("bucket", "m", "rid", "a", "b", "n"))
            bits = np.unpackbits(np.stack([a, b], 1).view(np.uint8), axis=1).reshape(len(rid), 128)
            size = 1 << np.ceil(np.log2(np.maximum(m, 1))).astype(np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                for k, (coords, shift) in enumerate(strips(int(n))):
                    code = np.full(len(at), k, np.uint64)
                    for level in range(len(coords)):
                        code = code * np.uint64(16) + table[(bits[at][:, coords[level]] @ weights) ^ shift[level]].astype(np.uint64)
                    bucket = _mix(was[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + code).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, m[at], rid[at], a[at], b[at], n_[at].astype(np.int32))], names=["bucket", "m", "rid", "a", "b", "n"])

    return rows.select("bucket", "m", "rid", "a", "b", "n").mapInArrow(run, "bucket long, m long, rid long, a long, b long, n int")


def candidates(reps: DataFrame, n: int, recall: float, similarity: float, path: str, seed: int = 11) -> DataFrame:
    """Edges x < y between representatives (rid, a, b, n) that may be similar by fingerprints and sizes: a forest of each list."""
    most, found = radius(recall, similarity), []
    rows = _spread(reps.select(F.lit(0).cast("long").alias("bucket"), F.lit(n).cast("long").alias("m"), "rid", "a", "b", "n"), recall, similarity, seed)
    for k in range(ROUNDS):
        edges, rest = _linked(rows, "bucket", BLOCK, _Links(most, similarity), f"{path}/lists{k}", part=k < ROUNDS - 1)
        found.append(edges)
        if rest is None:
            break
        # What a list loses by being parted again comes on top of what its repetition loses, so it's kept small.
        rows = _spread(rest, 1 - (1 - recall) / 10, similarity, seed + k + 1)
    out = found[0]
    for e in found[1:]:
        out = out.union(e)
    return out.distinct()


class _Links:
    """Which rows of a group belong together: close fingerprints and sizes that the bound allows, with ``exact`` similar shingle sets too."""

    def __init__(self, most: int, similarity: float, exact: bool = False) -> None:
        self.most, self.similarity, self.exact = most, similarity, exact
        self.columns = ("rid", "a", "b", "n", *["set"] * exact)

    def _load(self, t: pa.Table) -> tuple:
        rid = np.array(t["rid"], np.int64)
        order = np.argsort(rid, kind="stable")
        f = np.stack([np.array(t["a"], np.int64)[order], np.array(t["b"], np.int64)[order]], 1).view(np.uint64)
        sets = None
        self.size = np.array(t["n"], np.int64)[order]
        if self.exact:
            raw = t["set"]
            sets = [np.frombuffer(raw[int(k)].as_py(), np.uint32) for k in order]
        return order, rid[order], f, sets

    def _join(self, label: np.ndarray, f: np.ndarray, sets: list | None, left: np.ndarray, right: np.ndarray) -> None:
        """Unite the labels of linked rows of left and right (places, ascending)."""
        step = 512 if sets is None else 256
        same = left is right
        for i in range(0, len(left), step):
            p = left[i : i + step]
            for j in range(i if same else 0, len(right), step):
                q = right[j : j + step]
                x, y = self._near(f, p, q)
                ok = (x != y) & (label[x] != label[y])
                x, y = x[ok], y[ok]
                if sets is None:
                    # Pairs inside a group found so far drop out at once, so dense lists cost no loop over their pairs.
                    while len(x):
                        self._unite(label, x[0], y[0])
                        ok = label[x] != label[y]
                        x, y = x[ok], y[ok]
                    continue
                for u, v in zip(x, y):
                    if label[u] != label[v] and self._similar(sets[u], sets[v]):
                        self._unite(label, u, v)

    def _near(self, f: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = _close(f, p, q, self.most)
        ok = np.minimum(self.size[x], self.size[y]) >= self.similarity * np.maximum(self.size[x], self.size[y])
        return x[ok], y[ok]

    def _similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = _common(a, b)
        return both >= self.similarity * (len(a) + len(b) - both)

    @staticmethod
    def _unite(label: np.ndarray, u: int, v: int) -> None:
        a, b = sorted((int(label[u]), int(label[v])))
        label[label == b] = a

    def forest(self, t: pa.Table) -> pa.Table:
        """Edges of a group; with a column ``other``, only links between rows where it is 0 and where it is 1 are looked for."""
        order, rid, f, sets = self._load(t)
        label = np.arange(len(rid))
        if "other" in t.column_names:
            other = np.array(t["other"], np.int64)[order]
            twin = np.flatnonzero(rid[1:] == rid[:-1])  # a row may be on both sides
            label[twin + 1] = label[twin]
            self._join(label, f, sets, np.flatnonzero(other == 0), np.flatnonzero(other == 1))
        else:
            every = np.arange(len(rid))
            self._join(label, f, sets, every, every)
        loose = np.flatnonzero(rid[label] != rid)
        return pa.table({"x": pa.array(rid[label[loose]], pa.int64()), "y": pa.array(rid[loose], pa.int64())})

    def led(self, t: pa.Table) -> pa.Table:
        """Of a block and its list's leaders (``other`` is 0): edges to the leaders' largest group; rows without have a null x."""
        order, rid, f, sets = self._load(t)
        other = np.array(t["other"], np.int64)[order]
        heads, rows = np.flatnonzero(other == 0), np.flatnonzero(other == 1)
        label = np.arange(len(rid))
        self._join(label, f, sets, heads, heads)
        groups, count = np.unique(label[heads], return_counts=True)
        root = groups[int(count.argmax())]
        first = heads[label[heads] == root]
        mine = np.zeros(len(rid), bool)
        for i in range(0, len(rows), 512):
            x, y = self._near(f, rows[i : i + 512], first)
            if sets is None:
                mine[x] = True
            else:
                for u, v in zip(x, y):
                    if not mine[u] and self._similar(sets[u], sets[v]):
                        mine[u] = True
        key = t.column_names[0]
        return pa.table({"key": pa.array([t[key][0].as_py()] * len(rows), pa.int64()), "x": pa.array(np.where(mine[rows], rid[root], -1), pa.int64()), "y": pa.array(rid[rows], pa.int64())})


def _linked(rows: DataFrame, key: str, block: int, links: _Links, path: str, part: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """A forest of the linked rows of each group (key), and with part those long groups, as rows with their length m, that are neither
    close together nor failed to shrink when they were parted last (m)."""
    spread = "m" in rows.columns
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *([F.max("m").alias("_was")] if spread else [])).filter(F.col("_n") > block)
    sizes = written(sizes.withColumnRenamed(key, "_k"), "long", path)
    plain = rows.select(key, *links.columns)
    if sizes.isEmpty():
        return plain.groupBy(key).applyInArrow(lambda t: links.forest(t), "x long, y long"), None
    few = sizes.limit(100_001).count() <= 100_000
    side = F.broadcast(sizes) if few else sizes
    short = plain.join(side, F.col(key) == F.col("_k"), "left_anti").groupBy(key).applyInArrow(lambda t: links.forest(t), "x long, y long")
    long_ = written(plain.join(side, F.col(key) == F.col("_k")).withColumn("_nb", F.ceil(F.col("_n") / block).cast("int")).drop("_k"), "rows", path)
    own = F.pmod(F.xxhash64("rid"), F.col("_nb")).cast("int")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("rid", F.lit(1)), "rid"))
    heads = long_.withColumn("_r", rank).filter(F.col("_r") <= LEADERS).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).withColumn("other", F.lit(0))
    blocks = long_.withColumn("_block", own).withColumn("other", F.lit(1))
    cols = [key, "_block", *links.columns, "other"]
    led = heads.select(cols).unionByName(blocks.select(cols)).groupBy(key, "_block").applyInArrow(lambda t: links.led(t), "key long, x long, y long")
    led = written(led, "led", path)
    edges = short.union(led.filter("x >= 0 and x <> y").select("x", "y"))
    out = written(led.filter("x < 0").groupBy("key").agg(F.count(F.lit(1)).alias("_out")), "outside", path)
    if out.isEmpty():
        return edges, None
    # Groups that their leaders leave too much of go on to be parted, if parting helps.
    rest = None
    out = out.join(sizes, F.col("key") == F.col("_k")).drop("_k")
    if part and spread:
        go = (F.col("_out") > 4 * block) & (F.col("_n") * 2 <= F.col("_was"))
        again = written(out.filter(go).select(F.col("key").alias("_k"), F.col("_n").alias("m")), "again", path)
        if not again.isEmpty():
            rest = long_.drop("_n", "_was", "_nb").join(F.broadcast(again) if few else again, F.col(key) == F.col("_k")).drop("_k")
        out = out.filter(~go)
    out = out.select("key", F.ceil(F.col("_out") / block).cast("int").alias("_ob"), F.ceil(F.col("_n") / block).cast("int").alias("_nb"))
    out = F.broadcast(out) if few else out
    outside = led.filter("x < 0").select(F.col("key").alias("_k2"), F.col("y").alias("_y"))
    base = long_.drop("_n", "_was", "_nb").join(out, F.col(key) == F.col("key"))
    left = base.join(outside, (F.col(key) == F.col("_k2")) & (F.col("rid") == F.col("_y")), "left_semi")
    left = left.withColumn("bi", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("_ob")).cast("int")).withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).withColumn("other", F.lit(0))
    right = base.withColumn("bj", F.pmod(F.xxhash64("rid"), F.col("_nb")).cast("int")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("_ob") - 1))).withColumn("other", F.lit(1))
    cols = [F.col(key).alias("group"), "bi", "bj", *links.columns, "other"]
    both = left.select(cols).unionByName(right.select(cols)).groupBy("group", "bi", "bj").applyInArrow(lambda t: links.forest(t), "x long, y long")
    return edges.union(both), rest


def _close(f: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of p and q whose fingerprints differ in at most ``most`` bits."""
    d = np.bitwise_count(f[p][:, None, 0] ^ f[q][None, :, 0]) + np.bitwise_count(f[p][:, None, 1] ^ f[q][None, :, 1])
    x, y = np.nonzero(d <= most)
    return p[x], q[y]


def components(edges: DataFrame, path: str, most: int = 60) -> DataFrame:
    """node, root (the least node of its component) for nodes other than roots, from edges x < y."""
    e = written(edges.select("x", "y").distinct(), "edges0", path)
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).head())
    was = state(e)
    for k in range(1, most + 1):
        both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy(F.col("x").alias("u")).agg(F.least(F.min("x"), F.min("y")).alias("m"))
        big = both.join(least, F.col("x") == F.col("u")).filter(F.col("y") > F.col("x")).select("y", "m").distinct()
        low = big.groupBy(F.col("y").alias("v")).agg(F.min("m").alias("mm"))
        small = big.join(low, F.col("y") == F.col("v"))
        e = small.select(F.col("mm").alias("x"), F.col("m").alias("y")).filter("x < y").union(low.select(F.col("mm").alias("x"), F.col("v").alias("y"))).distinct()
        e = written(e, f"edges{k}", path)
        now = state(e)
        if now == was:
            return e.select(F.col("y").alias("node"), F.col("x").alias("root"))
        was = now
    raise RuntimeError("components did not settle")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _member_sets(docs: DataFrame, members: str) -> DataFrame:
    """rid, group, fingerprint and shingle set of the rows that the table (partitioned by pid) lists; only those leave a task."""
    schema = pa.schema([("rid", pa.int64()), ("root", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        from temploom.llm.token_output import _fs

        fs, root = _fs(f"{members}/pid={_pid()}")
        if fs.get_file_info(root).type.name == "NotFound":
            if fs.get_file_info(f"{_fs(members)[1]}/_SUCCESS").type.name == "NotFound":
                raise RuntimeError(f"{members} isn't there or isn't whole")
            return  # no member in this partition
        mine = {r["idx"]: r for r in ds.dataset(root, filesystem=fs, format="parquet").to_table().to_pylist()}
        at = 0
        for b in batches:
            rows = []
            for k, t in enumerate(b.column(0)):
                if r := mine.get(at + k):
                    h = shingles(t.as_py())
                    if _digest(h) != r["digest"]:
                        raise RuntimeError("the documents came in another order than before; write them to a table first")
                    rows.append((r["rid"], r["root"], r["a"], r["b"], r["n"], np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes()))
            at += b.num_rows
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "rid long, root long, a long, b long, n int, set binary")


def near_classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.98, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class), class_size, kept (one row of each class), carry (as strings)."""
    spark: SparkSession = docs.sparkSession
    path = work_dir(spark)
    rows = written(features(docs, carry), "features", path)
    group = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "pid", "idx")
    reps = rows.filter("n > 0").groupBy("digest").agg(F.min(group).alias("first"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    reps = reps.withColumn("rid", (F.col("first.pid").cast("long") * 2**32 + F.col("first.idx")))
    reps = written(reps, "reps", path)
    n = reps.count()
    loose = components(candidates(reps, n, recall, similarity, path), f"{path}/loose")
    members = loose.union(loose.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(reps, F.col("node") == F.col("rid")).select(F.col("first.pid").alias("pid"), F.col("first.idx").alias("idx"), "digest", "rid", "root", "a", "b", "n")
    members.repartition(parts_for(docs), "pid").write.partitionBy("pid").parquet(f"{path}/members")
    sets = written(_member_sets(docs, f"{path}/members"), "sets", path)
    links, _ = _linked(sets, "root", VERIFY_BLOCK, _Links(radius(recall, similarity), similarity, exact=True), f"{path}/verify")
    final = components(links, f"{path}/final")
    named = reps.join(final, F.col("rid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rid"))
    class_ = named.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    by = written(named.select("digest", "root", "copies").join(class_, "root").select("digest", "head", "class_size", "copies"), "classes", path)
    out = hot_join(rows.filter("n > 0"), by, "digest", "copies", n_rows=by.agg(F.coalesce(F.sum("copies"), F.lit(0))).head()[0], how="inner")
    out = out.select("doc_id", F.col("head.doc_id").alias("class_id"), "class_size", ((F.col("pid") == F.col("head.pid")) & (F.col("idx") == F.col("head.idx"))).alias("kept"), *carry)
    alone = rows.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), *carry)
    return out.unionByName(alone)
