"""Line dedup by a log-template tree: lines whose template recurs across documents are dropped.

Variable fields (tokens with a digit) become ``<*>`` and white space one space. The tree has fixed depth: number of tokens, then the
leading tokens; in a leaf lines join the most similar template if at least ``threshold`` of the positions agree, which then turns the
others into ``<*>``. A template that ``least`` different texts or more have is boilerplate, and all of its lines go. Lines of a leaf are
folded in the order of their masked text, so results don't depend on partitioning.

Lines are masked once and kept as a table in the shared folder. Before the fold they are thinned without loss: leaves that fewer
texts reach cannot hold such a template, equal masked lines are one, and of a line's texts the ``least`` smallest suffice (a union has
``least`` members just if that of those has). The fold streams sorted rows and holds one leaf's templates, found by an index and not by
a scan. The places of bad lines are gathered by text, and each text drops its own.

Texts and masked lines are told apart by two 64-bit hashes with different seeds (two differing ones agree with probability 2**-128).
Copies of a text are one to the count, as their repetition is exact dedup's business.

Nulls: a null text stays null with no lines. Blank lines are kept and not counted. doc_id is a name only: null and repeated ones are
fine, and repeated rows are given back as often as they came. Empty table: no rows. Extra columns aren't read.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from temploom.llm.common import work_dir, written
from temploom.operators.fold import LeafFold

SMALL = 16_000_000  # bytes of keys up to which a side is broadcast
_ROW = 48  # bytes that a row of hashes takes at most


def masked(line: Column) -> Column:
    """The line with single spaces and ``<*>`` for each token with a digit. Most lines need no replacement and are scanned once."""
    s = F.trim(F.regexp_replace(line, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "))
    # A token is scanned once, from its start.
    return F.when(line.rlike(r"[0-9\x09-\x0D]|\x20\x20"), F.regexp_replace(s, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(F.trim(line))


def leaf(m: Column) -> Column:
    """Number of tokens and the two leading ones."""
    n = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
    return F.concat_ws(" ", n.cast("string"), F.substring_index(m, " ", 2))


def _key(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"))


def lines_of(docs: DataFrame, path: str) -> DataFrame:
    """_a, _b (the text), pos, m, _c, _d (hashes of m), lh (hash of the leaf) of all lines that aren't blank, written to the shared folder."""
    rows = _key(docs).filter("text is not null").select("_a", "_b", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("_a", "_b", "pos", masked(F.col("line")).alias("m")).filter("m != ''")
    rows = rows.select("*", F.xxhash64("m").alias("_c"), F.xxhash64(F.lit(1), F.col("m")).alias("_d"), F.xxhash64(leaf(F.col("m"))).alias("lh"))
    rows.write.option("compression", "zstd").parquet(f"{path}/lines")
    return docs.sparkSession.read.parquet(f"{path}/lines")


def _side(df: DataFrame) -> DataFrame:
    """Rows of hashes, broadcast if they take at most SMALL bytes by their number."""
    return F.broadcast(df) if df.count() * _ROW <= SMALL else df


def recurring(lines: DataFrame, least: int, threshold: float, path: str) -> DataFrame:
    """m, template: masked lines whose template ``least`` texts have."""
    leaves = lines.select("lh", "_a", "_b").distinct().groupBy("lh").count().filter(F.col("count") >= least).select("lh")
    leaves = written(leaves, "leaves", path)
    few = lines.join(_side(leaves), "lh", "left_semi").select("m", "_a", "_b").distinct()
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("m").orderBy("_a", "_b"))).filter(F.col("_r") <= least)
    each = few.groupBy("m").agg(F.collect_list(F.struct("_a", "_b")).alias("ds")).withColumn("leaf", leaf(F.col("m")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, sets = None, None, {}
        schema = pa.schema([("leaf", pa.string()), ("tid", pa.int64()), ("m", pa.string()), ("template", pa.string()), ("n", pa.int64())])
        seq = 0

        def ends() -> list[tuple]:
            return [(at, c.key, None, " ".join(c.texts), len(sets[c.key])) for c in tree.clusters] if tree else []

        for b in batches:
            out = []
            ds = b.column(b.schema.get_field_index("ds"))
            a, c = (ds.values.field(k).to_pylist() for k in (0, 1))
            edge = ds.offsets.to_pylist()
            for k, (name, m) in enumerate(zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("leaf", "m")))):
                if name != at:
                    out += ends()
                    at, tree, sets, seq = name, LeafFold(threshold, 1 << 60, "<*>"), {}, 0
                cluster, _ = tree.add(m, m.split(" "), seq)
                seq += 1
                have = sets.setdefault(cluster.key, set())
                if len(have) < least:
                    have.update(zip(a[edge[k] : edge[k + 1]], c[edge[k] : edge[k + 1]]))
                out.append((name, cluster.key, m, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)
        if tree:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*ends()), schema)], schema=schema)

    done = each.repartition("leaf").sortWithinPartitions("leaf", "m").mapInArrow(fold, "leaf string, tid long, m string, template string, n long")
    done = written(done, "fold", path)
    bad = done.filter(F.col("n") >= least).select("leaf", "tid", "template")
    return written(done.filter("m is not null").select("leaf", "tid", "m").join(bad, ["leaf", "tid"]).select("m", "template"), "recurring", path)


def drop_lines(docs: DataFrame, least: int = 4, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, n_lines (not blank), n_dropped, kept_text."""
    path = work_dir(docs.sparkSession)
    lines = lines_of(docs, path)
    bad = recurring(lines, least, threshold, path).select(F.xxhash64("m").alias("_c"), F.xxhash64(F.lit(1), F.col("m")).alias("_d"))
    hits = lines.select("_c", "_d", "_a", "_b", "pos").join(_side(bad), ["_c", "_d"], "left_semi").select("_a", "_b", "pos").distinct()
    hits = hits.groupBy("_a", "_b").agg(F.collect_list("pos").alias("_bad"))
    out = _key(docs).join(hits, ["_a", "_b"], "left").withColumn("_x", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_x") - 1), F.col("_bad"))
    kept = F.when(F.col("_bad").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("_x", i)), "\n"))
    full = F.size(F.filter("_x", lambda s: F.btrim(s, F.lit("\x20\x09\x0a\x0b\x0c\x0d")) != ""))
    n = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    return out.select("doc_id", n(full).alias("n_lines"), n(F.when(F.col("_bad").isNotNull(), F.size("_bad"))).alias("n_dropped"), kept.alias("kept_text"))
