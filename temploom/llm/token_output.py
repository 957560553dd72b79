"""Token ids as Arrow IPC files of fixed-size lists.

Documents in ascending doc_id order are encoded, each followed by the end id, and cut into sequences of ``seq_len`` ids. A shard is an
Arrow IPC file with columns ``ids`` (fixed_size_list<uint16 or uint32>[seq_len]) and ``mask`` (fixed_size_list<bool>[seq_len], false on
the padding after the shard's last id); sequence i of any shard is found by arithmetic in a memory map and both are views of it, without
copies. A second file of the shard lists its documents (doc_id, start inside the shard, n_tokens). Shards are ranges in the order of
the corpus, their number follows the input's size, so ids of all shards in order are the corpus.

Texts are encoded whole by the tokenizers library. Where the tokenizer's file has just the rules that BY_WORD lists, under which a text's
ids are those of its pieces between white space, each distinct piece of a slice of documents goes through the library once; of each slice
one text is also encoded whole and compared. Any other tokenizer encodes every text as one.

A task writes under a name of its own and renames at the end, and what it writes depends on its rows only: a task that runs again
replaces equal files. Nulls: a null text is empty (its one id is the end id); null doc_ids come first. Repeated doc_ids are ordered by
a hash of the text, then the text; equal rows are interchangeable and may be in several shards. Empty table: one or no shard, no rows.
Extra columns aren't read. Memory follows the longest text.
"""
from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temploom.llm.common import parts_for, work_dir
from temploom.sources.store import qualified

BATCH_SEQS = 256
SLICE = 16_000_000  # bytes of text encoded together
SHARD_BYTES = 256_000_000  # of input files
#: Letters that are one pre-token and stay so, and in NFC, in lower case. The one left out of the range, U+0130, gets a combining mark.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
#: ASCII punctuation that after letters is a pre-token of its own: all but the signs that contractions and special tokens use.
_PUNCT = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Rules under which no pre-token spans white space and nothing depends on what is beyond it.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "truncation": None, "padding": None, "post_processor": None,
}


def by_word(rules: dict) -> bool:
    """Whether a tokenizer's file lets a text be encoded piece by piece."""
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) and not re.search(r"\s", t["content"]) for t in rules["added_tokens"])
    return plain and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout") and all(rules.get(k) == v for k, v in BY_WORD.items())


class Encoder:
    """``Tokenizer.encode`` without special tokens, by distinct pieces where the tokenizer's rules allow it.

    Texts are then cut at ASCII white space, which the pre-tokenizer drops anyway, and letters from punctuation after them.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = by_word(json.load(f))
        self.kind = "<u2" if max(self.tok.get_vocab_size(with_added_tokens=True), end_id + 1) <= 65_536 else "<u4"
        self.end = np.array([end_id], self.kind).tobytes()
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    @staticmethod
    def of(path: str, end_id: int) -> Encoder:
        """This Python worker's encoder."""
        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = Encoder(path, end_id)
        return _encoders[path, end_id]

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + self.end

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all pieces in a row, where each piece begins and how many it has.

        Pieces of lower-case letters are one pre-token each and need neither normalization nor the splitting rules, only the byte alphabet
        and the merges: many are encoded as one text and told apart by the ends of words.
        """
        plain = np.asarray(pc.match_substring_regex(pieces, rf"\A{_LETTERS}\z")) & np.asarray(pc.equal(pieces, pc.utf8_lower(pieces)))
        size, order, ids = np.zeros(len(pieces), np.int64), [], []
        places = np.flatnonzero(plain)
        rest = [np.flatnonzero(~plain)]
        for i in range(0, len(places), 1000):
            at = places[i : i + 1000]
            e = np.array(self.plain.encode(" ".join(pieces.take(pa.array(at)).to_pylist()), add_special_tokens=False).ids, self.kind)
            cut = np.flatnonzero(self.ends[e]) + 1
            if len(cut) != len(at) or cut[-1] != len(e):
                rest.append(at)
                continue
            size[at] = np.diff(cut, prepend=0)
            order.append(at)
            ids.append(e)
        at = np.concatenate(rest)
        each = [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(pieces.take(pa.array(at)).to_pylist(), add_special_tokens=False)]
        size[at] = [len(x) for x in each]
        order.append(at)
        ids += each
        start, order_ = np.zeros(len(pieces), np.int64), np.concatenate(order)
        start[order_] = np.cumsum(size[order_]) - size[order_]
        return (np.concatenate(ids) if ids else np.zeros(0, self.kind)), start, size

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text and the end id."""
        if not self.by_word:
            yield from map(self.whole, (t or "" for t in texts.to_pylist()))
            return
        if not len(texts):
            return
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        edge = np.asarray(cut.offsets).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        words, word = coded.dictionary, np.asarray(coded.indices)
        edge -= edge[0]
        stem = pc.ascii_rtrim(words, characters=_PUNCT)
        letters = pc.match_substring_regex(stem, rf"\A{_LETTERS}\z")
        tail = pc.struct_field(pc.extract_regex(words, rf"(?P<t>[{re.escape(_PUNCT)}]*)\z"), "t")
        a = pc.if_else(letters, pc.utf8_lower(stem), words).dictionary_encode()
        b = pc.if_else(letters, tail, "").dictionary_encode()
        ids, start, size = self._pieces(pa.concat_arrays([a.dictionary, b.dictionary]))
        two = np.stack([np.asarray(a.indices), np.asarray(b.indices) + len(a.dictionary)], 1)
        for i in range(0, len(texts), 200):
            mine = edge[i : i + 201]
            seg = two[word[mine[0] : mine[-1]]].ravel()
            n = size[seg]
            upto = np.concatenate([[0], np.cumsum(n)])
            flat = ids[np.repeat(start[seg] - upto[:-1], n) + np.arange(upto[-1])]
            ends = upto[2 * (mine - mine[0])].tolist()
            for k, (x, y) in enumerate(zip(ends, ends[1:])):
                out = flat[x:y].tobytes() + self.end
                if not i + k and out != self.whole(texts[0].as_py() or ""):
                    raise RuntimeError("a text has other ids by its pieces than as a whole")
                yield out


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


_encoders: dict[tuple[str, int], Encoder] = {}


class _Shard:
    """Writer of one shard."""

    def __init__(self, uri: str, name: str, kind: str, seq_len: int) -> None:
        self.fs, root = _fs(uri)
        self.fs.create_dir(root, recursive=True)
        self.final = [f"{root}/{name}.ids.arrow", f"{root}/{name}.docs.arrow"]
        self.tmp = [f"{x}.{uuid.uuid4().hex}" for x in self.final]
        self.kind, self.seq_len, self.at = kind, seq_len, 0
        item = pa.uint16() if kind == "<u2" else pa.uint32()
        self.schema = pa.schema([pa.field("ids", pa.list_(item, seq_len)), pa.field("mask", pa.list_(pa.bool_(), seq_len))])
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(x) for x in self.tmp]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.doc_schema)
        self.buf, self.rows, self.n_docs = bytearray(), [], 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        n = len(data) // int(self.kind[2])
        self.rows.append((doc_id, self.at, n))
        self.at += n
        self.buf += data
        self.n_docs += 1
        step = BATCH_SEQS * self.seq_len * int(self.kind[2])
        if len(self.buf) >= step:
            cut = len(self.buf) // step * step
            block = bytes(self.buf[:cut])
            del self.buf[:cut]
            for i in range(0, cut, step):
                self._put(np.frombuffer(block, self.kind, step // int(self.kind[2]), i))
        if len(self.rows) >= 10_000:
            self._put_docs()

    def _put(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.seq_len) * self.seq_len
        mask = np.zeros(n, bool)
        mask[: len(ids)] = True
        whole = ids if len(ids) == n else np.concatenate([ids, np.zeros(n - len(ids), self.kind)])
        self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(whole), type=self.schema.field(0).type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field(1).type)], schema=self.schema))

    def _put_docs(self) -> None:
        if self.rows:
            self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows)], schema=self.doc_schema))
            self.rows = []

    def close(self) -> None:
        if self.buf:
            self._put(np.frombuffer(bytes(self.buf), self.kind))
        self._put_docs()
        for w, s in ((self.ids, self.sinks[0]), (self.docs, self.sinks[1])):
            w.close()
            s.close()
        for a, b in zip(self.tmp, self.final):
            self.fs.move(a, b)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in order, SLICE bytes of text at a time unless a single text is longer."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
        yield b.slice(at, end - at)
        at = end


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, seq_len: int = 2048, shards: int | None = None) -> DataFrame:
    """Write the corpus below path; returns the manifest (shard, n_docs, n_tokens, offset), which is also ``_manifest.json`` there.

    One shuffle, by ranges of doc_id; a doc_id that many rows have is parted by their texts' hashes and, if those agree too, by where the
    rows come from. The manifest has a row per shard.
    """
    if seq_len % 8:
        raise ValueError("seq_len must be a multiple of 8, for masks to begin at whole bytes")
    spark = docs.sparkSession
    path = qualified(spark, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = shards or parts_for(rows, SHARD_BYTES)
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_from", F.spark_partition_id())
    rows = rows.repartitionByRange(shards, "doc_id", "_h", "_from").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc, out = TaskContext.get().partitionId(), None, None
        for b in batches:
            for part in _slices(b):
                if out is None:
                    enc = Encoder.of(tokenizer, end_id)
                    out = _Shard(path, f"{shard:06d}", enc.kind, seq_len)
                for i, ids in zip(part.column("doc_id").to_pylist(), enc.texts(part.column("text"))):
                    out.add(i, ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [out.n_docs], "n_tokens": [out.at]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    made = sorted(map(tuple, rows.mapInArrow(run, "shard int, n_docs long, n_tokens long").collect()))
    manifest, at = [], 0
    for shard, n_docs, n_tokens in made:
        manifest.append((shard, n_docs, n_tokens, at))
        at += n_tokens
    f, root = _fs(path)
    f.create_dir(root, recursive=True)
    with f.open_output_stream(f"{root}/_manifest.json") as s:
        s.write(json.dumps({"seq_len": seq_len, "end_id": end_id, "shards": manifest}).encode())
    return spark.createDataFrame(manifest, "shard int, n_docs long, n_tokens long, offset long")


class ShardReader:
    """Random access to a shard: sequences by number, documents by their place; memory-mapped where the file system allows."""

    def __init__(self, path: str, shard: int) -> None:
        f, root = _fs(path)
        name = f"{root}/{shard:06d}"
        opened = (lambda x: pa.memory_map(x)) if isinstance(f, pafs.LocalFileSystem) else f.open_input_file
        self.ids = pa.ipc.open_file(opened(f"{name}.ids.arrow"))
        self.docs = pa.ipc.open_file(opened(f"{name}.docs.arrow"))
        self.seq_len = self.ids.schema.field("ids").type.list_size
        self._at, self._flat = -1, None

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of sequence i, both views of the file. The mask is packed: bit k % 8 of byte k // 8 (``mask`` unpacks it)."""
        b, k = self.ids.get_batch(i // BATCH_SEQS), i % BATCH_SEQS
        bits = b.column(1).values
        at = (bits.offset + k * self.seq_len) // 8
        packed = np.frombuffer(bits.buffers()[1], np.uint8)[at : at + self.seq_len // 8]
        return b.column(0).values.slice(k * self.seq_len, self.seq_len).to_numpy(zero_copy_only=True), packed

    def mask(self, i: int) -> np.ndarray:
        """A copy of the mask as booleans."""
        return np.unpackbits(self.sequence(i)[1], bitorder="little").astype(bool)

    def _batch(self, i: int) -> np.ndarray:
        if i != self._at:
            self._at, self._flat = i, self.ids.get_batch(i).column(0).values.to_numpy()
        return self._flat

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids of a span, in views of at most a batch."""
        step = BATCH_SEQS * self.seq_len
        while n:
            i, k = divmod(start, step)
            part = self._batch(i)[k : k + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self) -> Iterator[tuple]:
        for i in range(self.docs.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.docs.get_batch(i).columns))


def read_documents(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start in the corpus, n_tokens, crc32 of its ids as little-endian unsigned 32-bit integers."""
    path = qualified(spark, path)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, offset in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist()):
                r, out = ShardReader(path, shard), []
                for doc_id, start, n in r.documents():
                    crc = 0
                    for x in r.pieces(start, n):
                        crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
                    out.append((doc_id, offset + start, n, crc))
                    if len(out) == 10_000:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                        out = []
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, seq_len: int = 2048) -> DataFrame:
    """Write and read back."""
    path = path or f"{work_dir(docs.sparkSession)}/tokens"
    return read_documents(docs.sparkSession, path, write_tokens(docs, path, tokenizer, end_id, seq_len))
