"""Exact dedup, decontamination, mixing, token output and substring dedup against brute force on small and awkward rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from temploom.llm import decontaminate as dc
from temploom.llm import exact_dedup as ed
from temploom.llm import mixing as mx
from temploom.llm import substring_dedup as sd
from temploom.llm import token_output as to

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_mph_is_minimal_and_perfect():
    d = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    for n in (0, 1, 2, 5000):
        sizes, bits = ed.mph_build(d[:n])
        assert sorted(ed.mph_slots(sizes, bits, d[:n])) == list(range(n))


def dedup_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out, seen = [], set()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        stays = i == keep and (t or "", i) not in seen
        seen.add((t or "", i))
        out.append((i, keep, len(groups[t or ""]), stays, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


KEY = lambda r: tuple((x is not None, x) for x in r)


def test_exact_dedup(spark, nasty, empty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in ed.exact_dedup(nasty).collect()]
    assert sorted(got, key=KEY) == sorted(dedup_brute(rows), key=KEY)
    assert ed.exact_dedup(empty).count() == 0


def test_exact_dedup_with_history(spark, tmp_path):
    old = docs_of(spark, [(i, f"t{i % 7}") for i in range(50)])
    new = docs_of(spark, [(100, "t1"), (3, "t2"), (101, "n"), (102, "n")])
    index = ed.build_index(old, str(tmp_path))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(new, index).collect()}
    assert got == {100: (100, 8, True), 3: (44, 8, False), 101: (102, 2, False), 102: (102, 2, True)}
    assert {r.member for r in ed.look_up(new, index).select("member").collect()} == {True, False}
    none = ed.build_index(old.filter("false"), str(tmp_path / "e"))
    assert {r.doc_id: r.kept for r in ed.exact_dedup(new, none).collect()} == {100: True, 3: True, 101: False, 102: True}


def decon_brute(rows, items, window=13):
    W = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in rows:
        w, hit, its = W(t), set(), set()
        for item, text in items:
            b = W(text)
            n = min(window, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    its |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), ",".join(sorted(its)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [20_000, 0])
def test_decontaminate(spark, nasty, empty, limit):
    r = random.Random(5)
    voc = ["ab", "Cd", "éf", "x1", "q"]
    text = lambda n: " ".join(r.choice(voc) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(1, text(30)), (2, text(14)), (3, "Solo"), (4, text(5)), (5, None), (6, "..."), (7, "a b c d e f"), (12, text(13)), (None, "same text here now")]
    rows = [(i, text(r.randint(0, 60))) for i in range(40)] + [(100, "z " * 20 + items[0][1].upper() + " y"), (101, items[0][1][:60]), (102, "zz solo zz"), (103, items[0][1] + " " + items[1][1])] + [(x.doc_id, x.text) for x in nasty.collect()]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit("x"))
    got = [(x.doc_id, x.n_words, x.n_hit, ",".join(x["items"]), x.contaminated) for x in dc.decontaminate(docs_of(spark, rows), bench, in_plan=limit, broadcast_bytes=1000 * limit).collect()]
    assert sorted(got, key=KEY) == sorted(decon_brute(rows, items), key=KEY)
    assert dc.decontaminate(nasty, bench, in_plan=limit, broadcast_bytes=1000 * limit).count() == nasty.count()
    assert {x.n_hit for x in dc.decontaminate(nasty, bench.filter("false")).collect()} == {0} and dc.decontaminate(empty, bench).count() == 0


def test_words_are_split_and_not_extracted_one_by_one(spark, nasty):
    """The same words as regexp_extract_all finds, in less time."""
    import time

    each = lambda text: F.regexp_extract_all(F.translate(text, dc.UPPER, dc.LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    odd = spark.createDataFrame([("-",), ("a",), ("\n\na\t",), ("Éa\x00b\x0bÇ9-z\U0001f600q x\x85y\xa0z\x1cKK İ ",)], "text string").unionAll(nasty.select("text"))
    text = F.col("text")
    got = odd.select(dc.words(text), F.coalesce(each(text), F.array())).collect()
    assert len(got) == odd.count() and all(list(a) == list(b) for a, b in got)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").repartition(4).cache()
    docs.count()

    def seconds(n):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            docs.agg(F.sum(n)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert 1.3 * seconds(F.size(dc.words(text))) < seconds(F.size(each(text)))
    docs.unpersist()


def mix_brute(rows, weight):
    size = lambda t: len(WORD.findall(t or ""))
    src = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(size(t) for _, x, t in rows if x == s) for s in src}
    total, w = 1.5 * sum(words.values()), {s: (3, 1, 2)[k % 3] for k, s in enumerate(src)}
    target, free = {s: 0.0 for s in src}, set(src)
    for _ in range(len(src) + 1):
        left = total - sum(target[s] for s in src if s not in free)
        for s in free:
            target[s] = left * w[s] / sum(w[x] for x in free)
        over = {s for s in free if target[s] >= 2 * words[s]}
        for s in over:
            target[s] = 2.0 * words[s]
        free -= over
        if not over or not free:
            break
    return words, target


def test_mixing(spark, nasty, empty):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", "c", "d", None, "é"] + ["hot"] * 4), "w " * r.randint(0, 30)) for i in range(3000)] + [(9000, "tiny", "x y"), (9001, "zero", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit(1))
    q = spark.createDataFrame([(i, 3.0 if i % 2 else 0.5) for i in range(1000)] + [(5, None), (6, -1.0)], "doc_id long, weight double")
    got = mx.mix(df, q).collect()
    words, target = mix_brute(rows, None)
    assert len(got) == len(rows)
    taken = Counter()
    for x in got:
        assert 0 <= x.taken <= 2 * x.size and x.source_size == words[x.source] and abs(x.target - target[x.source]) < 1e-6 * max(1, target[x.source])
        taken[x.source] += x.taken
    for s in words:
        assert abs(taken[s] - target[s]) <= 16
    again = mx.mix(df.repartition(7), q).collect()
    assert sorted((x.doc_id, x.taken) for x in got) == sorted((x.doc_id, x.taken) for x in again)
    part = [x for x in got if x.doc_id < 1000 and x.source == "hot"]
    rate = lambda odd: np.mean([x.sampled for x in part if x.doc_id % 2 == odd])
    assert rate(1) > rate(0)
    assert mx.mix(nasty).count() == nasty.count() and mx.mix(empty).count() == 0


def plain_tokens(rows, tok):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_output(spark, nasty, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in nasty.collect()] + [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = docs_of(spark, rows)
    manifest = to.write_tokens(docs, str(tmp_path), path, seq_len=64)
    got = sorted(map(tuple, to.read_documents(spark, str(tmp_path), manifest).collect()), key=lambda r: (r[1], r[2]))
    assert got == plain_tokens(rows, tok)
    first = to.ShardReader(str(tmp_path), manifest.orderBy("shard").head().shard)
    ids, packed = first.sequence(0)
    assert len(ids) == 64 and first.mask(0).all() and list(ids) == list(next(first.pieces(0, 64)))
    assert ids.base is not None and packed.base is not None and len(packed) == 8  # views of the file
    last = [to.ShardReader(str(tmp_path), r.shard) for r in manifest.collect()]
    for r, s in zip(manifest.collect(), last):
        n = sum(s.ids.get_batch(i).num_rows for i in range(s.ids.num_record_batches))
        assert n == -(-r.n_tokens // 64) and sum(int(s.mask(i).sum()) for i in range(n)) == r.n_tokens
    assert to.token_output(empty, path).count() == 0


def test_rows_of_one_id_spread(spark, tmp_path):
    import public_tokenizers

    rows = [(7, f"t{i % 50}") for i in range(3000)] + [(8, "same") for _ in range(3000)] + [(None, None)] * 3
    docs = docs_of(spark, rows).repartition(6)
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    m = to.write_tokens(docs, str(tmp_path), path, shards=8)
    got = sorted(map(tuple, to.read_documents(spark, str(tmp_path), m).collect()), key=lambda r: (r[1], r[2]))
    assert len(got) == len(rows) and max(r.n_docs for r in m.collect()) < 2500
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0)) and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_whole_texts(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(name))
    tok, enc, r = Tokenizer.from_file(path), to.Encoder(path, 2), random.Random(3)
    assert enc.by_word == name.startswith("word")
    some = list("abzAZ  \n\t\r.,;!?\"#'()<|>_-019") + list("İıŉẞßéÉñΣςσǅƻﬁ½²ⅷⅧªº\u0301\u0307\u0338\u00a0\u2028\x1c\x85\u200dक्षकि中文😀") + ["<|endoftext|>", "it's", "I'LL", "wörld.", "İ\"", "Ab,", " "]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(14))) for _ in range(40_000 if enc.by_word else 2000)]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        want = [np.array(e.ids + [2], enc.kind).tobytes() for e in tok.encode_batch(part, add_special_tokens=False)]
        assert list(enc.texts(pa.array(part))) == want
    assert list(enc.texts(pa.array([None, '', ' ' if enc.by_word else ''], pa.string()))) == [enc.end] * 3


def repeats_brute(rows, n=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substring_dedup(spark, nasty, empty, monkeypatch):
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared = [text(n) for n in (34, 35, 36, 52, 90, 400)]
    rows = []
    for i in range(120):
        parts = [text(r.randrange(40)) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(shared))
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    inner = text(40)
    rows += [(200, inner + " " + text(5) + "  " + inner), (201, text(70)), (None, None), (202, rows[3][1])] + [(x.doc_id, x.text) for x in nasty.collect()]
    df = docs_of(spark, rows).repartition(3)
    df.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/sub")
    df = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/sub").withColumn("n_words", F.lit(0))
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in sd.remove_repeats(df).collect()]
    assert sorted(got, key=KEY) == sorted(repeats_brute(rows), key=KEY)
    assert sd.remove_repeats(empty).count() == 0
    with monkeypatch.context() as m:
        m.setattr(sd, "BLOCK", 50)
        assert (sd.word_hashes(b"ab cd  efghij " * 30) == np.tile(sd.word_hashes(b"ab cd efghij"), 30)).all()
