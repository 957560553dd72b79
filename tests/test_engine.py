"""Engine tests: units over small frames, properties against a sequential simulation, readers, stores, streaming, CLI."""
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from temploom import Mask, MinerOptions, mine
from temploom.errors import CatalogDecodeError, InvalidConfig, RegexCompileError, UnsupportedCatalogVersion
from temploom.functions import expr, tokens
from temploom.functions.event_time import java_format, parse_event_ms
from temploom.functions.json_path import extract_value
from temploom.functions.masks import BUILTIN_MASKS, apply_masks, parse_mask_list
from temploom.operators import catalog as cat
from temploom.operators.fold import LeafFold
from temploom.operators.match import match
from temploom.sources.records import read_records, unescape
from temploom.sources.store import MemoryStore, ParquetStore, RedisStore, unpack


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).head()[0]


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "seq long, record string")


@pytest.mark.parametrize("text, want", [
    ("/a/b", [("a", "/", "/"), ("b", "/", None)]), ("a//b", [("a", None, "/"), ("b", "/", None)]), ("/", [("/", None, None)]), ("x  y", [("x", None, None), ("y", None, None)]), ("", []), ("a b　c", [("a", None, None), ("b", None, None), ("c", None, None)]), ("a\x1cb", [("a\x1cb", None, None)]),
])
def test_tokenize(spark, text, want):
    assert [tuple(t) for t in one(spark, text, lambda c: tokens.tokenize(c, "/"))] == want


@pytest.mark.parametrize("text, want", [("GET /a/b/ x", "GET /a/b/x"), ("a/ b", "a/b"), ("a//b", "a/b"), ("", "")])
def test_render(spark, text, want):
    assert one(spark, text, lambda c: expr.render_template(tokens.tokenize(c, "/"))) == want


def test_suffix_and_numeric(spark):
    assert [one(spark, x, tokens.suffix) for x in ("a", "a\n", "a\nb\nc")] == [None, "", "b\nc"]
    assert [one(spark, x, tokens.is_numeric) for x in ("12", "-3", "1.5", "", "12\n", "٣")] == [True, False, False, False, False, False]


@pytest.mark.parametrize("name, text, want", [
    ("email", "to a.b@x.org now", "to <email> now"), ("ipv4", "from 10.0.0.1:80", "from <ipv4>:80"), ("uuid", "id 123e4567-e89b-12d3-a456-426614174000.", "id <uuid>."), ("hex32", "h " + "ab" * 16, "h <hex32>"), ("jwt", "t eyJa.b-c.d_e", "t <jwt>"), ("ipv4", "é10.0.0.1", "é10.0.0.1"),
])
def test_builtin_masks(spark, name, text, want):
    assert one(spark, text, lambda c: apply_masks(c, (BUILTIN_MASKS[name],))) == want


def test_custom_masks(spark):
    assert one(spark, "k=12 z", lambda c: Mask(r"(?P<k>\w)=(\d+)$|(\w)=(\d+)", "$k[$3]<$nope>\\").apply(c)) == "[k]<>\\ z"
    assert one(spark, "a\n", lambda c: Mask("a$", "x").apply(c)) == "a\n"
    with pytest.raises(RegexCompileError):
        Mask("(", "x").validate(spark)
    assert [m.placeholder for m in parse_mask_list(" uuid, ,ipv4")] == ["<uuid>", "<ipv4>"]
    with pytest.raises(InvalidConfig):
        parse_mask_list("nope")


def test_options():
    for bad in ({"depth": 1}, {"sim_threshold": 1.1}, {"max_clusters_per_leaf": 0}):
        with pytest.raises(InvalidConfig):
            MinerOptions(**bad)
    assert MinerOptions(path_delimiters="/", first_line_path_delimiters=":").active_delimiters == "/"
    assert MinerOptions(path_delimiters="/", first_line_path_delimiters=":", first_line_only=True).active_delimiters == ":"


@pytest.mark.parametrize("text, fmt, want", [
    ("1700000000", None, 1700000000000), ("1700000000123", None, 1700000000123), ("1700000000123456", None, 1700000000123), ("1700000000123456789", None, 1700000000123), ("-5", None, None), (" 2023-11-14T22:13:20Z ", None, 1700000000000), ("2023-11-15t00:13:20+02:00", None, 1700000000000),
    ("2023-11-14", None, None), ("x", None, None), ("14/Nov/2023:22:13:20 +0000", "%d/%b/%Y:%H:%M:%S %z", 1700000000000), ("2023-11-14 22:13:20", "%Y-%m-%d %H:%M:%S", 1700000000000), ("17", "%s", 17000), ("junk", "%Y-%m-%d %H:%M:%S", None),
])
def test_event_time(spark, text, fmt, want):
    assert one(spark, text, lambda c: parse_event_ms(c, fmt)) == want


def test_date_only_format_is_rejected():
    with pytest.raises(InvalidConfig):
        java_format("%Y-%m-%d")


@pytest.mark.parametrize("line, path, want", [('{"a":{"b":1.0}}', "a.b", "1.0"), ('{"a":"x"}', "a", "x"), ('{"a":null}', "a", None), ('{"a":[1]}', "a.0", None), ("{'a':3}", "a", None), ('{"a":1} x', "a", None), ('{"a":{"z":1,"b":[true]}}', "a", '{"b":[true],"z":1}'), (None, "a", None)])
def test_json_path(line, path, want):
    assert extract_value(line, path.split(".")) == want


# --- mining ------------------------------------------------------------------------------------------------------------------


def simulate(records, th, p, cap, wildcard="<*>"):
    """One list, one record at a time; ids, updates and the final catalog."""
    leaves, out, n = {}, [], 0
    for tick, r in enumerate(records):
        w = r.split()
        key = (len(w), tuple(wildcard if x.isdigit() and x.isascii() else x for x in w[:p]))
        leaf = leaves.setdefault(key, [])
        sims = [sum(a in (b, wildcard) for a, b in zip(c["t"], w)) / len(w) if w else 1.0 for c in leaf]
        at = max(range(len(leaf)), key=lambda i: sims[i], default=None)
        if at is not None and sims[at] >= th:
            c = leaf[at]
            new = [a if a == b else wildcard for a, b in zip(c["t"], w)]
            out.append((tick, c["id"], "TemplateChanged" if new != c["t"] else "None"))
            c.update(t=new, size=c["size"] + 1, used=tick)
            continue
        n += 1
        if len(leaf) >= cap:
            i = min(range(len(leaf)), key=lambda i: leaf[i]["used"])
            leaf[i] = leaf[-1]
            leaf.pop()
        leaf.append({"id": n, "t": w, "size": 1, "used": tick})
        out.append((tick, n, "Created"))
    return out, sorted((c["id"], " ".join(c["t"]), c["size"]) for leaf in leaves.values() for c in leaf)


def fold_all(records, th, p, cap):
    folds, out = {}, []
    for tick, r in enumerate(records):
        w = r.split()
        key = (len(w), tuple("<*>" if x.isdigit() else x for x in w[:p]))
        out.append((tick, *folds.setdefault(key, LeafFold(th, cap, "<*>")).add(" ".join(w), w, tick)))
    ids = {c.key: i + 1 for i, c in enumerate(sorted({id(c): c for _, c, u in out if u == "Created"}.values(), key=lambda c: c.key))}
    return [(t, ids[c.key], u) for t, c, u in out], sorted((ids[c.key], " ".join(c.texts), c.size) for f in folds.values() for c in f.clusters)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "1", "<*>"]), max_size=4).map(" ".join), max_size=40), st.sampled_from([0.0, 0.4, 0.5, 0.75, 1.0]), st.integers(0, 2), st.integers(1, 3))
def test_fold_equals_simulation(records, th, p, cap):
    assert fold_all(records, th, p, cap) == simulate(records, th, p, cap)


def test_mine_equals_simulation_for_any_partitioning(spark):
    import random

    r = random.Random(3)
    rows = [" ".join(r.choice(["a", "b", "7", "c", "dd"]) for _ in range(r.randint(0, 5))) for _ in range(400)]
    for th, depth, cap in ((0.5, 3, 2), (0.4, 4, 100), (1.0, 2, 3)):
        want = simulate(rows, th, depth - 2, cap)
        for parts in (1, 5):
            m = mine(lines(spark, rows), MinerOptions(sim_threshold=th, depth=depth, max_clusters_per_leaf=cap), partitions=parts)
            assert [tuple(x) for x in m.assigned.orderBy("seq").select("seq", "cluster_id", "update").collect()] == want[0]
            assert sorted((x.id, " ".join(t.text for t in x.tokens), x.size) for x in m.catalog.collect()) == want[1]
            m.unpersist()


LOG = ["GET /api/v1/hosts/7/load 200 3ms", "GET /api/v1/hosts/9/load 200 8ms", "user ann@x.org from 10.0.0.1", "user bob@y.org from 10.9.0.1", "cache miss k1", "cache miss k2", "GET /api/v1/hosts/12/load 500 1ms"]


def test_paths_masks_and_extract(spark):
    o = MinerOptions(path_delimiters="/", masks=parse_mask_list("email,ipv4"))
    c = mine(lines(spark, LOG), o).catalog
    got = {(r.template, r.size) for r in c.collect()}
    assert got == {("GET /api/v1/hosts/<*>/load <*> <*>", 3), ("user <email> from <ipv4>", 2), ("cache miss <*>", 2)}
    m = match(lines(spark, ["GET /api/v1/hosts/55/load 404 2ms", "nothing like it", "", None]), c, o)
    assert [(r.cluster_id, r.params) for r in m.orderBy("seq").collect()] == [(1, ["55", "404", "2ms"]), (None, None), (None, None), (None, None)]
    far = match(lines(spark, LOG), c, o, broadcast_templates=0)
    assert far.filter("cluster_id is null").count() == 0


def test_windows_members_suffix(spark):
    df = spark.createDataFrame([(0, "x 1\ntrace", 60_000, "b", 1), (1, "x 2", None, "a", 5), (2, "x 3\n", 180_000, "b", 9)], "seq long, record string, event_ms long, member string, observed_ms long")
    r = cat.with_rates(mine(df, MinerOptions(first_line_only=True)).catalog).head()
    assert (r.size, r.event_first_ms, r.event_last_ms, r.members, r.suffix, r.created_ms, r.updated_ms, r.event_lines_per_minute, r.lines_per_minute) == (3, 60_000, 180_000, ["b", "a"], "trace", 1, 9, 1.5, 0.0)


def test_empty_and_null_records(spark):
    assert mine(lines(spark, [])).catalog.count() == 0
    r = mine(lines(spark, ["", None, "  "])).catalog.collect()
    assert [(x.template, x.size) for x in r] == [("", 3)]


def test_restore_continues(spark, tmp_path):
    o = MinerOptions(sim_threshold=0.5)
    whole = sorted((x.template, x.size) for x in mine(lines(spark, LOG), o).catalog.collect())
    df = lines(spark, LOG)
    first = mine(df.filter("seq < 3"), o).catalog
    store, mem = ParquetStore(str(tmp_path / "s")), MemoryStore()
    assert store.load(spark) is None and mem.load(spark) is None

    class Fake(dict):
        get, set = dict.get, dict.__setitem__

    redis = RedisStore("k", client=Fake())
    for s in (store, store, mem, redis):
        s.save(first, o, 2)
        old, meta = s.load(spark)
        assert meta["counter"] == 2 and meta["options"]["sim_threshold"] == 0.5 and "masks" not in meta["options"]
        again = mine(df.filter("seq >= 3"), o, initial=old, counter=2).catalog
        assert sorted((x.template, x.size) for x in again.collect()) == whole
    (tmp_path / "s" / "CURRENT").write_text(json.dumps({"format_version": 99, "version": "x"}))
    (tmp_path / "s" / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(UnsupportedCatalogVersion):
        store.load(spark)
    with pytest.raises(CatalogDecodeError):
        unpack(spark, b"junk")


# --- records, formats, CLI ---------------------------------------------------------------------------------------------------


def test_readers(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_bytes(b"ERR boom\r\n\tat a\n\nERR boom\n\tat c\n")
    b.write_bytes(b"alpha\0beta\0\0gamma")
    got = [r.record for r in read_records(spark, [str(a), str(a)]).orderBy("seq").collect()]
    assert got == ["ERR boom", "\tat a", "", "ERR boom", "\tat c"] * 2
    multi = read_records(spark, [str(a)], multiline_start="^ERR").orderBy("seq").collect()
    assert [r.record for r in multi] == ["ERR boom\n\tat a\n", "ERR boom\n\tat c"]
    assert [r.record for r in read_records(spark, [str(b)], separator="\\0").orderBy("seq").collect()] == ["alpha", "beta", "", "gamma"]
    assert unescape(r"a\n\t\x\\") == "a\n\t\\x\\" and unescape("\\") == "\\"
    with pytest.raises(InvalidConfig):
        read_records(spark, [str(a)], separator="")


def test_formats(spark):
    c = mine(lines(spark, ['a "q", 1', 'a "q", 2'])).catalog
    assert cat.render(c, "text").splitlines()[1].split(None, 2) == ["1", "2", 'a "q", <*>']
    assert json.loads(cat.render(c, "json"))[0]["eventRatePerMinute"] is None
    assert json.loads(cat.render(c, "ndjson")) == json.loads(cat.json_lines(c).head().line)
    assert cat.render(c, "csv").splitlines()[1] == cat.csv_lines(c).head().line == '1,2,0.0,"a ""q"", <*>",,,,,,,'


def test_cli(spark, tmp_path, capsys):
    from temploom.cli import main

    f = tmp_path / "j.log"
    f.write_text('{"msg":"hit 1","ts":60}\n{"msg":"hit 2","ts":180}\nnope\n{"msg":"hit 3"}\n')
    assert main([str(f), "--key", "msg", "--time-key", "ts", "--format", "jsonl"]) == 0
    out = capsys.readouterr()
    row = json.loads(out.out)
    assert (row["template"], row["size"], row["eventFirstSeen"], row["eventLastSeen"]) == ("hit <*>", 3, 60_000, 180_000) and "2 records" in out.err
    assert main([str(f), "--masks", "zzz"]) == 2
    assert main([str(tmp_path / "none.log")]) == 2 and capsys.readouterr().err.splitlines()[-1].startswith("error: ")
    assert main([str(f), "--sim-th", "1.0", "--depth", "3", "--path-delimiters", "/", "--first-line-only", "--sort", "id", "--min-size", "1", "--format", "csv"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 5
    for wrong in (["--time-format", "%Y"], ["--record-separator", ";", "--multiline-start", "^a"], ["--sort", "x"]):
        with pytest.raises(SystemExit) as e:
            main([str(f), *wrong])
        assert e.value.code == 2


def test_invalid_utf8(spark, tmp_path):
    from temploom.sources.records import read_records

    f = tmp_path / "bad.log"
    f.write_bytes(b"ok\nb\xffd;next\n")
    with pytest.raises(Exception, match="not valid UTF-8"):
        read_records(spark, [str(f)]).collect()
    assert [r.record for r in read_records(spark, [str(f)], separator=";").orderBy("seq").collect()] == ["ok\nb\ufffdd", "next\n"]


@pytest.mark.parametrize("size", [1, 3, 100_000])
def test_multiline_over_ranges(spark, monkeypatch, size):
    import random

    from temploom.sources import records as rec

    monkeypatch.setattr(rec, "RANGE", size)
    r = random.Random(size)
    rows = [(s, i * 2, r.choice(["", "E x", "a", " b", ""])) for s in ("f", "g", None) for i in range(60)]
    want = []
    for s in ("f", "g", None):
        cur = None
        for _, i, x in [y for y in rows if y[0] == s]:
            if x.startswith("E") or (cur is None and x):
                if cur:
                    want.append(tuple(cur))
                cur = [s, i, x]
            elif cur:
                cur[2] += "\n" + x
        if cur:
            want.append(tuple(cur))
    got = rec.assemble_multiline(spark.createDataFrame(rows, "source string, seq long, record string").repartition(4), "^E").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_index_equals_scan():
    import random

    r = random.Random(3)
    for _ in range(120):
        n, th, cap, v = r.choice([1, 2, 3, 5, 8, 12]), r.choice([0, 0.1, 0.4, 0.5, 0.7, 0.9, 1.0]), r.choice([5, 30, 60, 10**9]), r.choice([2, 5, 30, 300])
        a, b = LeafFold(th, cap, "<*>"), LeafFold(th, cap, "<*>")
        a.SCAN, b.SCAN = r.choice([0, 3, 24]), 10**9
        for s in range(300):
            t = [r.choice(["<*>"] + [f"t{i}" for i in range(v)]) if r.random() < 0.5 else f"c{p}" for p in range(n)]
            (x, up), (y, down) = a.add(" ".join(t), t, s), b.add(" ".join(t), t, s)
            assert (x.key, x.texts, up) == (y.key, y.texts, down)
        assert [(c.key, c.texts, c.size) for c in a.clusters] == [(c.key, c.texts, c.size) for c in b.clusters]


def test_many_templates_in_one_leaf_stay_fast():
    import random
    import time

    r, fold = random.Random(1), LeafFold(0.7, 10**9, "<*>")
    began = time.process_time()
    for s in range(50_000):
        t = ["a", "b", *(f"w{r.randrange(5000)}" for _ in range(10))]
        fold.add(" ".join(t), t, s)
    assert len(fold.clusters) > 49_000 and time.process_time() - began < 30


def test_stream_equals_batch(spark, tmp_path):
    from temploom.streaming.stream import mine_stream

    src = tmp_path / "src"
    for k in range(0, len(LOG), 3):
        df = lines(spark, LOG).filter((F.col("seq") >= k) & (F.col("seq") < k + 3)).coalesce(1)
        df.write.mode("append").parquet(str(src))
    o = MinerOptions(path_delimiters="/")
    q = mine_stream(spark.readStream.schema("seq long, record string").option("maxFilesPerTrigger", 1).parquet(str(src)), o).writeStream.format("memory").queryName("st").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = mine(lines(spark, LOG), o).assigned.groupBy("update").count().collect()
    assert sorted(map(tuple, spark.table("st").groupBy("update").count().collect())) == sorted(map(tuple, batch))


def test_registry_has_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_leaf_parts_equal_fold(spark, monkeypatch):
    import random

    from temploom.operators import zero
    from temploom.operators.mine import MineResult, fold_input
    from temploom.plans.closed_form import catalog_threshold_zero

    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["a", "b", "7", "c/d", "<*>"]) for _ in range(r.randint(0, 4))) + r.choice(["", "\nx", f"\n{i}"]), r.choice([None, r.randrange(99)]), r.choice([None, "u", "v", "w"]), r.choice([None, r.randrange(99)])) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, record string, event_ms long, member string, observed_ms long").repartition(3, F.hash("record", "seq"))
    o = MinerOptions(sim_threshold=0.0, depth=3, first_line_only=True, path_delimiters="/")
    monkeypatch.setattr(MineResult, "raw", property(lambda m: pytest.fail("no fold at threshold 0")))
    got = mine(df, o).catalog.drop("n_tokens", "leaf_keys").orderBy("id").collect()
    monkeypatch.undo()
    slow = mine(df, o)
    slow.seeded = True  # the fold's way
    assert got == slow.catalog.drop("n_tokens", "leaf_keys").orderBy("id").collect()
    parts = fold_input(tokens.with_tokens(df, o), o)
    assert zero.leaf_parts(parts, "<*>").count() == len(got)
    closed = catalog_threshold_zero(df, o)
    assert "Generate" not in closed._jdf.queryExecution().toString()
    assert sorted((x.size, x.first_seq) for x in closed.collect()) == sorted((x.size, x.created_seq) for x in zero.leaf_parts(parts, "<*>").collect())


def test_merger_hands_on_when_full(monkeypatch):
    import pyarrow as pa

    from temploom.operators import zero

    monkeypatch.setattr(zero, "LEAVES", 2)
    row = lambda leaf, seq, texts: [1, leaf, seq, texts, None, None, None, None, 1, seq, None, None, None, None, None, None]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), zero._ARROW)], schema=zero._ARROW)
    near = [r for b in zero.merger("<*>", False)([batch([row("a", 3, "a x"), row("a", 1, "a y")]), batch([row("b", 2, "b x")]), batch([row("a", 0, "a z")])]) for r in b.to_pylist()]
    assert [(r["leaf"], r["created_seq"], r["texts"], r["size"]) for r in near] == [("a", 1, "a <*>", 2), ("b", 2, "b x", 1), ("a", 0, "a z", 1)]
    far = [r for b in zero.merger("<*>", True)([batch([row("a", 3, "a x")]), batch([row("a", 1, "a y"), row("b", 2, "b x")])]) for r in b.to_pylist()]
    assert [(r["leaf"], r["created_seq"], r["texts"], r["size"]) for r in far] == [("a", 1, "a <*>", 2), ("b", 2, "b x", 1)]


def test_numbered_over_ranges(spark, monkeypatch):
    import random

    from temploom.operators import numbering

    monkeypatch.setattr(numbering, "KEYS", 60)
    monkeypatch.setattr(numbering, "RANGES", 7)
    r = random.Random(2)
    rows = [(i, "p" * r.choice([1, 70, 80]) + r.choice("abc"), r.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string, x double").repartition(5)
    for keys, order in (((F.col("t"), F.col("id")), lambda y: (y[1], y[0])), ((F.negative("x"), F.col("id")), lambda y: (-y[2], y[0]))):
        got = numbering.numbered(df, list(keys), "n")
        assert "_range" in got._jdf.queryExecution().optimizedPlan().toString()
        assert {x.id: x.n for x in got.collect()} == {y[0]: k for k, y in enumerate(sorted(rows, key=order), 1)}


@pytest.mark.parametrize("timed", [False, True])
def test_page_equals_render(spark, timed):
    rows = [(i, f"{'abc'[i % 3]} {i} é\"{'z' * (i % 2)}", i * 60_000 if timed else None, f"m{i % 4}") for i in range(12)]
    c = mine(spark.createDataFrame(rows, "seq long, record string, event_ms long, member string")).catalog
    for fmt, by in (("text", "size"), ("json", "id"), ("text", "template")):
        for x in (c, c.filter("false")):
            got = [(r.n, r.line) for r in cat.page(x, fmt, by).orderBy("n").collect()]
            assert got == list(enumerate(cat.render(x, fmt, by).split("\n")))


def test_block_equals_rows(monkeypatch):
    import random

    import pyarrow as pa

    r = random.Random(7)
    for k in range(60):
        n, th, cap, total = r.choice([0, 1, 2, 5]), r.choice([0.0, 0.3, 0.5, 0.7, 1.0]), r.choice([1, 2, 4, 10**9]), r.choice([10, 400])
        rows = [(s, " ".join(r.choice(["a", "<*>", f"v{r.randrange(r.choice([2, 90]))}"]) for _ in range(n)), None, None, None, r.choice([None, r.randrange(99)]), r.choice([None, s]), r.choice([None, "u", "v"])) for s in range(total)]
        names = ["seq", "vec", "lead", "trail", "suffix", "event_ms", "observed_ms", "member"]
        a, b = LeafFold(th, cap, "<*>"), LeafFold(th, cap, "<*>")
        a.BLOCK, a.TRIAL, a.CHANGES = r.choice([1, 5]), r.choice([1, 8]), r.choice([0, 3, 1000])
        got, want = [], []
        for lo in range(0, total, 100):
            part = rows[lo : lo + 100]
            kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string()]
            got += [(x[0], x[1], x[2], int(x[3]), x[4]) for x in zip(*a.add_block(n, {y: pa.array(c, t) for y, c, t in zip(names, zip(*part), kinds)}))]
            for s, vec, lead, trail, suffix, ev, ob, m in part:
                c, update = b.add(vec, vec.split(" ") if n else [], s, lead=lead, trail=trail, suffix=suffix, event_ms=ev, observed_ms=ob, member=m)
                want.append((c.key, c.seed_id, update, c.size, " ".join(c.texts)))
        assert got == want
        assert a.clusters == b.clusters and [list(c.members) for c in a.clusters] == [list(c.members) for c in b.clusters]


def test_settled_leaf_is_fast():
    import random
    import time

    import pyarrow as pa

    r, fold, n = random.Random(1), LeafFold(0.7, 100, "<*>"), 200_000
    began, updates = time.process_time(), []
    for lo in range(0, n, 10_000):
        s = range(lo, lo + 10_000)
        null = pa.nulls(len(s), pa.string())
        cols = {"seq": pa.array(s), "vec": pa.array([f'click user {r.randrange(10**6)} props {{"k": {r.randrange(100)}}}' for _ in s]), "lead": null, "trail": null, "suffix": null, "event_ms": pa.nulls(len(s), pa.int64()), "observed_ms": pa.nulls(len(s), pa.int64()), "member": null}
        updates += fold.add_block(6, cols)[2]
    assert len(updates) == n == sum(c.size for c in fold.clusters) and time.process_time() - began < 3


@pytest.mark.parametrize("rows", [3, 50, 10**6])
def test_seq_sorter(monkeypatch, rows):
    import os
    import random

    import pyarrow as pa

    from temploom.streaming.runs import SeqSorter

    monkeypatch.setattr(SeqSorter, "ROWS", rows)
    monkeypatch.setattr(SeqSorter, "STEP", 4)
    seqs = random.Random(1).sample(range(10**6), 500)
    s = SeqSorter()
    for lo in range(0, 500, 7):
        s.add(pa.table({"seq": pa.array(seqs[lo : lo + 7], pa.int64()), "v": pa.array([str(x) for x in seqs[lo : lo + 7]])}))
        assert s.rows < rows
    folder = s.folder and s.folder.name
    got = [(r["seq"], r["v"]) for b in s.batches() for r in b.to_pylist()]
    assert got == [(x, str(x)) for x in sorted(seqs)] and bool(folder) == (rows < 500) and not (folder and os.path.exists(folder))
    assert not list(SeqSorter().batches())


def test_match_scores_once_under_a_filter(spark):
    c = mine(lines(spark, LOG), MinerOptions()).catalog
    m = match(lines(spark, [*LOG, "nothing like it"]), c, MinerOptions()).filter("cluster_id is not null")
    assert m.count() == len(LOG)
    assert m._jdf.queryExecution().optimizedPlan().toString().count("array_max") == 1


def test_tokenizing_searches_a_piece_once(spark):
    import re

    plan = tokens.with_tokens(lines(spark, ["/a b"]), MinerOptions(path_delimiters="/:"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("regexp_replace") == 2 and not re.search(r"split\(record", plan)
    got = one(spark, ":/a:b//:c d/ /: e", lambda c: tokens.tokenize(c, "/:"))
    assert [tuple(t) for t in got] == [("a", "/", ":"), ("b", ":", "/"), ("c", ":", None), ("d", None, "/"), ("/:", None, None), ("e", None, None)]


def test_plain_templates_are_not_rendered(spark):
    c = mine(lines(spark, ["a b 1", "a b 2", ""])).catalog.select("template")
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (isnull(lead" in plan and sorted(r.template for r in c.collect()) == ["", "a b <*>"]
