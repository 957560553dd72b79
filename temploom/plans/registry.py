"""The engine's queries over the driver's tables, and DuckDB SQL for the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from temploom.functions import expr, tokens
from temploom.functions.event_time import parse_event_ms
from temploom.functions.json_path import extract_field
from temploom.functions.masks import BUILTIN_MASKS, apply_masks
from temploom.operators import catalog as cat
from temploom.operators.match import match
from temploom.operators.mine import mine, with_rates
from temploom.operators.options import MinerOptions
from temploom.plans.closed_form import catalog_threshold_one, catalog_threshold_zero
from temploom.sources.records import assemble_multiline, drop_blank, read_records

# --- line corpora, built alike on both engines -------------------------------------------------------------------------------


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def l_ev(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events")
    line = F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" props "), "props")
    return e.select(F.col("event_id").alias("seq"), line.alias("record"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_ms"), F.col("user_id").cast("string").alias("member"))


def l_ord(s: SparkSession, d: str) -> DataFrame:
    o = _t(s, d, "orders")
    k = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("POST /api/v1/orders/"), k("o_orderkey"), F.lit("/status "), "o_orderstatus", F.lit(" customer "), k("o_custkey"), F.lit(" prio "), "o_orderpriority")
    return o.select(F.col("o_orderkey").alias("seq"), line.alias("record"))


def l_doc(s: SparkSession, d: str) -> DataFrame:
    lines = _t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "record"))
    return lines.select(F.col("doc_id").cast("string").alias("source"), (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("seq"), "record")


def l_doc1(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents").select(F.col("doc_id").alias("seq"), tokens.first_line(F.coalesce("text", F.lit(""))).alias("record"))


WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
EV = "(select event_id seq, event_type || ' user ' || user_id || ' props ' || props record, (epoch_us(ts) // 1000) event_ms, user_id::varchar member from events)"
ORD = "(select o_orderkey seq, 'POST /api/v1/orders/' || o_orderkey || '/status ' || o_orderstatus || ' customer ' || o_custkey || ' prio ' || o_orderpriority record from orders)"
DOC = "(select doc_id, doc_id * 1000000 + i - 1 seq, l[i] record from (select doc_id, string_split(text, chr(10)) l, unnest(generate_series(1, len(string_split(text, chr(10))))) i from documents))"
DOC1 = "(select doc_id seq, string_split(coalesce(text, ''), chr(10))[1] record from documents)"


def _tok(corpus: str, split: str = WS, extra: str = "") -> str:
    return f"(select *, list_filter(string_split_regex(record, '{split}'), lambda t: t <> '') w{extra} from {corpus})"


def _keys(p: int) -> str:
    return f"list_transform(w[1:{p}], lambda x: case when regexp_full_match(x, '[0-9]+') then '<*>' else x end)"


def _sim0(corpus: str, p: int = 2, split: str = WS) -> str:
    """One template per leaf, columns n, k, template, size, first_seq."""
    return f"""t as (select *, len(w) n, array_to_string({_keys(p)}, ' ') k from {_tok(corpus, split)}),
      x as (select n, k, i, min(v) a, max(v) b from (select n, k, unnest(w) v, unnest(generate_series(1, n)) i from t) group by all),
      g as (select n, k, string_agg(case when a = b then a else '<*>' end, ' ' order by i) template from x group by all),
      z as (select t.n, t.k, coalesce(any_value(g.template), '') template, count(*) size, min(seq) first_seq, min(event_ms) event_first_ms, max(event_ms) event_last_ms
            from (select * from t) t left join g on t.n = g.n and t.k = g.k group by 1, 2)"""


def _fold(corpus: str, th: float, p: int, split: str = WS) -> str:
    """Rows seq, n, k, cid, upd and the leaf's templates after each record; no eviction."""
    return f"""recursive tok as (select seq, w from {_tok(corpus, split)}),
      o as materialized (select *, row_number() over (partition by n, k order by seq) rn from (select seq, w, len(w) n, {_keys(p)} k from tok)),
      f as (
        select n, k, rn, seq, 1::bigint cid, [w] tpls, 'Created' upd from o where rn = 1
        union all
        select n, k, rn, seq, case when bs >= {th} then bi::bigint else len(tpls) + 1 end,
          case when bs >= {th} then list_transform(tpls, lambda t, i: case when i = bi then nt else t end) else list_append(tpls, w) end,
          case when not bs >= {th} then 'Created' when nt <> tpls[bi] then 'TemplateChanged' else 'None' end
        from (select *, list_transform(w, lambda x, i: case when tpls[bi][i] = x then x else '<*>' end) nt
              from (select *, list_position(sims, list_max(sims)) bi, list_max(sims) bs
                    from (select o.n, o.k, o.rn, o.seq, o.w, f.tpls,
                            list_transform(f.tpls, lambda t: case when o.n = 0 then 1.0::double else len(list_filter(o.w, lambda x, i: t[i] = '<*>' or t[i] = x)) / o.n::double end) sims
                          from f join o on o.n = f.n and o.k = f.k and o.rn = f.rn + 1)))),
      ids as (select n, k, cid, row_number() over (order by seq) id, seq cseq from f where upd = 'Created')"""


O2, O4 = MinerOptions(depth=2), MinerOptions()
EV7 = MinerOptions(sim_threshold=0.7)
PATH = MinerOptions(sim_threshold=0.8, path_delimiters="/")
ZERO = MinerOptions(sim_threshold=0.0)
ORD_SPLIT = WS.replace("[", "[/", 1)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def long(c: str):
    return F.col(c).cast("long").alias(c)


_EMAIL = r"\b[A-Za-z0-9_.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_IP = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
_H = "[0-9a-fA-F]"


@query(f"select doc_id, regexp_replace(regexp_replace(text, '{_EMAIL}', '<email>', 'g'), '{_IP}', '<ipv4>', 'g') masked from documents")
def mask_email_ipv4(s, d):
    return _t(s, d, "documents").select("doc_id", apply_masks(F.col("text"), (BUILTIN_MASKS["email"], BUILTIN_MASKS["ipv4"])).alias("masked"))


_IDS = "'u ' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || ' h ' || m || ' j eyJ' || substr(m, 1, 9) || '.' || m || '.' || m"


@query(f"select o_orderkey, regexp_replace(regexp_replace(regexp_replace(l, '\\b{_H}{{8}}(?:-{_H}{{4}}){{3}}-{_H}{{12}}\\b', '<uuid>', 'g'), '\\b{_H}{{32}}\\b', '<hex32>', 'g'), '\\beyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\b', '<jwt>', 'g') masked from (select o_orderkey, {_IDS} l from (select o_orderkey, md5(o_orderkey::varchar) m from orders))")
def mask_uuid_hex32_jwt(s, d):
    o = _t(s, d, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("m"))
    return o.select("o_orderkey", F.expr(_IDS).alias("l")).select("o_orderkey", apply_masks(F.col("l"), tuple(BUILTIN_MASKS[x] for x in ("uuid", "hex32", "jwt"))).alias("masked"))


@query("select doc_id, string_split(text, chr(10))[1] first, case when contains(text, chr(10)) then substr(text, strpos(text, chr(10)) + 1) end suffix from documents")
def first_line_split(s, d):
    return _t(s, d, "documents").select("doc_id", tokens.first_line(F.col("text")).alias("first"), tokens.suffix(F.col("text")).alias("suffix"))


@query(f"select seq, len(w) n_tokens, array_to_string(w, ' ') toks from {_tok(DOC)}")
def tokenize_ws(s, d):
    return tokens.with_tokens(l_doc(s, d), O4).select("seq", long("n_tokens"), F.array_join("tokens.text", " ").alias("toks"))


@query(f"""select seq, array_to_string(flatten(list_transform(w, lambda p: case when len(list_filter(string_split_regex(p, '/+'), lambda t: t <> '')) = 0 then [p || '~~'] else
    list_transform(list_filter(string_split_regex(p, '/+'), lambda t: t <> ''), lambda t, i: t || '~' || coalesce(right(regexp_extract_all(p, '/+')[i - 1 + starts_with(p, '/')::int], 1), '') || '~' || coalesce(left(regexp_extract_all(p, '/+')[i + starts_with(p, '/')::int], 1), '')) end)), ' ') toks
    from {_tok(ORD)}""")
def tokenize_path(s, d):
    t = tokens.with_tokens(l_ord(s, d), PATH)
    return t.select("seq", F.array_join(F.transform("tokens", lambda x: F.concat_ws("~", x["text"], F.coalesce(x["lead"], F.lit("")), F.coalesce(x["trail"], F.lit("")))), " ").alias("toks"))


@query(f"select seq, len(list_filter(w, lambda t: regexp_full_match(t, '[0-9]+'))) n_numeric from {_tok(DOC)}")
def numeric_tokens(s, d):
    t = tokens.with_tokens(l_doc(s, d), O4)
    return t.select("seq", F.size(F.filter("tokens.text", tokens.is_numeric)).cast("long").alias("n_numeric"))


@query(f"select seq, len(w) n_tokens, array_to_string({_keys(2)}, ' ') leaf from {_tok(DOC)}")
def leaf_key(s, d):
    return tokens.with_tokens(l_doc(s, d), O4).select("seq", long("n_tokens"), F.array_join("leaf_keys", " ").alias("leaf"))


@query("select event_id, json_extract_string(props, '$.k') v from events where json_extract_string(props, '$.k') is not null")
def json_extract(s, d):
    return _t(s, d, "events").select("event_id", extract_field(F.col("props"), "k").alias("v")).filter("v is not null")


@query("select count(*) n, count(*) filter (json_extract_string(props, '$.nope.deep') is null) missing from events")
def json_extract_missing(s, d):
    return _t(s, d, "events").select(extract_field(F.col("props"), "nope.deep", exact=False).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("missing"))


@query("select event_id, (epoch_us(ts) // 1000) // 1000 * 1000 s_ms, (epoch_us(ts) // 1000) ms_ms, (epoch_us(ts) // 1000) us_ms, (epoch_us(ts) // 1000) ns_ms from events")
def event_time_epoch(s, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    text = lambda c: parse_event_ms(F.concat(F.lit(" "), c.cast("string")))
    e = _t(s, d, "events")
    return e.select("event_id", text(F.call_function("div", ms, F.lit(1000))).alias("s_ms"), text(ms).alias("ms_ms"), text(ms * 1000 + 7).alias("us_ms"), text(ms * 1_000_000 + 7).alias("ns_ms"))


@query("select event_id, (epoch_us(ts) // 1000) // 1000 * 1000 utc_ms, (epoch_us(ts) // 1000) // 1000 * 1000 - 7200000 offset_ms from events")
def event_time_rfc3339(s, d):
    t = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return _t(s, d, "events").select("event_id", parse_event_ms(F.lower(F.concat(t, F.lit("Z")))).alias("utc_ms"), parse_event_ms(F.concat(t, F.lit("+02:00"))).alias("offset_ms"))


@query("select event_id, (epoch_us(ts) // 1000) // 1000 * 1000 ms, null::bigint bad from events")
def event_time_format(s, d):
    t = F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    return _t(s, d, "events").select("event_id", parse_event_ms(F.concat(t, F.lit(" +0000")), "%d/%b/%Y:%H:%M:%S %z").alias("ms"), parse_event_ms(t, "%Y-%m-%d %H:%M:%S").alias("bad"))


@query(f"select seq, record from {DOC} where not regexp_full_match(record, '({WS})?')")
def blank_filter(s, d):
    return drop_blank(l_doc(s, d)).select("seq", "record")


@query(f"""with a as (select *, sum(regexp_matches(record, '^[A-M]')::int) over (partition by doc_id order by seq) g from {DOC}),
    b as (select *, max((record <> '')::int) over (partition by doc_id, g order by seq) txt from a)
    select doc_id::varchar source, min(seq) seq, string_agg(record, chr(10) order by seq) record from b where txt = 1 group by doc_id, g""")
def multiline_start(s, d):
    return assemble_multiline(l_doc(s, d), "^[A-M]")


_S0 = "select n n_tokens, k leaf, template, size, first_seq from z"


def _ev_null(corpus: str) -> str:
    return f"(select *, null::bigint event_ms from {corpus})"


@query(f"with {_sim0(EV)} {_S0}")
def mine_sim0_events(s, d):
    return catalog_threshold_zero(l_ev(s, d), ZERO).drop("suffix").withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query(f"with {_sim0(_ev_null(DOC))} {_S0}")
def mine_sim0_documents(s, d):
    return catalog_threshold_zero(l_doc(s, d), ZERO).drop("suffix").withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query(f"with {_sim0(_ev_null(ORD), 2, ORD_SPLIT)} {_S0}")
def mine_sim0_orders(s, d):
    return catalog_threshold_zero(l_ord(s, d), MinerOptions(sim_threshold=0.0, path_delimiters="/")).drop("suffix").withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query(f"select len(w) n_tokens, array_to_string(w, ' ') template, count(*) size, min(seq) first_seq from {_tok(DOC)} group by 1, 2")
def mine_sim1_documents(s, d):
    return catalog_threshold_one(l_doc(s, d), MinerOptions(sim_threshold=1.0)).withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query(f"with {_fold(EV, 0.7, 2)} select f.seq, ids.id cluster_id, f.upd \"update\" from f join ids using (n, k, cid)")
def mine_assign_events(s, d):
    return mine(l_ev(s, d), EV7).assigned.select("seq", "cluster_id", "update")


@query(f"with {_fold(DOC1, 0.4, 0)} select f.seq, ids.id cluster_id, f.upd \"update\" from f join ids using (n, k, cid)")
def mine_assign_first_lines(s, d):
    return mine(l_doc1(s, d), O2).assigned.select("seq", "cluster_id", "update")


@query(f"""with {_fold(DOC1, 0.4, 0)}, last as (select n, k, tpls from f qualify row_number() over (partition by n, k order by rn desc) = 1)
    select ids.id, array_to_string(any_value(last.tpls[ids.cid]), ' ') template, count(*) size from f join ids using (n, k, cid) join last using (n, k) group by ids.id""")
def mine_catalog_first_lines(s, d):
    return mine(l_doc1(s, d), O2).catalog.select("id", F.array_join("tokens.text", " ").alias("template"), "size")


@query(f"with {_fold(EV, 0.7, 2)} select upd \"update\", count(*) n from f group by 1")
def update_counts(s, d):
    return mine(l_ev(s, d), EV7).assigned.groupBy("update").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_fold(EV, 0.7, 2)} select ids.id cluster_id, ids.cseq seq from ids")
def created_feed(s, d):
    from temploom.streaming.stream import created_feed as feed

    return feed(mine(l_ev(s, d), EV7).assigned).select("cluster_id", "seq")


@query(f"with {_sim0(EV)} select template, size, event_first_ms, event_last_ms from z")
def mine_event_window(s, d):
    return mine(l_ev(s, d), ZERO).catalog.select("template", "size", "event_first_ms", "event_last_ms")


@query(f"with {_sim0(EV)} select template, case when event_last_ms - event_first_ms < 1000 then 0.0 else size / ((event_last_ms - event_first_ms) / 1000.0::double / 60.0::double) end rate from z")
def event_rate(s, d):
    return with_rates(mine(l_ev(s, d), ZERO).catalog).select("template", F.col("event_lines_per_minute").alias("rate"))


@query(f"""with {_sim0(EV)}, m as (select n, k, member, min(seq) q from t group by all)
    select z.template, string_agg(m.member, ';' order by m.q) members from z join m using (n, k) group by z.n, z.k, z.template""")
def mine_members(s, d):
    return mine(l_ev(s, d), ZERO).catalog.select("template", F.array_join("members", ";").alias("members"))


_SUF = "(select doc_id seq, string_split(text, chr(10))[1] record, case when contains(text, chr(10)) then substr(text, strpos(text, chr(10)) + 1) end suffix, null::bigint event_ms from documents where text is not null)"


@query(f"with {_sim0(_SUF)} select z.template, z.size, s.suffix from z join {_SUF} s on s.seq = z.first_seq")
def mine_suffix(s, d):
    docs = _t(s, d, "documents").filter("text is not null").select(F.col("doc_id").alias("seq"), F.col("text").alias("record"))
    return mine(docs, MinerOptions(sim_threshold=0.0, first_line_only=True)).catalog.select("template", "size", "suffix")


_PAIRS = f"(select seq, w, first_value(w) over (partition by len(w), {_keys(2)} order by seq) a from {_tok(DOC1)})"


def _pairs(s, d):
    t = tokens.with_tokens(l_doc1(s, d), O4)
    return t.withColumn("a", F.first("tokens").over(Window.partitionBy("n_tokens", "leaf_keys").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"select seq, case when len(w) = 0 then 1.0::double else len(list_filter(a, lambda x, i: x = '<*>' or x = w[i])) / len(w)::double end sim from {_PAIRS}")
def similarity_scores(s, d):
    return _pairs(s, d).select("seq", expr.similarity(F.col("a.text"), F.col("tokens.text")).alias("sim"))


@query(f"select seq, array_to_string(list_transform(a, lambda x, i: case when x = w[i] then x else '<*>' end), ' ') merged, coalesce(len(list_filter(a, lambda x, i: x <> '<*>' and x <> w[i])) > 0, false) changes from {_PAIRS}")
def generalize_pair(s, d):
    p = _pairs(s, d)
    return p.select("seq", F.array_join(expr.generalize(F.col("a"), F.col("tokens")).getField("text"), " ").alias("merged"), expr.would_generalize(F.col("a.text"), F.col("tokens.text")).alias("changes"))


@query(f"select seq, record rendered from {ORD}")
def render_template(s, d):
    return tokens.with_tokens(l_ord(s, d), PATH).select("seq", expr.render_template(F.col("tokens")).alias("rendered"))


_HALF = f"""with c as (select * from (select *, null::bigint event_ms from {ORD}) where seq % 2 = 0), p as (select *, len(w) n, array_to_string({_keys(2)}, ' ') k from {_tok(ORD, ORD_SPLIT)} where seq % 2 = 1),
    {_sim0('c', 2, ORD_SPLIT)}, r as (select *, row_number() over (order by first_seq) id, string_split(template, ' ') a from z),
    q as (select p.seq, p.w, r.a, r.id, len(list_filter(p.w, lambda x, i: r.a[i] = '<*>' or r.a[i] = x)) / p.n::double sim from p left join r on r.n = p.n and r.k = p.k)"""


def _matched(s, d):
    o = MinerOptions(sim_threshold=0.0, path_delimiters="/")
    c = mine(l_ord(s, d).filter("seq % 2 = 0"), o).catalog
    return match(l_ord(s, d).filter("seq % 2 = 1"), c, PATH)


@query(f"{_HALF} select seq, case when sim >= 0.8 then id end cluster_id from q")
def match_only(s, d):
    return _matched(s, d).select("seq", "cluster_id")


@query(f"{_HALF} select seq, id cluster_id, array_to_string(list_filter(w, lambda x, i: a[i] = '<*>'), ' ') params from q where sim >= 0.8")
def extract_params(s, d):
    return _matched(s, d).filter("cluster_id is not null").select("seq", "cluster_id", F.array_join("params", " ").alias("params"))


@query(f"with c as (select * from {_tok(DOC1)} where seq % 2 = 0) select seq from {_tok(DOC1)} p where seq % 2 = 1 and not exists (select 1 from c where len(c.w) = len(p.w) and {_keys(2).replace('w[', 'c.w[')} = {_keys(2).replace('w[', 'p.w[')})")
def match_miss(s, d):
    c = mine(l_doc1(s, d).filter("seq % 2 = 0"), ZERO).catalog
    return match(l_doc1(s, d).filter("seq % 2 = 1"), c, ZERO).filter("cluster_id is null").select("seq")


_Z0 = f"{_sim0(_ev_null(DOC))}, r as (select row_number() over (order by first_seq) id, template, size from z)"


def _doc_catalog(s, d):
    return mine(l_doc(s, d), ZERO).catalog


@query(f"with {_Z0} select id, template, size from r where size >= 3")
def min_size(s, d):
    return cat.min_size(_doc_catalog(s, d), 3).select("id", "template", "size")


@query(f"with {_Z0} select id, size, row_number() over (order by size desc, id) place from r order by place limit 10")
def sort_size_topk(s, d):
    top = cat.ordered(_doc_catalog(s, d), "size").select("id", "size").limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "id")).cast("long"))


@query(f"with {_Z0} select id, template, row_number() over (order by template, id) place from r")
def sort_template(s, d):
    return cat.placed(_doc_catalog(s, d), "template").select("id", "template", "place")


@query(f"with {_Z0} select id, size, row_number() over (order by id) place from r")
def sort_id(s, d):
    return cat.placed(_doc_catalog(s, d), "id").select("id", "size", "place")


def _observed(s, d):
    e = l_ev(s, d)
    return e.withColumn("observed_ms", F.col("event_ms") + F.col("seq") % 7 * 1000 + F.col("seq"))


_OBS = f"""{_sim0(EV)}, ob as (select n, k, arg_min(event_ms + seq % 7 * 1000 + seq, seq) created_ms, arg_max(event_ms + seq % 7 * 1000 + seq, seq) updated_ms from t group by all),
    r as (select row_number() over (order by first_seq) id, template, size, created_ms, updated_ms, case when updated_ms - created_ms < 1000 then 0.0 else size / ((updated_ms - created_ms) / 1000.0::double / 60.0::double) end rate from z join ob using (n, k))"""


@query(f"with {_OBS} select id, template, size, created_ms, updated_ms, rate from r")
def mine_observed_times(s, d):
    return with_rates(mine(_observed(s, d), ZERO).catalog).select("id", "template", "size", "created_ms", "updated_ms", F.col("lines_per_minute").alias("rate"))


@query(f"with {_OBS} select id, rate, row_number() over (order by rate desc, id) place from r")
def sort_rate(s, d):
    return cat.placed(mine(_observed(s, d), ZERO).catalog, "rate").select("id", F.col("lines_per_minute").alias("rate"), "place")


@query(f"with {_Z0} select count(*) templates, count(*) = 0 empty, true none_is_empty from r")
def catalog_size(s, d):
    c = _doc_catalog(s, d)
    return s.createDataFrame([(cat.size_of(c), cat.is_empty(c), cat.is_empty(c.filter("false")))], "templates long, empty boolean, none_is_empty boolean")


@query(f"with {_Z0} select id, template, size from r where id = 3")
def cluster_by_id(s, d):
    return cat.cluster_by_id(_doc_catalog(s, d), 3).select("id", "template", "size")


_LINES = "unnest(generate_series(0, len(string_split(x, chr(10))) - 1)) n, unnest(string_split(x, chr(10))) line"


@query(f"""with {_Z0}, wide as (select greatest(2, max(len(id::varchar))) wi, greatest(4, max(len(size::varchar))) ws from r),
    page as (select lpad('ID', any_value(wi)::int, ' ') || '  ' || lpad('SIZE', any_value(ws)::int, ' ') || '  TEMPLATE' || chr(10) || string_agg(lpad(id::varchar, wi::int, ' ') || '  ' || lpad(size::varchar, ws::int, ' ') || '  ' || template || chr(10), '' order by size desc, id) x from r, wide)
    select {_LINES} from page""")
def render_text(s, d):
    return cat.page(_doc_catalog(s, d), "text")


_MEMBERS = f"{_sim0(EV)}, m as (select n, k, member, min(seq) q from t group by all), a as (select n, k, list(member order by q) members from m group by all), r as (select *, row_number() over (order by first_seq) id, case when event_last_ms - event_first_ms < 1000 then 0.0::double else size / ((event_last_ms - event_first_ms) / 1000.0::double / 60.0::double) end rate from z join a using (n, k))"


@query(f"""with {_MEMBERS}, page as (select '[' || chr(10) || string_agg('  {{' || chr(10) || '    "createdAt": null,' || chr(10) || '    "eventFirstSeen": ' || event_first_ms || ',' || chr(10) || '    "eventLastSeen": ' || event_last_ms || ',' || chr(10)
      || '    "eventRatePerMinute": ' || to_json(rate) || ',' || chr(10) || '    "id": ' || id || ',' || chr(10) || '    "linesPerMinute": 0.0,' || chr(10) || '    "members": [' || chr(10) || array_to_string(list_transform(members, lambda y: '      ' || to_json(y)), ',' || chr(10)) || chr(10) || '    ],' || chr(10)
      || '    "size": ' || size || ',' || chr(10) || '    "suffix": null,' || chr(10) || '    "template": ' || to_json(template) || ',' || chr(10) || '    "updatedAt": null' || chr(10) || '  }}', ',' || chr(10) order by id) || chr(10) || ']' x from r)
    select {_LINES} from page""")
def render_json(s, d):
    return cat.page(mine(l_ev(s, d), ZERO).catalog, "json", "id")


@query(f"""with {_Z0} select id, concat_ws(',', id, size, '0.0', case when regexp_matches(template, '[,"\n\r]') then '"' || replace(template, '"', '""') || '"' else template end, '', '', '', '', '', '', '') line from r""")
def csv_lines(s, d):
    return cat.csv_lines(_doc_catalog(s, d))


@query(f"""with {_MEMBERS} select id, '{{"createdAt":null,"eventFirstSeen":' || event_first_ms || ',"eventLastSeen":' || event_last_ms || ',"eventRatePerMinute":' || to_json(rate) || ',"id":' || id || ',"linesPerMinute":0.0,"members":' || to_json(members) || ',"size":' || size || ',"suffix":null,"template":' || to_json(template) || ',"updatedAt":null}}' line from r""")
def json_lines(s, d):
    return cat.json_lines(mine(l_ev(s, d), ZERO).catalog)


@query(f"with {_Z0} select count(*) templates, sum(size)::bigint lines, sum(size) / count(*)::double ratio from r")
def compression(s, d):
    return cat.compression(_doc_catalog(s, d))


# With threshold 1 a template is a token vector; with two places in a leaf those of its two last runs of equal vectors live. So a run creates
# its vector anew unless the run before the last one had the same.
@query(f"""with v as (select seq, len(w) n, array_to_string({_keys(2)}, ' ') k, array_to_string(w, ' ') template from {_tok(DOC)}),
    a as (select *, case when template is distinct from lag(template) over leaf then 1 else 0 end edge from v window leaf as (partition by n, k order by seq)),
    b as (select *, sum(edge) over (partition by n, k order by seq) run from a),
    g as (select n, k, run, template, min(seq) seq, count(*) c from b group by all),
    h as (select *, template is distinct from lag(template, 2) over (partition by n, k order by run) fresh, max(run) over (partition by n, k) top from g),
    e as (select *, sum(fresh::int) over (partition by n, k, template order by run) life from h),
    i as (select n, k, template, life, row_number() over (order by seq) id from e where fresh),
    l as (select distinct n, k, template, life from e where run >= top - 1)
    select id, template, (select sum(c)::bigint from e where e.n = l.n and e.k = l.k and e.template = l.template and e.life = l.life) size from l join i using (n, k, template, life)""")
def mine_lru_evict(s, d):
    return mine(l_doc(s, d), MinerOptions(sim_threshold=1.0, max_clusters_per_leaf=2)).catalog.select("id", "template", "size")


_EVEN = f"(select * from {DOC1} where seq % 2 = 0)"


@query(f"""with {_fold(_EVEN, 0.4, 0)}, last as (select n, k, tpls from f qualify row_number() over (partition by n, k order by rn desc) = 1),
    p as (select seq, w, len(w) n from {_tok(DOC1)} where seq % 2 = 1),
    q as (select p.seq, p.n, last.k, list_transform(last.tpls, lambda t: case when p.n = 0 then 1.0::double else len(list_filter(p.w, lambda x, i: t[i] = '<*>' or t[i] = x)) / p.n::double end) sims from p left join last on last.n = p.n)
    select q.seq, ids.id cluster_id from q left join ids on ids.n = q.n and ids.k = q.k and ids.cid = list_position(q.sims, list_max(q.sims)) and list_max(q.sims) >= 0.4""")
def match_many_templates(s, d):
    """Leaves by token count alone, so that a line has many templates to choose from."""
    c = mine(l_doc1(s, d).filter("seq % 2 = 0"), O2).catalog
    return match(l_doc1(s, d).filter("seq % 2 = 1"), c, O2).select("seq", "cluster_id")


@query("""select event_id, '[' || user_id || ',{"b":"x"}]' whole, null::varchar item, 'q' deep, null::varchar past from events""")
def json_objects_only(s, d):
    line = F.concat(F.lit('{"k": ['), F.col("user_id").cast("string"), F.lit(', {"b": "x"}], "o": {"p": "q"}}'))
    e = _t(s, d, "events").select("event_id", line.alias("l"))
    return e.select("event_id", *[extract_field(F.col("l"), path).alias(name) for name, path in (("whole", "k"), ("item", "k.0"), ("deep", "o.p"), ("past", "o.p.r"))])


@query("select row_number() over (order by doc_id) - 1 seq, text record from documents where text is not null")
def record_separator(s, d):
    """Documents as files of records that end with a separator of two characters, read again."""
    from temploom.sources.store import scratch

    path = scratch(s, "records")
    _t(s, d, "documents").filter("text is not null").orderBy("doc_id").select("text").write.option("lineSep", "\x1e;").text(path)
    return read_records(s, [path], separator="\x1e;").select("seq", "record")


@query(f"with {_sim0(EV)}, r as (select *, row_number() over (order by first_seq) id from z) select id, template, size from r")
def snapshot_roundtrip(s, d):
    """Save the catalog of the first half, restore it, and mine the rest on top."""
    from temploom.sources.store import ParquetStore, scratch

    store = ParquetStore(scratch(s, "store"))
    ev = l_ev(s, d)
    half = ev.agg(F.percentile_approx("seq", 0.5)).head()[0] or 0
    first = mine(ev.filter(F.col("seq") <= half), ZERO)
    store.save(first.catalog, ZERO, first.catalog.count())
    old, meta = store.load(s)
    return mine(ev.filter(F.col("seq") > half), ZERO, initial=old, counter=meta["counter"]).catalog.select("id", "template", "size")


@query(f"with {_fold(EV, 0.7, 2)} select f.seq, ids.cseq created_seq, f.upd \"update\" from f join ids using (n, k, cid)")
def stream_equals_batch(s, d):
    from temploom.sources.store import scratch
    from temploom.streaming.stream import mine_stream

    base = scratch(s, "stream")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = _t(s, d, "events").schema
    e = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    line = F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" props "), "props")
    rows = mine_stream(e.select(F.col("event_id").alias("seq"), line.alias("record")), EV7)
    q = rows.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{base}/rows").select("seq", "created_seq", "update")
