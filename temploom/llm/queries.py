"""Queries opN_<name> over the driver's tables and DuckDB SQL for those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temploom.llm import decontaminate, exact_dedup, html_extract, language_id, line_dedup, mixing, near_dedup, quality, substring_dedup, token_output


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def op1_html_extract(s: SparkSession, d: str) -> DataFrame:
    out = html_extract.extract(_t(s, d, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_near_dedup(s: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_classes(_t(s, d, "documents"))


def op3_token_output(s: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return token_output.token_output(_t(s, d, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op4_substring_dedup(s: SparkSession, d: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_t(s, d, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_mix_sources(s: SparkSession, d: str) -> DataFrame:
    out = mixing.mix(_t(s, d, "documents"), mixing.quality_weights(_t(s, d, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents")
    out = language_id.identify(docs, language_id.train(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(s: SparkSession, d: str) -> DataFrame:
    out = line_dedup.drop_lines(_t(s, d, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op8_decontaminate(s: SparkSession, d: str) -> DataFrame:
    out = decontaminate.decontaminate(_t(s, d, "documents"), _t(s, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_exact_dedup(s: SparkSession, d: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_t(s, d, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_quality(s: SparkSession, d: str) -> DataFrame:
    return quality.classify(_t(s, d, "documents"), _t(s, d, "labels"))


def pipeline(s: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(s, d)


QUERIES = {
    f.__name__: f
    for f in (op1_html_extract, op2_near_dedup, op3_token_output, op4_substring_dedup, op5_mix_sources, op6_language_id, op7_line_dedup, op8_decontaminate, op9_exact_dedup, op10_quality, pipeline)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op4_substring_dedup": f"""
with w as (select row_number() over () r, doc_id, {_WORDS} w from documents),
s as (select r, i, array_to_string(w[i:i + 34], ' ') x from (select r, w, unnest(generate_series(1, len(w) - 34)) i from w)),
b as (select r, i from s where x in (select x from s group by x having count(*) > 1)),
c as (select r, list(distinct j) gone from (select r, unnest(generate_series(i, i + 34)) j from b) group by r)
select doc_id, len(w) n_words, coalesce(len(gone), 0) n_removed,
  sha256(coalesce(array_to_string(case when gone is null then w else (select list(w[k.k] order by k.k) from (select unnest(generate_series(1, len(w))) k) k where not list_contains(gone, k.k)) end, ' '), '')) kept_sha256
from w left join c using (r)""",
    "op5_mix_sources": f"""
with q as (select doc_id, case when max(quality) = 1 then 2.0::double else 0.5::double end weight from labels where doc_id is not null and quality is not null group by 1),
d as (select row_number() over () r, doc_id, source, len({_WORDS}) size, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 1) / 4503599627370498.0::double) / coalesce(q.weight, 1.0::double) key
      from documents left join q using (doc_id)),
z as (select source, sum(size)::bigint source_size, sum(sum(size)) over ()::double * 1.5 total from d group by source),
p as (select *, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double w, source_size * 2.0::double cap from z),
l as (select *, (total - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) lvl from p),
m as (select *, (select arg_min(lvl, cap / w) from l where cap > lvl * w) level from l),
t as (select source, source_size, least(cap, coalesce(level * w, cap)) target from m),
e as (select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(target / t.source_size) else 0 end::bigint epochs,
        sum(size) over (partition by d.source order by key, doc_id, size rows unbounded preceding) upto from d join t on d.source is not distinct from t.source),
f as (select *, target - epochs * source_size rest from e)
select doc_id, size, source_size, target, size * (epochs + case when rest > 0 and upto - size < rest and upto - size / 2.0 <= rest then 1 else 0 end) taken from f""",
    "op8_decontaminate": f"""
with i as (select item_id::varchar item_id, {_ITEM_WORDS} w from benchmark),
b as (select item_id, n, array_to_string(w[k:k + n - 1], ' ') x from (select item_id, w, least(13, len(w)) n, unnest(generate_series(1, greatest(len(w) - 12, 1))) k from i where len(w) > 0)),
d as (select row_number() over () r, doc_id, {_ITEM_WORDS} w from documents),
h as (select r, k, n, array_to_string(w[k:k + n - 1], ' ') x from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) k from d, (select distinct n from b))),
m as (select h.r, h.k, h.n, b.item_id from h join b on h.n = b.n and h.x = b.x),
c as (select r, count(distinct j) n_hit from (select r, unnest(generate_series(k, k + n - 1)) j from (select distinct r, k, n from m)) group by r),
g as (select r, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) items from m where item_id is not null group by r)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) contaminated
from d left join c using (r) left join g using (r)""",
    "op9_exact_dedup": """
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id is not distinct from max(doc_id) over g and row_number() over (partition by coalesce(text, ''), doc_id) = 1 kept, sha256(coalesce(text, '')) text_sha256
from documents window g as (partition by coalesce(text, ''))""",
}
