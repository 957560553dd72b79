"""Similarity, generalization, rendering, rates and line formats as Column functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(template: Column, texts: Column, wildcard: str = "<*>") -> Column:
    """Share of positions where the template has the wildcard or the same text; arrays of strings."""
    n = F.size(template)
    same = F.aggregate(F.zip_with(template, texts, lambda a, b: ((a == wildcard) | (a == b)).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(n != F.size(texts), 0.0).when(n == 0, 1.0).otherwise(same.cast("double") / n)


def generalize(template: Column, tokens: Column, wildcard: str = "<*>") -> Column:
    """Template tokens, differing ones turned into the wildcard; the template's delimiter flags stay."""
    return F.zip_with(
        template,
        tokens,
        lambda a, b: F.when(a["text"] == b["text"], a).otherwise(F.struct(F.lit(wildcard).alias("text"), a["lead"].alias("lead"), a["trail"].alias("trail"))),
    )


def would_generalize(template: Column, texts: Column, wildcard: str = "<*>") -> Column:
    return F.exists(F.zip_with(template, texts, lambda a, b: (a != wildcard) & (a != b)), lambda x: x)


def render_template(tokens: Column) -> Column:
    """Join by the previous token's trailing delimiter, else a space and this token's leading delimiter."""
    start = F.struct(F.lit("").alias("s"), F.lit(None).cast("string").alias("prev"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(acc["i"] == 0, F.lit("")).otherwise(F.coalesce(acc["prev"], F.lit(" ")))
        lead = F.when(acc["prev"].isNull(), F.coalesce(x["lead"], F.lit(""))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["s"], gap, lead, x["text"]).alias("s"), x["trail"].alias("prev"), (acc["i"] + 1).alias("i"))

    return F.aggregate(tokens, start, step, lambda acc: F.concat(acc["s"], F.coalesce(acc["prev"], F.lit(""))))


def extract_parameters(template: Column, texts: Column, wildcard: str = "<*>") -> Column:
    pairs = F.zip_with(template, texts, lambda a, b: F.when(a == wildcard, b))
    return F.filter(pairs, lambda x: x.isNotNull())


def per_minute(size: Column, first_ms: Column, last_ms: Column) -> Column:
    """Null without a window, 0.0 for a span under one second."""
    span = F.greatest(last_ms - first_ms, F.lit(0))
    return F.when(first_ms.isNull() | last_ms.isNull(), None).when(span < 1000, 0.0).otherwise(size / (span / 1000.0 / 60.0))


def csv_escape(col: Column) -> Column:
    return F.when(col.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(col)
