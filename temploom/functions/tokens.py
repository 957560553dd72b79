"""The preprocessing projection that learning and classification share: mask, first line, tokens, leaf key."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temploom.functions.masks import with_masks
from temploom.operators.options import MinerOptions

TOKEN = "struct<text:string,lead:string,trail:string>"
#: Unicode's white space, spelled out: the regex engine decides a class of ranges faster than a property.
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def first_line(col: Column) -> Column:
    return F.substring_index(col, "\n", 1)


def suffix(col: Column) -> Column:
    """What follows the first line feed; null without one, empty after a trailing one."""
    at = F.locate("\n", col)
    return F.when(at > 0, F.substring(col, at + 1, F.length(col)))


def whitespace_pieces(col: Column) -> Column:
    """split() compiles a pattern for each row, regexp_replace() once; a split at one character needs none."""
    return F.array_remove(F.split(F.regexp_replace(col, WHITE + "+", " "), " "), "")


def _class(delims: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in delims) + "]"


def _plain(t: Column) -> Column:
    return F.struct(t.alias("text"), F.lit(None).cast("string").alias("lead"), F.lit(None).cast("string").alias("trail"))


def path_tokens(piece: Column, delims: str) -> Column:
    """Segments of a piece between delimiter runs; a run counts as its last character before a segment and its first after one."""
    # Each run becomes its first character, a space and its last one: what lies between spaces is a segment with the flags beside it.
    cut = F.split(F.regexp_replace(piece, f"(?=({_class(delims)})){_class(delims)}*({_class(delims)})", "$1 $2"), " ")
    flag = lambda a: F.transform(a, lambda x, i: F.struct(F.btrim(x, F.lit(delims)).alias("text"), F.when(i > 0, F.left(x, F.lit(1))).alias("lead"), F.when(i < F.size(a) - 1, F.right(x, F.lit(1))).alias("trail")))
    # An array of one binds the cut, which would else be made anew for each segment.
    segs = F.flatten(F.transform(F.array(cut), lambda a: F.filter(flag(a), lambda t: t["text"] != "")))
    return F.when(F.btrim(piece, F.lit(delims)) == "", F.array(_plain(piece))).otherwise(segs)


def tokenize(col: Column, delims: str = "") -> Column:
    """``array<struct<text,lead,trail>>`` of a text."""
    pieces = whitespace_pieces(col)
    if not delims:
        return F.transform(pieces, _plain)
    has = lambda p: reduce(lambda a, b: a | b, [F.contains(p, F.lit(x)) for x in delims])
    return F.flatten(F.transform(pieces, lambda p: F.when(has(p), path_tokens(p, delims)).otherwise(F.array(_plain(p)))))


def is_numeric(t: Column) -> Column:
    return t.rlike(r"^[0-9]+\z")


def leaf_keys(texts: Column, opts: MinerOptions) -> Column:
    head = F.slice(texts, 1, opts.prefix_len)
    if not opts.parametrize_numeric_tokens:
        return head
    return F.transform(head, lambda t: F.when(is_numeric(t), F.lit(opts.wildcard)).otherwise(t))


def with_tokens(df: DataFrame, opts: MinerOptions, record: str = "record") -> DataFrame:
    """Add masked, suffix, tokens, n_tokens and leaf_keys. A null record is taken as an empty one."""
    df = with_masks(df.withColumn("masked", F.coalesce(F.col(record), F.lit(""))), "masked", opts.masks)
    if opts.first_line_only:
        df = df.withColumn("suffix", suffix(F.col("masked")))
        text = first_line(F.col("masked"))
    else:
        df = df.withColumn("suffix", F.lit(None).cast("string"))
        text = F.col("masked")
    df = df.withColumn("tokens", tokenize(text, opts.active_delimiters))
    return df.withColumn("n_tokens", F.size("tokens")).withColumn("leaf_keys", leaf_keys(F.col("tokens.text"), opts))
