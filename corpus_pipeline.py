"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, token output. Each stage's rows are written and read again.

All stages but the last return the columns of documents, whatever further columns those have. Rejected documents go; documents that
the mix takes more than once come more than once. Decisions are made for rows and not for ids, so repeated and null doc_ids are
rows like any other. An empty table stays empty in every stage.

ORACLE_SQL is None: the language model and the tokenizer have no SQL form; tests compare every stage with brute force.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temploom.llm import decontaminate, language_id, mixing, near_dedup, token_output
from temploom.llm.common import work_dir

PASSAGE = 8  # words


def least_certainty(n_langs: int) -> float:
    """Certainty (mean of each word's greatest marginal) below which a document is of no learned language.

    Half again as much as a model that knows nothing has, and never what a sure word has. Code-switched texts aren't punished for having
    several languages, as each of their words may be sure of its own.
    """
    return min(1.5 / n_langs, 0.5)


def _free(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c.replace('`', '``')}`" for c in docs.columns]


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a learned language. Null texts, texts without a letter and texts below least_certainty go; equal texts fare equally."""
    model, p = language_id.train(docs), _free(docs, "_p")
    out = docs.withColumn(p, language_id.predictor(spark, model)(F.col("text")))
    known = F.col(f"{p}.certainty") >= least_certainty(len(model.langs) if model else 1)
    return out.filter((F.col(f"{p}.lang_pred") != "und") & known).select(*_columns(docs))


def _rows(docs: DataFrame, row: str) -> DataFrame:
    """docs with a key of each row, its place in the stage's Parquet input: ids may be null or come again."""
    return docs.withColumn(row, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates; of repeated rows one. Texts without words (null too) are in no class and stay."""
    row = _free(docs, "_row")
    rows = _rows(docs, row)
    gone = near_dedup.near_classes(rows, carry=(row,)).filter(~F.col("kept")).select(row)
    return rows.join(gone, row, "left_anti").select(*_columns(docs))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; null and empty texts have none, equal texts fare equally.

    A span of PASSAGE hit words is a passage however long its document is; shorter ones, which only items of so few words give, count
    by the operator's share of the document, or an item of one common word would take the whole corpus.
    """
    row = _free(docs, "_row")
    rows = _rows(docs, row)
    # The operator takes doc_id as a name only, so the row's key stands in for it.
    found = decontaminate.decontaminate(rows.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    passage = F.exists("spans", lambda x: x["end"] - x["start"] >= PASSAGE)
    return rows.join(found.filter(F.col("contaminated") | passage).select(F.col("doc_id").alias(row)), row, "left_anti").select(*_columns(docs))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (epochs and sample). Of rows with one doc_id any may be the one that is sampled."""
    row = _free(docs, "_row")
    rows, n, c = _rows(docs, row), _free(docs, "_n"), _free(docs, "_c")
    quality = mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    taken = mixing.mix(rows, quality, carry=(row,)).select(row, (F.col("epochs") + F.col("sampled").cast("long")).cast("int").alias(n)).filter(F.col(n) > 0)
    return rows.join(taken, row).withColumn(c, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*_columns(docs))


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows in ascending doc_id order, null ids first; a null text has the end id only."""
    import public_tokenizers

    return token_output.token_output(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", stage_language), ("near_dedup", stage_near_dedup), ("decontaminate", stage_decontaminate), ("mix", stage_mix), ("token_output", stage_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
