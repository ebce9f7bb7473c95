"""A corpus pipeline over ``documents``: each stage reads what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of documents.  Stages
are joined by tables in the shared folder, so a lost executor costs a re-read
and not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.decontaminate import drop_contaminated
from factloom.llm.line_dedup import drop_repeated_lines
from factloom.llm.near_dup import drop_near_duplicates
from factloom.llm.packing import pack_documents
from factloom.llm.pu_quality import keep_good
from factloom.sources.workspace import drop_tables, materialize, tables_written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Rows are judged one by one by their text: null and empty texts as texts without
    words, repeated rows alike, any doc_id, null included; long texts are read
    whole.  Columns stay as they are.  Without positives or documents all stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in the one of least doc_id; a document that loses all its text goes.

    Null and empty texts stay, rows with a null doc_id aren't touched, rows that
    repeat a doc_id keep or lose lines alike.  Columns stay, whatever their names;
    n_chars follows the text.  An empty table stays empty.
    """
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of least doc_id.

    Texts without words (null, empty) and rows with a null doc_id are in no group
    and stay; rows that share a doc_id stay or go together.  Columns stay as they
    are.  An empty table stays empty.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go.

    Null and empty texts hold none; rows with a null doc_id stay; rows that share
    a doc_id go together.  Columns stay as they are.  An empty table stays empty.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining token gets its place in a bin: the columns of ``pack_documents``.

    Null and empty texts have no tokens and no row; null and repeated doc_ids are
    packed as they are.  An empty table gives an empty result.
    """
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The classifier is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the tables of a stage go when the next one's input is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = tables_written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
            drop_tables(spark, before, keep=1)
    return docs
