"""A corpus from documents: quality rules, language ID, one of each group of near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decision_list, jaccard, langid, packing
from lodestrata.llm.common import pick, written
from lodestrata.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject.

    Rules are learned from a bounded sample of the labelled documents; the statistics of all are computed once.

    Cases: null and empty texts, and those under 20 words, go; without labels of both kinds only the base rules decide; rows
    that repeat stay or go together; an empty table stays empty; columns besides COLUMNS are left out.
    """
    docs = pick(docs, *COLUMNS)
    rule = decision_list.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    of = lambda name: F.col(f"_s.{name}")
    judged = docs.select(*COLUMNS, decision_list.statistics_column(F.col("text")).alias("_s"))
    return judged.where(~decision_list.base_failed(of) & (decision_list.expression(rule, decision_list.ratios(of)) == 0)).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like the labelled texts of a language; all of them if none is labelled.

    Cases: null texts and those without a letter go if there is a model; a null lang or doc_id only means that the row
    teaches nothing; rows that repeat stay or go together; an empty table stays empty; columns besides COLUMNS are left out.
    """
    docs = pick(docs, *COLUMNS)
    model, familiar = (spark.sparkContext.broadcast(x) for x in (langid.model_of(docs), langid.familiar_of(docs)))
    return docs.where(langid.known_column(F.col("text"), model, familiar))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id.

    Cases: texts without words are copies of each other; of rows that repeat one stays; of equal ids the text with the least
    digest stays; a null doc_id comes last; an empty table stays empty; columns besides COLUMNS are left out.
    """
    return jaccard.one_of_each(pick(docs, *COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    Cases: null and empty texts are the closing id alone; rows that repeat are packed as rows of their own; a null doc_id is
    kept; an empty table gives no pieces; columns besides doc_id and text are not read.
    """
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("packing", packed)]
#: Learned stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
