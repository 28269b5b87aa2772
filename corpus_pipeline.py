"""A corpus pipeline over ``documents``: toxicity, language, near copies, shared passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes
every stage but the last to a table in the session's shared folder and reads it
again for the next one, so no stage's lineage reaches beyond its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftscope.llm import common, jaccard_join, language_id, packing, substring_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not predict toxic.

    Null and empty texts score as empty ones; null ids are never learned from;
    repeated rows share their fate; without labels of both classes all stay.
    Other columns than the documents' are dropped here, whatever their names.
    """
    common.release(spark)
    common.small_batches(spark)
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null, empty and letterless texts go, whatever their length.

    Null ids and languages take part but are never learned from; repeated rows
    share their fate; where no language is known, texts with a letter stay.
    """
    common.release(spark)
    net = language_id.fit(docs)
    if net is None:  # no language to tell: texts with a letter stay
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return language_id.identify(docs, net).where("lang_pred <> 'und'").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 4-word shingles at a similarity of 0.85: the one with the least id.

    Of repeated rows one stays; an id that names several texts stands for each of
    them apart; documents without words and those without an id stay.
    """
    common.release(spark)
    return jaccard_join.one_of_each(docs).select(*COLUMNS)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 35 words that start anywhere else too; ``n_chars`` is counted anew.

    Null texts and those under 35 words stay as they are; a text may become empty;
    of repeated rows nothing that has 35 words stays.
    """
    common.release(spark)
    return substring_dedup.deduplicated(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences of at most 2048 tokens.

    A null text is an empty one; null ids are kept; repeated rows are packed each for itself.
    """
    common.release(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("jaccard_join", one_of_near_copies),
    ("substring_dedup", cut_shared_passages),
    ("best_fit_packing", pack),
]

#: The classifiers and the tokenizer are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives an empty result."""
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
