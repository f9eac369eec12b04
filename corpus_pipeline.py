"""A corpus from documents to packed sequences, in stages that are each written and read again.

All stages but the last return the columns of their input, whatever other
columns it has. They work on rows: a null or repeated id does no harm, an empty
table gives an empty one, and a text of any length is taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, packing, quality_classifier, toxicity
from millrace.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts label 1 for.

    A null text is scored as an empty one; a score that ties with the threshold
    stays; repeated rows get equal scores, so all or none stay.
    """
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.column(F.col("text")) >= quality_classifier.THRESHOLD)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier does not predict label 1 for.

    A null text is scored as an empty one; a score that ties with the threshold
    goes; repeated rows get equal scores, so all or none stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.column(F.col("text")) < toxicity.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of the Jaccard join connect, the one with the least id.

    Five words and a similarity of 0.8, as for all near-duplicate stages. Null
    and empty texts link with nothing and all stay; of repeated rows one stays;
    a row without an id gives way to one with an id.
    """
    return jaccard_join.keep_one(docs, similar=80, words=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequences.

    A null or empty text is one piece of one token, each repeated row is packed
    for itself, and columns other than doc_id and text are left out.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", harmless),
    ("n-gram Jaccard join", distinct),
    ("best-fit packing", packed),
]

#: The stages are models and exact joins that SQL cannot express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
