"""A corpus pipeline of five of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents. Documents of no sure language go,
one document of each near-duplicate group stays, documents that give a benchmark item away go, personal data
is replaced by its kind in brackets, and the last stage adds SentencePiece ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm import common, decontaminate, language, pieces, pii, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells with a score of 0.5 or more.

    Null texts and texts without a letter go, as does everything where no document has a language to learn from; null ids,
    repeated rows and further columns stay as they are; an empty table stays empty.
    """
    return language.confident(docs, language.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five words have a Jaccard similarity of 0.8 or more.

    The least id stays, null ids come last; all null and empty texts are one group; a text of fewer than five words is
    compared by all its words; of rows that share id and text one stays; further columns may have any name.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover less than 0.8 of every benchmark item.

    Null and empty texts, and items of fewer than five words, match nothing; repeated rows are judged alike; an empty
    table stays empty, and an empty benchmark takes nothing away.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind in brackets; n_chars follows the text.

    A null text stays null (and n_chars null), an empty one empty; spans that overlap are one; rows are neither joined nor
    dropped.
    """
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_pieces and pieces, their SentencePiece ids; null and empty texts have none.

    Columns that have these names already are replaced.
    """
    return pieces.with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mask_pii", mask_pii),
    ("sentencepiece", sentencepiece),
]
#: SQL can express neither trained models nor tiling; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir))
        common.discard(before)  # a stage's table; the documents stay
    return docs
