"""A corpus, from raw documents to token ids.

Every stage takes the columns doc_id, text and lang and whatever others there are, whatever their names, and keeps them all (n_chars, if there is
such a column, is set anew where text changes); the last gives doc_id, ids, n_tokens, the text decoded from the ids and whether it is the same.
Rows with null or empty text have no language and go in the first stage; so do ties and texts of which no language is sure. Very long texts go
through whole. Repeated rows and equal texts become one row, that of the least doc_id, null last. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, langid, minhash, pii, spm


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is accepted, dictionaries being of docs' own labels; null and empty texts, ties and unlabelled corpora are not."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; null texts are in no group and stay, empty ones are one group."""
    return minhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the phrases of benchmark; those of which no word is left go, null and empty texts stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, all of them, with surrogates for personal data and secrets; null and empty texts as they are."""
    return pii.anonymised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to; a null text has nulls."""
    return spm.round_trip(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", tokens),
]
#: No SQL: the first stage and the last can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, one after the other; each result is written and read again."""
    from millrace.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
