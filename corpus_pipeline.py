"""A corpus pipeline: each stage reads the documents that the one before it kept.

Every stage but the last returns the columns of `documents`; each is written as Parquet in the shared folder and read
again as the next one's input, so that a lost executor costs at most the stage that is running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import decontamination, jaccard_join, language_id, sentencepiece_bpe, suffix_dedup
from pulseframe.llm.shared import cut, drop_cut, unused

#: Bytes that must repeat to be removed: less than any passage of 50 words, more than a stock sentence.
REPEAT_BYTES = 100


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be identified; those without letters, null and empty texts go.

    `und` comes from a rule on letters, so the network runs but decides nothing about which documents stay. Repeated
    rows and rows with a null id are judged by their text alone; lang stays as it was given.
    """
    model = language_id.fit(docs.where(~F.coalesce(language_id.held_out(), F.lit(False))).select("doc_id", "text", "lang"))
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    return language_id.predict(docs, model, lang_out=lang, score_out=score).where(F.col(lang) != language_id.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document with the smallest id.

    Of repeated rows of one id the smallest text stays; rows with a null id, null texts and texts without words stay.
    """
    return jaccard_join.keep_one(docs, 5, 80, 100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; n_chars follows the text.

    Null texts stay null, rows with a null id stay as they are, repeated rows of one id take nothing from each other.
    """
    out = suffix_dedup.remove_repeats(docs, REPEAT_BYTES)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie in benchmark windows go.

    Null texts and rows with a null id stay; of repeated rows of one id all go if one is contaminated.
    """
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each kept text encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty; every row, repeated or without an id, gives a row.
    """
    return sentencepiece_bpe.round_trip(docs)


STAGES = [
    ("language_id", identify_languages),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_tokens),
]

#: The first stage's network can't be written in SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. An empty table gives none; what a stage wrote is removed once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), name)
        drop_cut(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
