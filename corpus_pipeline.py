"""A training corpus from `documents`: toxic documents go, near duplicates and repeated passages go, and
what is left is packed into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import ngram_join, packing, suffix_dedup, toxicity
from tidewater.llm.common import dropped, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the field, learned from the labels, rejects.

    Null and empty texts have the score of no evidence and stay, as do texts without words; repeated rows
    are judged one by one, null ids are kept. Texts are scored whole at any length. Without rows or labels
    nothing is rejected. Other columns are kept whatever their names."""
    return toxicity.clean(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id.

    Null texts and texts without words are nobody's duplicates and stay. Of rows that are the same one
    stays; a null id comes before all others. Very long texts are compared whole. An empty table stays
    empty; other columns are kept."""
    return ngram_join.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs, without the strings of 100 bytes that start earlier too; n_chars is counted again.

    Null texts stay null and count no characters, empty and short ones stay as they are, very long ones are
    searched whole. Null ids come before all others; equal rows are one text and keep the same. An empty
    table stays empty; other columns are kept."""
    return suffix_dedup.remove_repeats(docs, columns=True).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all docs in sequences of 2048 tokens.

    Null and empty texts are their closing token; a very long text fills many sequences. Null ids and
    repeated rows are packed row by row, null sources are one source. No rows: no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
        if last is not None:
            dropped(last)  # the next stage reads what this one has written
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage's scores can't be had in SQL; the stages are tested one by one against plain versions.
ORACLE_SQL = None
