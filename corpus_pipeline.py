"""The corpus pipeline: language ID, exact and near de-duplication, mixing, BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  Its result is
written as Parquet and read again as the next stage's docs.

Defined results, for every stage: null and empty texts are documents like any
others (language ID rejects them, as they have no letter); a null id, language
or source is kept as it is; of rows that repeat id and text one stays after
exact de-duplication; an empty table gives an empty result; texts are read
whole, however long; columns beside those of documents are carried along,
whatever their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm.bpe import encode_texts
from terrapanel.llm.exact_dedup import drop_exact_duplicates
from terrapanel.llm.language_id import fit_languages, keep_known_languages
from terrapanel.llm.mixing import Mix, mix_sources
from terrapanel.llm.queries import VOCABULARY, domain_of
from terrapanel.llm.simhash import drop_near_duplicates
from terrapanel.llm.storage import Tables, bounded_batches

MIX = Mix(
    budget=0.8,
    domain={"web": 0.4, "news": 0.2, "books": 0.2, "reference": 0.2},
    lang={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    source={"src0": 2.0},
    max_epochs=1.0,
    seed=17,
)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose words can't be told with confidence, go."""
    bounded_batches(spark)
    return keep_known_languages(docs, fit_languages(docs, "doc_id", "text", "lang"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest, then the one with the smallest doc_id stays."""
    bounded_batches(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (0.8 of the words of both in common shingles of five) the one with the smallest doc_id stays."""
    bounded_batches(spark)
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each source the part that its share of the token budget pays for, of one epoch."""
    bounded_batches(spark)
    return mix_sources(docs, MIX, domain_of(F.col("source"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of each document, packed as little-endian unsigned 32-bit integers, n_tokens and the decoded text."""
    bounded_batches(spark)
    return encode_texts(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY)).drop("text")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = tables.write(docs, f"stage-{n}")
            if n:
                tables.remove(f"stage-{n - 1}")
    return docs


#: SQL can express neither the trained model nor fingerprints, components and encoding.
ORACLE_SQL = None
