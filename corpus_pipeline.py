"""Corpus pipeline: toxicity, near duplicates, repeated passages, mixing, tokens.

Each stage takes what its predecessor kept.  Toxic documents go; of each group
of near duplicates (similarity 0.8 over five words, found by wide SimHash
fingerprints) the smallest ``doc_id`` stays; words of passages that an
earlier document has go (a document goes if that leaves it none of its words);
sources are mixed to weights 1, 2, 3, repeating, with documents repeated up to
three times or left out; what is left is encoded, with a check that decoding
gives each text again.

Null and empty texts pass the first, third and last stage; the second treats
them as copies of one another.  Repeated rows of one document are near
duplicates.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, repeats, toxicity, wide
from tessera.llm._links import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score, learned from labels of the training folds, does not reject."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into="__score")
    return scored.where("__score < 0.5").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similarity 0.8 over sets of five words."""
    return wide.one_of_similar(docs).select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that earlier documents have."""
    found = repeats.find_repeats(docs).where("n_words = 0 or n_removed < n_words")
    changed = found.withColumns({"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast("long")})
    return changed.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs, mixing.rotating)
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return bpe.tokenize(docs, bpe.public_vocabulary(), carry=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Scores and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stored(docs), sf_dir)
    return docs
