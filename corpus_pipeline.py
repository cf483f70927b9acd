"""From raw documents to shards: the stages of the training-data pipeline.

Each stage takes all documents that its predecessor kept and returns documents with the same columns; the last one returns
every document's shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayspell.llm import label_shards, prefix_trie_join, subsequence_svm, template_leaks, weighted_mix
from dayspell.llm.common import staged
from dayspell.llm.queries import corpus_mix, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = subsequence_svm.fit(docs, table(spark, sf_dir, "labels"))
    return subsequence_svm.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose five-word shingles link at 0.8 or more; rows that repeat
    id and text count once."""
    return prefix_trie_join.without_copies(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return template_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a budget of nine tenths of all tokens takes in one epoch; a partly taken one stays whole, and
    documents without a token all stay."""
    return weighted_mix.mixed(docs, corpus_mix(share=0.9, epochs=1))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return label_shards.balanced_shards(docs)


#: (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: SQL cannot express the trained first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
