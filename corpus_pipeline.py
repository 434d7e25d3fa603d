"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Every stage takes odd rows as its operator's docstring says: documents without letters go in the first stage, and with
them null and empty texts; repeated rows of one id and text are one document after the second; an empty table passes
through all stages as an empty table.  Other columns are carried along, but names starting with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm import decontaminate, hilbert, language, lsh_forest, mixing
from meterlens.llm.common import prepared, remainder, stored, table
from meterlens.llm.queries import N_SHARDS, TARGETS


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters, and those unlike any learned language, go."""
    prepared(spark)
    model = language.fit(docs.where(remainder(F.col("doc_id"), 3) != 1), "text", "lang")
    return language.predict_language(docs, model).where(~F.col("rejected")).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepared(spark)
    return lsh_forest.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    prepared(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says, so that domains have their target shares of tokens."""
    return mixing.mixed_documents(docs, mixing.domains_of(table(spark, sf_dir, "labels")), TARGETS)


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot along a Hilbert curve over language, source and length."""
    return hilbert.hilbert_shards(docs, ["lang", "source", "n_chars"], N_SHARDS,
                                  [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))])


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_to_targets),
    ("sharding", put_into_shards),
]

#: Models are fitted and groups searched; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
