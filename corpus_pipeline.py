"""Training corpus from ``documents``: five stages, each one operator.

Every stage gets what its predecessor kept, written as Parquet and read again;
all but the last return the columns of their input.

A null text counts as empty; documents without words pass the first stages and leave with the mix, which deals in
words.  Null ids, languages and sources are values of their own.  Repeated rows are one group of copies,
of which one row stays.  Very long texts go whole through every stage.  Ties are broken by the smaller
doc_id, then text.  Empty tables give an empty result; without toxicity labels no document is
rejected.  Other columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from comparo.llm import op3_mix, op4_toxicity, op6_simhash, op7_pack, op10_lines
from comparo.llm.common import dropped, prepare, saved, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    prepare(spark)
    return op4_toxicity.clean(docs, op4_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site boilerplate lines."""
    prepare(spark)
    return op10_lines.cleaned_documents(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return op6_simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    prepare(spark)
    return op3_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in packed sequences."""
    prepare(spark)
    return op7_pack.packed(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("mix", mix), ("pack", pack)]

#: Trained scores, seeded hashes and token ids: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(docs)  # the table of the stage before; the input stays
        docs = out
    return docs
