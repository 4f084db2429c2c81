"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.  Rows with a null id pass every filtering stage that
needs an id; documents that share an id are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelight.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from probelight.llm.common import BATCHES, materialize, settings, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a threshold rejects go."""
    return quality_rules.judge(docs).filter("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest id."""
    others = simhash.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are at least a twentieth go."""
    found = decontaminate.find_spans(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.flag(found).filter(~F.col("contaminated")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontaminate", decontaminated),
    ("packing", packed),
]

#: SQL can't express fingerprints, components and tokens; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with settings(spark, BATCHES):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    with settings(spark, BATCHES):  # the texts are read inside; what is left for later has none
        return STAGES[-1][1](spark, docs, sf_dir)
