"""Corpus pipeline: quality rules, line dedup, near-duplicate documents, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binlore.llm.common import fresh_path
from binlore.llm.decontaminate import stage_decontaminate
from binlore.llm.jaccard import stage_near_duplicates
from binlore.llm.lines import stage_lines
from binlore.llm.packing import stage_packing
from binlore.llm.quality import stage_quality

STAGES = [
    ("quality rules", stage_quality),
    ("line dedup", stage_lines),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("benchmark decontamination", stage_decontaminate),
    ("packing", stage_packing),
]

#: Stages hash words and tokens, which SQL cannot express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
