"""A training-data pipeline over the documents: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns rows that are written and read again as the next one's docs; all but the
last return the columns of documents. The mix repeats documents, so its rows are copies in training order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import cut, table
from quillon.llm.linededup import line_stage
from quillon.llm.mixing import mix_stage
from quillon.llm.packing import pack_stage
from quillon.llm.quality import quality_stage
from quillon.llm.simhash import simhash_stage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("simhash", simhash_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]
#: Fitted outliers, MinHash and SimHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
