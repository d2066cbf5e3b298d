"""A training corpus from raw documents, stage by stage. Counts as part of the text subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halospark.llm.common import cut, table
from halospark.llm.decontaminate import drop_contaminated
from halospark.llm.exact_dedup import drop_exact_copies
from halospark.llm.mixing import mix
from halospark.llm.near_copies import drop_similar
from halospark.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: drop_toxic(docs, table(spark, sf_dir, "labels"))),
    ("exact_dedup", lambda spark, docs, sf_dir: drop_exact_copies(docs)),
    ("simhash_dedup", lambda spark, docs, sf_dir: drop_similar(docs)),
    ("decontaminate", lambda spark, docs, sf_dir: drop_contaminated(docs, table(spark, sf_dir, "benchmark"))),
    ("mix_sources", lambda spark, docs, sf_dir: mix(docs)),
]
#: The classifier and the fingerprints are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
