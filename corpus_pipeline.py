"""A cleaning pipeline over documents: each stage takes what the one before it has kept.

Language identification drops texts without a language, near-duplicate groups shrink to one document, long repeated strings are
cut out, documents that hold a benchmark item go, and what is left is encoded. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quartier.llm import bpe, decontaminate, io, language, near_dup, suffix_dedup

STAGES = [
    ("language id", language.stage),
    ("near-duplicates", near_dup.stage),
    ("repeated strings", suffix_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("bpe encoding", bpe.stage),
]

#: SQL expresses none of the five stages as a whole; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = io.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
