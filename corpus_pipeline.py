"""The corpus pipeline: five stages, each an operator of ``relspark.llm``, applied to ``documents``.

Every stage gets (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the columns of
their input. What a model learns (toxicity, languages) comes from the corpus in ``sf_dir``, never
from the stage's own input, so a stage's decision on a document doesn't depend on the stages before.
"""

from __future__ import annotations

from relspark.llm._store import keep, shared_dir
from relspark.llm.decontam import decontam_stage
from relspark.llm.langid import langid_stage
from relspark.llm.neardup import near_dup_stage
from relspark.llm.packing import packing_stage
from relspark.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", langid_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", decontam_stage),
    ("packing", packing_stage),
]

# Trained models and the tokenizer can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The rows of the last stage."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name, folder)
    return docs
