"""Training-data pipeline over ``documents``: five stages, each reading what
the one before wrote.

A stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last
return the columns of ``documents``.  The driver of the pipeline writes a
stage's rows as Parquet in the shared folder and reads them back, so a lost
executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablework.llm import decontaminate, ngram_join, pii, sentence_pieces, toxicity
from tablework.llm.store import discard, materialise

STAGES = [
    ("toxicity", toxicity.stage),                  # documents scored 0.5 or more go
    ("ngram_jaccard_join", ngram_join.stage),      # one document of each class of near copies stays
    ("decontamination", decontaminate.stage),      # documents that hold a benchmark item go
    ("personal_data", pii.stage),                  # spans are replaced in the texts
    ("sentence_pieces", sentence_pieces.stage),    # the text becomes its pieces' ids
]

#: SQL expresses neither the trained stages nor the tokenizer; the tests hold
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = materialise(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = done
    return docs
