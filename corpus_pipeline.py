"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame.  ``run`` writes every
stage's rows to the shared folder and reads them back as the next one's documents, so a lost
executor never costs more than the stage at work.

1. toxicity: documents that the toxicity model scores 0.3 or more go.
2. near_duplicates: of each group of documents linked by a shingle similarity of 0.8 or more, the one
   with the smallest id stays.
3. decontamination: documents that hold ten consecutive words of a benchmark item (or the whole of a
   shorter item) go.
4. mixing: sources are brought to weights of the square root of their size by Poisson replication.
5. training_order: the corpus as token sequences of fixed length in a keyed random order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontaminate, mixing, setjoin, toxicity, training_order
from pagemill.llm.common import stored, table

STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("near_duplicates", setjoin.keep_one_of_each),
    ("decontamination", decontaminate.drop_contaminated),
    ("mixing", mixing.mix),
    ("training_order", training_order.order_stage),
]

#: A learnt model, a graph search and a tokenizer: no SQL gives these rows.  Tests hold them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
