"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again as the ``docs`` of the next. All but the last return the columns of ``documents``.

toxicity          documents that the classifier predicts toxic go; none, if no labelled row taught it
near_duplicates   of texts whose five-word shingles are alike by 0.8 or more the document with the smallest id
                  stays: blocks of SimHash fingerprints, then the first shingles of what is left; all links verified
decontamination   documents with a benchmark passage go
mixing            all documents, stored in the order of the Pfair mixture
sharding          ranges of that order with equal bytes. The mixture has its target weights up to the slot
                  where the first source ends; shards beyond it lack that source, and the last ones
                  hold what the others left
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.decontaminate import decontaminate
from pairwright.llm.frames import table
from pairwright.llm.mixing import BLOCK_BYTES, OWN, WEIGHTS, mix_sources, mixed
from pairwright.llm.sharding import shard_documents
from pairwright.llm.simhash import dedupe
from pairwright.llm.toxicity import THRESHOLD, toxic_score, train
from pairwright.plans.storage import Scratch

#: The classifier can't be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have the score of the prior, rows with a null id teach nothing but are scored, and
    repeated rows stay or go together. Empty tables of documents or labels are fine: see above."""
    model = train(docs, table(spark, sf_dir, "labels"))
    if not model.taught:
        return docs
    return docs.filter(toxic_score(F.col("text"), model, spark) < THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All null and empty texts are one group. A row with a null id stays only where its group has no other; of rows that
    repeat id and text one stays. An empty table gives an empty one."""
    return dedupe(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words stay, null texts too, and all with an empty benchmark; ids don't matter, and repeated rows
    stay or go together. An empty table gives an empty one."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes. Null texts are rows of one byte, null and unknown sources are one source, rows that repeat id and text
    follow each other. An empty table gives an empty one."""
    return mixed(docs, WEIGHTS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes. The place in the mixture is worked out again from the rows themselves, so it holds however they were stored.
    Nulls and repeated rows are as in the mixture; an empty table gives an empty one."""
    placed = mix_sources(docs, WEIGHTS)
    key = F.col("mix_slot") * BLOCK_BYTES + F.col("mix_offset")
    return shard_documents(placed, key=key).drop(*OWN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
