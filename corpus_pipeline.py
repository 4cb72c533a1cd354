"""Corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. The first
three return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import decontaminate, jaccard_join, packing, toxicity
from maskwright.llm.common import checkpoint_dir, table
from maskwright.llm.queries import TOKENIZER

#: Words that a worker remembers while it packs: few, as its executor still holds the heap of the join.
MEMO = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts toxic go; see ``toxicity.drop_toxic``."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each linked group stays, and one of rows that repeat an id; see ``jaccard_join.keep_one``."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; see ``decontaminate.decontaminate``."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 4096 tokens; see ``packing.pack``."""
    return packing.pack(docs, tokenizer=TOKENIZER, with_ids=False, memo=MEMO)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: A trained network decides the first stage, so no SQL gives these rows; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    root = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        stage[1](spark, docs, sf_dir).write.parquet(path := f"{root}/{stage[0]}")
        return spark.read.parquet(path)

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
