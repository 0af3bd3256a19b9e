"""A training corpus from documents, in stages; each stage works on all that the one before it kept.

1. Quality rules: documents that fail, and those of hosts that mostly fail, go.
2. N-gram Jaccard join: of each class of near duplicates the smallest id stays.
3. Benchmark decontamination: documents that hold a benchmark window go.
4. Personal data: every span found is replaced by its kind.
5. Byte-level BPE: the ids of each text, and digests of them and of what they decode to.

A stage's result is written to the cluster's shared folder and read back, so a
lost executor costs its own tasks and a lost stage starts from the last one's files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trovelight.llm import bpe, decontaminate, jaccard, pii, quality
from trovelight.llm.common import table
from trovelight.llm.queries import rank_file
from trovelight.session import cut_lineage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, rank_file(), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode),
]

#: Model and tokenizer stages have no SQL; tests compare the run with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
