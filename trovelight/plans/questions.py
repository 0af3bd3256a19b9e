"""Generating an evaluation benchmark from specs, resumable question by question."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight import schemas
from trovelight.operators import benchmark as Q
from trovelight.operators.evidence import last_per_key
from trovelight.operators.generation import SEED, Generator
from trovelight.sources.checkpoints import append_rows, read_checkpoint

BENCHMARK_TASK = (
    "For each task write one natural question of its type that needs all of its documents, a short "
    "answer, and one verbatim quote per document. For null_query write a plausible question the "
    'documents do not answer. Answer with JSON {"results":[{"query_id":"","query":"","answer":"",'
    '"question_type":"","evidence":[{"document_id":"","chunk_id":"","fact":""}]}]}.'
)
RAW = (
    "query_id string, question_type string, query string, answer string, attempt int, "
    f"evidence {schemas.EVIDENCE}"
)
STORED = f"{schemas.BENCHMARK_QUESTIONS}, round long"
# Tasks per model call, calls per task.
BATCH = 4
ATTEMPTS = 4


def bundle_documents(specs: DataFrame, excerpts: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per question with its documents, each by its chosen chunk."""
    texts = chunks.select("chunk_id", F.col("text"))
    meta = documents.select("document_id", "title", "url", "source", "category", "date")
    entry = F.struct(
        "place", "document_id", "chunk_id", "title", "url", "source", "category", "date", "text"
    )
    rows = (
        specs.join(excerpts.select("query_id", "place", "chunk_id"), ["query_id", "place"])
        .join(meta, "document_id")
        .join(texts, "chunk_id")
    )
    grouped = rows.groupBy("query_id", "question_type").agg(
        F.array_sort(F.collect_list(entry)).alias("documents")
    )
    return grouped.withColumn(
        "documents", F.transform("documents", lambda d: d.dropFields("place"))
    )


def ask(pending: DataFrame, generator: Generator, attempt: int) -> DataFrame:
    """Raw answers to the pending tasks, a few tasks per call."""
    tasks = pending.select(
        "query_id",
        F.to_json(F.struct("query_id", "question_type", "documents")).alias("task"),
    )

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                listed = ",".join(batch["task"].iloc[at : at + BATCH])
                try:
                    found = generator(BENCHMARK_TASK, f'{{"tasks":[{listed}]}}', SEED + attempt).get("results", [])
                except Exception:  # its tasks stay pending; the other answers are kept
                    found = []
                yield pd.DataFrame({"answer": [json.dumps(row) for row in found]}, dtype=object)

    fields = "query_id string, question_type string, query string, answer string, evidence " + schemas.EVIDENCE
    return (
        tasks.mapInPandas(each, "answer string")
        .select(F.from_json("answer", fields).alias("r"))
        .select("r.*", F.lit(attempt).alias("attempt"))
    )


def _kept(stored: DataFrame, bundles: DataFrame) -> DataFrame:
    """The newest answer of each task, without those whose question an earlier id asks too."""
    newest = last_per_key(stored, ["query_id"], "round").drop("round")
    asked = newest.join(bundles.select("query_id"), "query_id", "left_semi")
    return Q.deduplicate_questions(asked).filter("is_first").drop("is_first")


def build_benchmark(bundles: DataFrame, generator: Generator, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions and the ids still missing, resuming from the checkpoint at `path`.

    Only fully grounded answers are stored, each with the round it came from. Of
    questions with the same text the first by id stays; the others are asked
    again, with the seed of a new round, and their newest answer counts.
    """
    spark = bundles.sparkSession
    for _ in range(ATTEMPTS):
        stored = read_checkpoint(spark, path, STORED)
        pending = bundles.join(_kept(stored, bundles).select("query_id"), "query_id", "left_anti")
        if pending.isEmpty():
            break
        number = stored.agg(F.coalesce(F.max("round") + 1, F.lit(0))).first()[0]
        answers = Q.canonical_questions(ask(pending, generator, number), bundles)
        append_rows(answers.withColumn("round", F.lit(number).cast("long")), path)
    kept = _kept(read_checkpoint(spark, path, STORED), bundles)
    missing = bundles.select("query_id").join(kept.select("query_id"), "query_id", "left_anti")
    return kept, missing
