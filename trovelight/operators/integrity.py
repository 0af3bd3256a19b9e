"""Integrity rules over a corpus and its benchmark, as a violations table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.operators.chunking import CHUNK_TOKENS
from trovelight.operators.selection import MAX_TOKENS, MIN_TOKENS

# The question types a benchmark may hold.
QUESTION_TYPES = ("inference_query", "comparison_query", "temporal_query", "null_query")


def _counted(rows: DataFrame, **rules) -> DataFrame:
    """One pass over `rows`: how many break each rule; a rule that a NULL leaves open is broken."""
    wide = rows.agg(*[F.count_if(F.coalesce(broken, F.lit(True))).alias(rule) for rule, broken in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n_violations")


def _repeated(rows: DataFrame, **keys: str) -> DataFrame:
    """Surplus rows per key column, all keys in one shuffle."""
    values = rows.select(*[F.col(c).cast("string").alias(rule) for rule, c in keys.items()])
    long = values.unpivot([], list(keys), "rule", "value")
    return (
        long.groupBy("rule", "value")
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy("rule")
        .agg(F.sum("extra").alias("n_violations"))
    )


def corpus_violations(
    documents: DataFrame, chunks: DataFrame, low: int = MIN_TOKENS, high: int = MAX_TOKENS
) -> DataFrame:
    """(rule, n_violations) for documents and chunks; all zero means valid."""
    orphans = chunks.join(documents.select("document_id"), "document_id", "left_anti")
    per_document = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    with_counts = documents.select("document_id").join(per_document, "document_id", "left")
    parts = [
        _repeated(
            documents,
            duplicate_document_id="document_id",
            duplicate_url="url",
            duplicate_body="body_sha256",
        ),
        _counted(
            documents,
            length_out_of_range=~F.col("token_count").between(low, high),
            empty_body=F.trim(F.coalesce("body", F.lit(""))) == "",
        ),
        _repeated(chunks, duplicate_chunk_id="chunk_id"),
        _counted(chunks, invalid_chunk_size=~F.col("token_count").between(1, CHUNK_TOKENS)),
        _counted(orphans, orphan_chunk=F.lit(True)),
        _counted(with_counts, fewer_than_two_chunks=F.coalesce("n", F.lit(0)) < 2),
    ]
    return reduce(DataFrame.unionByName, parts)


def question_violations(questions: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same for benchmark questions: types, gold sizes, gold ids that do not exist."""
    is_null = F.col("question_type") == "null_query"
    n_documents = F.size(F.array_distinct("gold_document_ids"))
    required = ("query", "answer", "gold_document_ids", "gold_evidence", "gold_chunk_ids", "evidence_list")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    any_gold = (
        (F.size("gold_document_ids") > 0)
        | (F.size("gold_chunk_ids") > 0)
        | (F.size("evidence_list") > 0)
    )

    def unknown(column: str, known: DataFrame, key: str, rule: str) -> DataFrame:
        named = questions.filter(~is_null).select("query_id", F.explode(column).alias(key))
        lost = named.join(known.select(key), key, "left_anti").select("query_id").distinct()
        return _counted(lost, **{rule: F.lit(True)})

    parts = [
        _counted(
            questions,
            missing_fields=missing,
            bad_type=~F.col("question_type").isin(*QUESTION_TYPES),
            null_with_evidence=is_null & any_gold,
            not_two_to_four_documents=~is_null & ~n_documents.between(2, 4),
        ),
        unknown("gold_document_ids", documents, "document_id", "unknown_document"),
        unknown("gold_chunk_ids", chunks, "chunk_id", "unknown_chunk"),
    ]
    return reduce(DataFrame.unionByName, parts)


def question_histogram(questions: DataFrame) -> DataFrame:
    """(axis, value, n_questions): questions per type and per number of gold documents."""
    n_documents = F.size(F.array_distinct("gold_document_ids")).cast("string")
    long = questions.select(F.col("question_type").alias("type"), n_documents.alias("documents"))
    return long.unpivot([], ["type", "documents"], "axis", "value").groupBy("axis", "value").agg(
        F.count(F.lit(1)).alias("n_questions")
    )
