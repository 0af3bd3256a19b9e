"""Each query with SQL against it, and the pipeline against a plain one, on the smallest tables."""

import base64
import os

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_jaccard import brute as classes
from tests.llm.test_quality import figures
from trovelight.llm import pii
from trovelight.llm.queries import ORACLE, rank_file


def canonical(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return sorted(tuple("null" if v is None or v != v else str(v) for v in row) for row in frame.where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, folder, name):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    found, expected = queries()[name](spark, folder).toPandas(), connection.execute(oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert [[x.removesuffix(".0") for x in r] for r in canonical(found)] == [[x.removesuffix(".0") for x in r] for r in canonical(expected)]


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    host_bad = {r.doc_id for r in queries()["op1_quality_rules"](spark, folder).filter("host_bad").collect()}
    kept = []
    for r in docs:
        n, _, _, _, repeated = figures(r.text)
        if n >= 50 and 100 * repeated <= 50 * n and r.doc_id not in host_bad:
            kept.append((r.doc_id, r.text))
    named = {i: c for i, _, c in classes(kept)}
    kept = [(i, t) for i, t in kept if named[str(i)] == str(i)]
    kept = [(i, t) for i, t in kept if not windows([(i, t)], items)[0][5]]
    spans = pii.spans_of([t for _, t in kept], pii.model())
    kept = [(i, pii.masked(t, b + a)) for (i, t), (b, a) in zip(kept, spans, strict=True)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file().splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in found) == sorted((i, plain.encode_ordinary(t)) for i, t in kept)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
