"""A sample of catalog queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SAMPLE = ("rrf_top10", "alignment_methods", "document_fact_union", "priority_selection", "neighbors", "merged_means", "generate_offline", "generate_documents", "generate_documents_unbounded")


def canonical(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, folder, name):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    found = queries()[name](spark, folder).toPandas()
    expected = connection.execute(oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert canonical(found) == canonical(expected)


def test_registry():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["query_id", "condition", "rank", "chunk_id", "score"]


def test_fuzzy_location_runs_over_everything(spark, folder):
    located = queries()["locate_fact_fuzzy"](spark, folder)
    assert {r.method for r in located.select("method").distinct().collect()} == {"fuzzy", "unresolved"}


def test_crowded_documents_change_nothing(spark, folder):
    """Scoring some documents' questions apart gives the same ranking."""
    from trovelight.plans import catalog as C
    from trovelight.plans.retrieval import retrieve

    conditions = (C.BOTH_BOUNDED, C.LENIENT_UNBOUNDED)
    asked, pieces = C.benchmark_queries(spark, folder), C.chunks(spark, folder)
    plain = retrieve(asked, pieces, conditions).collect()
    apart = retrieve(asked, pieces, conditions, crowd=8).collect()
    assert sorted(plain) == sorted(apart)


def test_two_hop_queries_are_made_once_for_all_who_read_them(spark, folder):
    """What the nested tables read are stored stages; documents would be split again for each use."""
    read = queries()["namespaced_queries"](spark, folder).inputFiles()
    assert read and not any("documents.parquet" in name for name in read)
