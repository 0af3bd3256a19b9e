import math
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovelight.functions import similarity as S
from trovelight.operators import evidence as V
from trovelight.operators import metrics as M


def test_similarity_is_asymmetric(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    found = [r.x for r in rows.select(S.similarity_at_least(0.0)("a", "b").alias("x")).collect()]
    assert found == [0.25, 0.5]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc ", max_size=12), max_size=8), st.sampled_from([0.5, 0.9, 0.94]))
def test_fresh_positions_equal_plain_greedy(keys, limit):
    kept, seen = [], []
    for i, key in enumerate(keys):
        if key and not any(SequenceMatcher(None, key, old).ratio() >= limit for old in seen):
            seen.append(key)
            kept.append(i)
    assert S.fresh_positions(keys, limit) == kept
    assert S.fresh_positions(keys, limit, [keys[i] for i in kept]) == []


def test_locate_facts(spark):
    chunks = spark.createDataFrame(
        [
            ("d1", "c1", 0, "Alpha beta.  Gamma delta epsilon zeta eta theta."),
            ("d1", "c2", 1, "Gamma delta epsilon zeta eta theta. More."),
            ("d2", "c3", 0, "Alpha beta."),
        ],
        "document_id string, chunk_id string, chunk_position int, content string",
    )
    facts = spark.createDataFrame(
        [
            ("q1", 0, "d1", "gamma  DELTA epsilon"),
            ("q1", 1, "d1", "Gamma delta epsilon zeta eta thetas."),
            ("q2", 0, "d2", "gamma delta"),
            ("q3", 0, "d1", ""),
            ("q4", 0, "missing", "alpha"),
        ],
        "query_id string, unit int, document_id string, fact string",
    )
    located = V.locate_facts(facts, chunks)
    rows = {(r.query_id, r.unit, r.chunk_id, r.method) for r in located.collect()}
    assert rows == {
        ("q1", 0, "c1", "exact"),
        ("q1", 0, "c2", "exact"),
        ("q1", 1, "c1", "fuzzy"),
        ("q2", 0, None, "unresolved"),
        ("q3", 0, "c1", "exact"),
        ("q3", 0, "c2", "exact"),
        ("q4", 0, None, "unresolved"),
    }
    assert {r.method: r.n_facts for r in V.method_counts(located).collect()} == {"exact": 2, "fuzzy": 1, "unresolved": 2}
    assert {r.query_id for r in V.resolved_units(located).collect()} == {"q1", "q3"}
    assert {r.query_id for r in V.unresolved_facts(facts, located).collect()} == {"q2", "q4"}


@pytest.mark.parametrize("limit", [0.9, 0.5])
def test_fuzzy_equals_plain_search(spark, limit):
    sentences = ["the cat sat on the mat.", "the cat sat on a mat.", "the cats sat on the mat.", "a dog ran away fast."]
    chunks = spark.createDataFrame(
        [("d", f"c{i}", i, s) for i, s in enumerate(sentences)],
        "document_id string, chunk_id string, chunk_position int, content string",
    )
    wanted = ["the cat sat on the mats.", "the cat sits on the mat.", "a dog ran away faster", "none of it at all", "the cat sat"]
    facts = spark.createDataFrame([(f"q{i}", 0, "d", f) for i, f in enumerate(wanted)], "query_id string, unit int, document_id string, fact string")
    found = {r.query_id: (r.chunk_id, r.ratio) for r in V.fuzzy_hits(facts, chunks, limit).collect()}
    expected = {}
    for i, fact in enumerate(wanted):
        ratios = [SequenceMatcher(None, fact, s).ratio() for s in sentences]
        if max(ratios) >= limit:
            expected[f"q{i}"] = (f"c{ratios.index(max(ratios))}", max(ratios))
    assert found == expected and len(expected) >= 2


def test_filters_and_query_records(spark):
    raw = spark.createDataFrame(
        [
            (0, " One? ", "inference_query", [("u1", "f"), ("u2", "g")]),
            (1, "Two", "null_query", []),
            (2, "Three", "temporal_query", [("u9", "h")]),
            (3, "Four", "temporal_query", []),
        ],
        "position int, query string, question_type string, evidence_list array<struct<url:string,fact:string>>",
    )
    queries = V.answerable(V.with_query_ids(raw))
    assert {r.query_id for r in queries.collect()} == {"q00000", "q00002"}
    corpus = spark.createDataFrame([("u1",), ("u2",)], "url string")
    kept = V.within_corpus(queries, corpus)
    assert [r.query_id for r in kept.collect()] == ["q00000"]
    units = spark.createDataFrame([("q00000", 0, "b"), ("q00000", 0, "a"), ("q00000", 1, "b")], "query_id string, unit int, chunk_id string")
    row = V.query_records(kept, V.evidence_facts(kept), units).first()
    assert row.query == "One?" and row.question_type == "inference"
    assert row.evidence_units == [["a", "b"], ["b"]] and row.gold_chunk_ids == ["a", "b"]
    assert row.required_article_ids == ["u1", "u2"] and row.n_required_evidence_facts == 2


GOLDEN = [
    ([["a175::l0"], ["a010::l0"], ["a011::l1"]],
     "a175::l0,a010::l1,a086::l0,a226::l0,a175::l1,a375::l0,a030::l0,a009::l0,a121::l0,a031::l0",
     (1 / 3, 1 / 3, 1 / 3, 0.0, 1.0)),
    ([["a529::l0"], ["a530::l1"]], "a530::l0,a530::l1,a529::l0", (0.0, 1.0, 1.0, 1.0, 0.5)),
    ([["x"], ["y"]], "a,b,c", (0.0, 0.0, 0.0, 0.0, 0.0)),
]


def test_metric_goldens(spark):
    ranks, units = [], []
    for i, (evidence, ranking, _) in enumerate(GOLDEN):
        ranks += [("c", f"q{i}", cid, r) for r, cid in enumerate(ranking.split(","), 1)]
        units += [(f"q{i}", u, cid) for u, unit in enumerate(evidence) for cid in unit]
    rankings = spark.createDataFrame(ranks, "condition string, query_id string, chunk_id string, rank int")
    need = spark.createDataFrame(units, "query_id string, unit int, chunk_id string")
    metrics = M.query_metrics(rankings, need)
    rows = {r.query_id: r for r in metrics.collect()}
    for i, (_, _, expected) in enumerate(GOLDEN):
        assert tuple(rows[f"q{i}"][m] for m in M.METRICS[:5]) == pytest.approx(expected)
    gain = 1 / math.log2(3) + 1 / math.log2(4)
    assert rows["q1"]["ndcg@10"] == pytest.approx(gain / (1 + 1 / math.log2(3)))
    assert M.means(metrics, "condition").first()["mrr@10"] == pytest.approx(0.5)
    datasets = spark.createDataFrame([("q0", "m"), ("q1", "m"), ("q2", "o")], "query_id string, dataset string")
    by = {r.dataset: r["mrr@10"] for r in M.means_by_dataset(metrics.join(datasets, "query_id")).collect()}
    assert by == pytest.approx({"all": 0.5, "m": 0.75, "o": 0.0})
    with pytest.raises(Exception, match="without evidence"):
        M.query_metrics(rankings, need.filter("query_id <> 'q2'")).collect()


def test_wrong_corpus_rate(spark):
    rankings = spark.createDataFrame(
        [("c", "m::q1", "m::a", 1), ("c", "m::q2", "o::a", 1), ("c", "o::q1", "o::b", 1), ("c", "o::q1", "m::b", 2)],
        "condition string, query_id string, chunk_id string, rank int",
    )
    queries = spark.createDataFrame([("m::q1", "m"), ("m::q2", "m"), ("o::q1", "o")], "query_id string, dataset string")
    found = {r.dataset: r.wrong_corpus_top1 for r in M.wrong_corpus_rate(rankings, queries).collect()}
    assert found == {"m": 0.5, "o": 0.0}


def test_no_matcher_is_made_for_texts_that_lengths_or_equality_settle(monkeypatch):
    made = []
    plain = S.SequenceMatcher
    monkeypatch.setattr(S, "SequenceMatcher", lambda *args: made.append(args) or plain(*args))
    keys = ["ab" * 2**n for n in range(6)]
    assert S.fresh_positions([*keys, *keys], 0.9, ["ab"]) == [1, 2, 3, 4, 5]
    assert made == []
