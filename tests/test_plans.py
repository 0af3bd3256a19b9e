import json

from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.operators import benchmark as Q
from trovelight.operators.chunking import WordTokenizer, encoded_chunks, sliding_chunks
from trovelight.operators.integrity import corpus_violations, question_violations
from trovelight.plans.corpus import build_corpus
from trovelight.plans.questions import build_benchmark, bundle_documents


def page(title, words):
    return f"<html><main><article><h1>{title}</h1><p>{' '.join(words)}</p></article></main></html>"


def corpus(spark):
    rows = [(i, f"http://s/bg/{'news' if i % 2 else 'faqs'}/p{i}", "2024" if i % 3 else "",
             page(f"Plan{i}", [f"word{i}x{j % 7}" for j in range(1100 + i)]), "") for i in range(5)]
    rows += [(5, "http://s/bg/news/short", "", page("S", ["a"]), ""), (6, "http://s/x", "", None, "OSError: no")]
    rows += [(7, "http://s/bg/news/copy", "", page("Plan1", [f"word1x{j % 7}" for j in range(1101)]), "")]
    pages = spark.createDataFrame(rows, "ordinal long, url string, last_modified string, html string, error string")
    return build_corpus(pages, "Site", "bg", limits=(1000, 2000), target=4, preferred=1100)


def test_corpus_build(spark):
    built = corpus(spark)
    status = {r.url.rsplit("/", 1)[-1]: r.status for r in built.audit.collect()}
    assert status == {
        "p0": "eligible", "p1": "eligible", "p2": "eligible", "p3": "eligible",
        "p4": "eligible_not_selected_target_cap", "short": "length_excluded", "x": "download_error",
        "copy": "duplicate_excluded",
    }
    documents = {r.document_id: r for r in built.documents.collect()}
    assert [documents[f"doc_{i:04d}"].title for i in (1, 2, 3, 4)] == ["Plan0", "Plan1", "Plan2", "Plan3"]
    assert documents["doc_0001"].date is None and documents["doc_0002"].date_type == "last_modified"
    assert not documents["doc_0001"].body.startswith("Plan0")
    found = {r.rule: r.n_violations for r in corpus_violations(built.documents, built.chunks, 1000, 2000).collect()}
    assert set(found.values()) == {0}
    shaped = Q.to_evaluation_chunks(built.chunks).filter("document_id = 'doc_0001'").orderBy("chunk_id").collect()
    assert [r.chunk_position for r in shaped] == [0, 1]


def test_encoded_chunks_agree_with_sliding(spark):
    docs = spark.createDataFrame([(f"d{n}", " ".join(map(str, range(n)))) for n in (0, 1, 20, 21, 55)], "document_id string, body string")
    plain = sliding_chunks(docs, T.word_tokens(F.col("body")), size=20, overlap=4)
    coded = encoded_chunks(docs, WordTokenizer(), size=20, overlap=4)
    assert sorted(plain.collect()) == sorted(coded.collect())


def quoting(task, content, seed):
    """Quotes three words of each document; botches some tasks on the first attempt."""
    results = []
    for item in json.loads(content)["tasks"]:
        number = int(item["query_id"][2:])
        quotes = [
            {"document_id": d["document_id"], "chunk_id": d["chunk_id"], "fact": " ".join(d["text"].split()[:3])}
            for d in item["documents"]
        ]
        if number % 3 == 0 and seed == 42:
            quotes = quotes[:1]
        same = "same text" if number in (1, 2) else f"Question {number}?"
        results.append({**{k: item[k] for k in ("query_id", "question_type")}, "query": same, "answer": "a", "evidence": quotes})
    return {"results": results}


def test_benchmark_build(spark, tmp_path):
    built = corpus(spark)
    specs = Q.question_specs(built.documents, {"x_query": 6, "comparison_query": 3, "null_query": 2}, {2: 6, 3: 3})
    pieces = built.chunks.withColumnsRenamed({"text": "content", "token_count": "n_tokens"})
    excerpts = Q.best_excerpts(specs, built.documents, pieces)
    bundles = bundle_documents(specs, excerpts, built.documents, built.chunks)
    kept, missing = build_benchmark(bundles, quoting, str(tmp_path / "checkpoint"))
    assert [r.query_id for r in missing.collect()] == ["yq00002"]
    assert kept.count() == 10
    found = {r.rule: r.n_violations for r in question_violations(kept, built.documents, built.chunks).collect()}
    assert found.pop("bad_type") == kept.filter("question_type = 'x_query'").count()
    assert set(found.values()) == {0}
    assert sum(r.n_questions for r in Q.type_histogram(kept).collect()) == 10

    def differing(task, content, seed):
        """As before, but repeats no question."""
        reply = quoting(task, content, seed)
        return {"results": [{**r, "query": f"{r['query']} {r['query_id']}"} for r in reply["results"]]}

    again, missing = build_benchmark(bundles, differing, str(tmp_path / "checkpoint"))
    assert missing.count() == 0 and again.count() == 11
    assert again.filter("query_id = 'yq00002'").first().query == "same text yq00002"


def test_a_failing_reply_costs_only_its_tasks(spark, tmp_path):
    built = corpus(spark)
    specs = Q.question_specs(built.documents, {"x_query": 6, "comparison_query": 3}, {2: 6, 3: 3})
    pieces = built.chunks.withColumnsRenamed({"text": "content", "token_count": "n_tokens"})
    bundles = bundle_documents(specs, Q.best_excerpts(specs, built.documents, pieces), built.documents, built.chunks)

    def failing(task, content, seed):
        if any(item["query_id"] == "yq00005" for item in json.loads(content)["tasks"]):
            raise RuntimeError("no reply")
        return quoting(task, content, 43)

    kept, missing = build_benchmark(bundles, failing, str(tmp_path / "checkpoint"))
    assert kept.count() > 0 and "yq00005" in {r.query_id for r in missing.collect()}
