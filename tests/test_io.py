import json

import pytest
from pyspark.sql import functions as F

from trovelight import schemas
from trovelight.functions.embedding import (
    HashingEmbedder,
    attach_vectors,
    embed_missing,
)
from trovelight.plans.report import html_table
from trovelight.session import cut_lineage
from trovelight.sources import checkpoints as K
from trovelight.sources import readers as R
from trovelight.sources.crawl import fetch_pages
from trovelight.streaming.incremental import embed_arrivals


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "d", None, 0, 3, "ünï 😀 x")], schemas.CHUNKS)
    for ascii_only in (False, True):
        path = str(tmp_path / f"rows{ascii_only}")
        K.write_jsonl(rows, path, ascii_only)
        assert R.read_jsonl(spark, path, schemas.CHUNKS).collect() == rows.collect()
        text = "".join(p.read_text() for p in (tmp_path / f"rows{ascii_only}").glob("part-*"))
        assert text.isascii() == ascii_only
        assert json.loads(text)["content"] == "ünï 😀 x" and json.loads(text)["document_title"] is None
    assert R.read_jsonl(spark, str(tmp_path / "none"), schemas.CHUNKS, missing_ok=True).count() == 0
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(tmp_path / "none"), schemas.CHUNKS)


def test_json_arrays_vectors_and_metrics(spark, tmp_path):
    queries = [{"query": "a", "question_type": "x", "evidence_list": []}, {"query": "b", "question_type": "y", "evidence_list": [{"url": "u", "fact": "f"}]}]
    (tmp_path / "q.json").write_text(json.dumps(queries, indent=1))
    rows = R.read_queries(spark, str(tmp_path / "q.json")).orderBy("position").collect()
    assert [(r.position, r.query) for r in rows] == [(0, "a"), (1, "b")] and rows[1].evidence_list[0].url == "u"
    (tmp_path / "c.json").write_text(json.dumps([{"url": "u", "title": "t", "body": "b", "extra": 1}]))
    assert R.read_corpus(spark, str(tmp_path / "c.json")).first().body == "b"
    (tmp_path / "v.json").write_text(json.dumps({"texts": ["a", "b"], "vectors": [[1.0], [2.5]]}))
    assert [(r.text, r.vector) for r in R.read_vectors(spark, str(tmp_path / "v.json")).orderBy("position").collect()] == [("a", [1.0]), ("b", [2.5])]
    (tmp_path / "m.json").write_text(json.dumps({"protocol": {}, "conditions": [{"condition": "Baseline", "stored_vectors": 3, "metrics": {"mrr@10": 0.5}}]}))
    found = R.read_metrics(spark, str(tmp_path / "m.json")).first()
    assert (found.position, found.condition, found.metrics["mrr@10"]) == (0, "Baseline", 0.5)


def test_sitemap_and_html(spark, tmp_path):
    xml = ('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a </loc><lastmod>2024</lastmod></url>'
           "<url><loc></loc></url><url><loc>http://b</loc></url></urlset>")  # fmt: skip
    (tmp_path / "s.xml").write_text(xml)
    rows = R.read_sitemap(spark, str(tmp_path / "s.xml")).orderBy("ordinal").collect()
    assert [(r.url, r.last_modified) for r in rows] == [("http://a", "2024"), ("http://b", "")]
    inline = spark.createDataFrame([(xml,)], "x string").select(F.inline(R.sitemap_entries(F.col("x")))).collect()
    assert [(r.url, r.last_modified) for r in inline] == [("http://a", "2024"), ("http://b", "")]
    escaped = spark.createDataFrame([("<urlset><url><loc>http://a?x=1&amp;y=2</loc></url></urlset>",)], "x string")
    assert escaped.select(F.inline(R.sitemap_entries(F.col("x")))).first().url == "http://a?x=1&y=2"
    (tmp_path / "1.html").write_bytes(b"<p>ok\xff")
    (tmp_path / "2.html").write_bytes(b"")
    assert [r.html for r in R.read_html(spark, str(tmp_path)).collect()] == ["<p>ok\ufffd"]


def test_fetch_pages(spark):
    tries = {}

    def get(url):
        tries[url] = tries.get(url, 0) + 1
        if url == "down" or (url == "flaky" and tries[url] < 2):
            raise OSError("no")
        return b"page"

    inventory = spark.createDataFrame([(1, "ok", ""), (2, "flaky", ""), (3, "down", ""), (4, "have", "")], "ordinal long, url string, last_modified string")
    stored = spark.createDataFrame([("have", bytearray(b"x"))], "url string, html binary")
    rows = {r.url: r for r in fetch_pages(inventory, stored, get, pause=lambda s: None, workers=1).collect()}
    assert set(rows) == {"ok", "flaky", "down"} and rows["down"].html is None
    assert rows["ok"].error == "" and rows["flaky"].error == "OSError: no" and bytes(rows["flaky"].html) == b"page"


def test_checkpoints(spark, tmp_path):
    path, target = str(tmp_path / "a"), str(tmp_path / "b")
    schema = "key string, ok boolean"
    assert K.read_checkpoint(spark, path, schema).count() == 0
    for rows in ([("x", True)], [("y", False), ("x", True)]):
        K.append_rows(spark.createDataFrame(rows, schema), path)
    assert [r.key for r in K.compact(spark, path, target, schema, "key", F.col("ok")).collect()] == ["x"]
    dated = spark.createDataFrame([("x", 1, "old"), ("x", 3, "new"), ("x", 2, "mid"), ("y", 1, "only")], "key string, at int, v string")
    K.append_rows(dated, f"{path}-dated")
    newest = K.compact(spark, f"{path}-dated", f"{target}-dated", dated.schema, "key", order="at")
    assert sorted((r.key, r.v) for r in newest.collect()) == [("x", "new"), ("y", "only")]
    fresh = spark.createDataFrame([("c", 1.0)], "condition string, value double")
    stored = K.store_metrics(spark, str(tmp_path / "none"), str(tmp_path / "m1"), fresh)
    again = K.store_metrics(spark, str(tmp_path / "m1"), str(tmp_path / "m2"), fresh.withColumn("value", F.lit(2.0)))
    assert [r.value for r in stored.collect()] == [1.0] and [r.value for r in again.collect()] == [2.0]
    assert cut_lineage(fresh).collect() == fresh.collect()
    assert "1.000" in html_table(fresh, "R & D") and "R &amp; D" in html_table(fresh, "R & D")


def test_embedders(spark):
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",)], "text string")
    cache = spark.createDataFrame([("c", [9.0])], schemas.VECTORS)
    fresh = embed_missing(texts, cache, HashingEmbedder(8))
    assert [r.text for r in fresh.collect()] == ["a b"]
    full = attach_vectors(texts, cache.unionByName(fresh))
    assert full.count() == 3 and full.filter("text = 'c'").first().vector == [9.0]
    with pytest.raises(Exception, match="incomplete"):
        attach_vectors(texts, cache).collect()


def test_streamed_embedding_resumes(spark, tmp_path):
    source, cache, state = (str(tmp_path / n) for n in ("in", "cache", "state"))
    for texts in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(t,) for t in texts], "text string").write.mode("append").parquet(source)
        embed_arrivals(spark, source, cache, state, HashingEmbedder(4)).awaitTermination()
    assert sorted(r.text for r in K.read_checkpoint(spark, cache, schemas.VECTORS).collect()) == ["a", "b", "c"]
