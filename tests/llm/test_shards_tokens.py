import random

import pytest

from trovelight.llm import shards, tokens
from trovelight.llm.common import shared_folder


@pytest.mark.parametrize("limit", [500, 5_000, 10**9])
def test_shards(spark, limit):
    rng = random.Random(limit)
    rows = [(i if i % 9 else None, "x" * rng.randint(0, 300), "a") for i in range(400)] + [(1, None, "a"), (7, "y" * 700, "b"), (8, "z" * 100, "b")] + [(8, "z" * 100, "b")] * 8
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    found = shards.assign(docs, limit).collect()
    assert len(found) == len(rows)
    total = {}
    for r in found:
        total[r.shard] = total.get(r.shard, 0) + r.n_bytes
    for r in found:
        assert r.shard_bytes == total[r.shard] and r.oversized == (r.shard_bytes > limit) and len(r.shard) == r.depth
    names = sorted(total)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    # Only oversized buckets were split: the halves of a split exceed the limit together.
    for name in names:
        if name:
            assert sum(v for k, v in total.items() if k.startswith(name[:-1])) > limit
    alone = {r.shard for r in found if r.oversized}
    assert all(len({(x.doc_id, x.n_bytes) for x in found if x.shard == s}) == 1 for s in alone)
    assert shards.assign(docs.limit(0), limit).count() == 0


CHANGE = "doc_id long, version string, source string, lang string, op string, tokens long, seq int"


def test_ledger(spark):
    ledger = tokens.Ledger(spark, shared_folder(spark, "ledger"))
    assert ledger.totals().count() == 0
    first = [(1, "v", "a", "en", "insert", 10, 0), (2, "v", "a", "en", "insert", 5, 0), (3, "v", None, None, "insert", 7, 0), (None, "v", "b", "en", "insert", 1, 0), (1, "w", "a", "en", "insert", 4, 0)]
    assert ledger.commit("1", spark.createDataFrame(first, CHANGE)) and not ledger.commit("1", spark.createDataFrame(first, CHANGE))
    read = lambda: {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert read() == {("a", "en", "v"): (2, 15), (None, None, "v"): (1, 7), ("b", "en", "v"): (1, 1), ("a", "en", "w"): (1, 4)}
    # A new count, a move to another source, a delete, a delete of nothing, and two changes of one document of which the later holds.
    second = [(1, "v", "a", "en", "revise", 12, 0), (2, "v", "c", "de", "revise", 6, 0), (None, "v", None, None, "delete", None, 0), (99, "v", "a", "en", "delete", 3, 0), (3, "v", None, None, "revise", 70, 1), (3, "v", None, None, "revise", 8, 2)]
    assert ledger.commit("2", spark.createDataFrame(second, CHANGE))
    assert read() == {("a", "en", "v"): (1, 12), ("c", "de", "v"): (1, 6), (None, None, "v"): (1, 8), ("a", "en", "w"): (1, 4)}
    assert ledger.commit("3", spark.createDataFrame([], CHANGE)) and ledger.batches() == ["1", "2", "3"]
    assert ledger.commit("4", spark.createDataFrame([(1, "v", "a", "en", "insert", 12, 0)], CHANGE))
    assert read()[("a", "en", "v")] == (1, 12)
