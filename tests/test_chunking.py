import random

from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.operators.chunking import UNIT, packed_windows, sentence_chunks, sliding_chunks


def test_sliding_counts_and_starts(spark):
    sizes = [0, 1, 1024, 1025, 1920, 1921]
    docs = spark.createDataFrame([(f"d{n}", " ".join(map(str, range(n)))) for n in sizes], "document_id string, text string")
    rows = sliding_chunks(docs, T.word_tokens(F.col("text"))).collect()
    counts = [sum(r.document_id == f"d{n}" for r in rows) for n in sizes]
    assert counts == [0, 1, 1, 2, 2, 3]
    for r in rows:
        assert r.token_start % 896 == 0 and r.n_tokens == r.token_end - r.token_start
        assert r.content.split() == [str(x) for x in range(r.token_start, r.token_end)]
        assert r.chunk_id == f"{r.document_id}::c{r.chunk_position:02d}"


def packed(units, size, overlap):
    """Windows from how far each start reaches and where each end leads back to, over running totals."""
    total = [0]
    for *_, cost in units:
        total.append(total[-1] + cost)
    n, found, first = len(units), [], 0
    while first < n:
        end = max(i for i in range(first + 1, n + 1) if i == first + 1 or total[i] - total[first] <= size)
        found.append(list(range(first, end)))
        if end == n:
            break
        back = max((i for i in range(end + 1) if total[end] - total[i] >= overlap), default=0)
        first = back if back > first else end
    if len(found) > 1 and [units[i] for i in found[-1]] == [units[i] for i in found[-2]]:
        found.pop()
    return found


def on_spark(spark, lists, size, overlap):
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(lists)], f"k int, units {UNIT}")
    spans = rows.select("k", packed_windows(F.col("units"), size, overlap).alias("w")).collect()
    return [[list(range(w.first, w.first + w.n)) for w in r.w] for r in sorted(spans)]


def units(*costs):
    return [(0, f"s{i}", c) for i, c in enumerate(costs)]


def test_packing_cases(spark):
    lists = [units(900, 500), units(100, 900, 500), [], units(5), [(0, "a", 600), (0, "a", 600)], [(0, "a", 600), (1, "a", 600)]]
    want = [[[0], [1]], [[0, 1], [1], [2]], [], [[0]], [[0]], [[0], [1]]]
    assert on_spark(spark, lists, 1024, 128) == want == [packed(u, 1024, 128) for u in lists]


def test_packing_equals_the_definition(spark):
    rng = random.Random(7)
    for size, overlap in ((40, 10), (40, 0), (12, 11), (5, 3)):
        lists = [[(rng.randrange(2), rng.choice("ab"), rng.randint(1, size)) for _ in range(rng.randrange(40))] for _ in range(120)]
        found = on_spark(spark, lists, size, overlap)
        assert found == [packed(u, size, overlap) for u in lists]
        for u, windows in zip(lists, found, strict=True):
            assert all(sum(u[i][2] for i in w) <= size for w in windows)


def test_a_document_of_many_sentences(spark):
    text = " ".join(f"w{i} x." for i in range(60_000))
    docs = spark.createDataFrame([("d", text), ("n", None), ("e", " \n\n ")], "document_id string, body string")
    rows = sentence_chunks(docs).orderBy("chunk_position").collect()
    assert {r.document_id for r in rows} == {"d"} and all(r.n_tokens <= 1024 for r in rows)
    assert rows[-1].content.endswith("w59999 x.") and rows[1].content.startswith("w448 x.")


class Letters:
    """A tokenizer of single letters whose decoder trims nothing."""

    def encode(self, text):
        return list(text)

    def decode(self, ids):
        return "".join(ids)


def test_own_tokenizer(spark):
    docs = spark.createDataFrame([("d", "Ab cd. Ef gh ij kl mn op. Qr.")], "document_id string, body string")
    rows = sentence_chunks(docs, tokenizer=Letters(), size=10, overlap=3).orderBy("chunk_position").collect()
    assert [r.content for r in rows] == ["Ab cd.", "Ef gh ij k", "l mn op.", "Qr."]
    assert [r.n_tokens for r in rows] == [6, 10, 8, 3]


def test_sentence_chunks_split_long_sentences(spark):
    long = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([("d", f"A b c. D e!\n\n{long}. End here.")], "document_id string, body string")
    rows = sentence_chunks(docs, size=10, overlap=3).orderBy("chunk_position").collect()
    assert rows[0].content.startswith("A b c. D e!")
    assert all(r.n_tokens <= 10 for r in rows)
    joined = " ".join(r.content for r in rows)
    assert all(f"w{i}" in joined for i in range(25)) and joined.endswith("End here.")
