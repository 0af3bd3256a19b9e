import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovelight.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(rows, items, longest=1, buckets=10_000, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) by sorting everything."""
    place = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [x for _, x in rows]), (t, items)):
        for text in texts:
            for f in features(text, longest)[0]:
                held[place(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        found, n = features(text, longest)
        weight = sum(gain[place(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return sorted(map(str, (x[:5] for x in out)))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "beta,", "γάμμα", "x1-y", "ΔΕ", "I'm", "nul\x00l", "\x7fa"]) + rng.choice("abcd")
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 5, 19, 20, 21, 60])))) for i in range(n)]
    rows += [(rows[3][0], rows[3][1]), (None, rows[4][1]), (n, None), (n + 1, ""), (n + 2, "word " * 30_000)]
    return rows, [" ".join(word() for _ in range(30)) for _ in range(10)] + [None]


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 37), (3, 10_000, 100)])
def test_against_sorting(spark, longest, buckets, percent):
    rows, items = corpus(longest, 300)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int").repartition(4)
    target = spark.createDataFrame([(x,) for x in items], "text string")
    found = resample.resample(docs, target, longest=longest, buckets=buckets, percent=percent)
    assert [c for c, _ in found.dtypes] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in found.collect()) == brute(rows, items, longest, buckets, percent=percent)


def test_repeated_rows_at_the_cutoff(spark):
    """Rows that share score and id are cut by their number, to the exact count."""
    text = "same words " * 20
    for rows in ([(7, text)] * 40 + [(8, text)] * 3, [(None, text)] * 25):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = resample.resample(docs, docs.limit(0), percent=33).filter("rank IS NOT NULL").collect()
        assert sorted(r["rank"] for r in found) == list(range(1, 33 * len(rows) // 100 + 1))


def test_ties_of_scores(spark):
    rng = random.Random(1)
    values = [(rng.choice([1, 2, 3]), rng.choice([None, *range(40)]), k) for k in range(400)]
    rows = spark.createDataFrame(values, "score long, doc_id long, row long").repartition(5).cache()
    order = sorted(values, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
    for wanted in (1, 2, 57, 133, 134, 250, 399, 400):
        drawn = rows.filter(resample.cutoff(rows, wanted))
        assert sorted(r.row for r in drawn.collect()) == sorted(x[2] for x in order[:wanted])
    assert [r.row for r in resample.ranked(rows).orderBy("rank").collect()] == [x[2] for x in order]


def test_bisection(spark):
    rng = random.Random(2)
    for values in ([5], [3] * 9, [rng.randint(-(2**62), 2**62) for _ in range(200)], [rng.randint(0, 30) for _ in range(300)]):
        rows = spark.createDataFrame([(v,) for v in values], "v long")
        for wanted in {1, len(values) // 2 or 1, len(values)}:
            least = sorted(values)[wanted - 1]
            assert resample.least_reaching(rows, F.col("v"), wanted) == (least, sum(v < least for v in values))


def test_none(spark):
    rows, items = corpus(5, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(x,) for x in items], "text string")
    assert resample.resample(docs.limit(0), target).count() == 0
    assert resample.resample(docs.limit(3), target).filter("rank IS NOT NULL").count() == 0


def test_gains():
    s, t = np.array([0, 10, 5]), np.array([4, 0, 1])
    assert resample.gains(s, t).tolist() == [math.floor(1000 * math.log(x)) for x in (5 * 18 / (1 * 8), 1 * 18 / (11 * 8), 2 * 18 / (6 * 8))]
