import random
import re

from pyspark.sql import functions as F

from trovelight.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def brute(docs, items, width=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + width]), set()).add(str(item) if item is not None else "")
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if found := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, win int")


def test_against_all_windows(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdef") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 7, 10, 14])))) for i in range(30)]
    items += [(90, None), (91, "..."), (92, items[4][1]), (93, items[5][1].upper() + "!"), (None, "zz yy")]
    docs = []
    for i in range(80):
        body = [word() for _ in range(rng.choice([0, 1, 4, 30, 90]))]
        if rng.random() < 0.5:
            body[len(body) // 2 : len(body) // 2] = words(rng.choice(items)[1]) * rng.choice([1, 2])
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body)))
    docs += [(3, docs[3][1]), (3, "another text zz-yy"), (None, docs[5][1]), (200, None), (201, "")]
    d, b = frames(spark, docs, items)
    for block in (decontaminate.BLOCK, 40):
        found = sorted((tuple(r) for r in decontaminate.hits(d, b, block=block).collect()), key=str)
        assert [(*r[:4], list(r[4]), r[5]) for r in found] == brute(docs, items)
    clean = decontaminate.keep_clean(d, b, block=60)
    assert clean.columns == d.columns
    assert sorted((str(r.doc_id), r.text) for r in clean.collect() if r.text) == sorted((str(i), t) for (i, t) in docs if t and not brute([(i, t)], items)[0][5])


def test_empty_sides(spark):
    d, b = frames(spark, [(1, "a b c")], [(1, "b")])
    none = F.lit(False)
    assert [r.n_hit for r in decontaminate.hits(d, b).collect()] == [1]
    assert [r.n_hit for r in decontaminate.hits(d, b.filter(none)).collect()] == [0]
    assert decontaminate.hits(d.filter(none), b).count() == 0
    assert decontaminate.keep_clean(d, b.filter(none)).count() == 1
