import random

import numpy as np
import pyarrow as pa
import pytest

from trovelight.llm import jaccard


def sets(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    held = [(i, sets(t)) for i, t in rows]
    root = list(range(len(held)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(held)):
        for b in range(a):
            i = len(held[a][1] & held[b][1])
            if held[a][1] and held[b][1] and 100 * i >= 75 * (len(held[a][1]) + len(held[b][1]) - i):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(held):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(s), str(least.get(find(k)) if s else i)) for k, (i, s) in enumerate(held))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randint(0, 400))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // rng.choice([12, 25, 40])))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [word()], [word(), word()]])
                words = words or [word()]
        else:
            words = [word() for _ in range(rng.choice([1, 3, 5, 6, 8, 9, 12, 30, 80, 200]))]
            if kind > 0.8:
                words[1:1] = passage
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed, 260)
    rows += [(900, None), (901, ""), (902, " \n"), (7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.classes(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)


@pytest.mark.parametrize(("few", "left"), [(0, 0), (16, 0), (4, 1)])
def test_a_passage_that_many_texts_share(spark, few, left, monkeypatch):
    """Two thousand texts around one passage, near copies among them: crowded buckets are signed again, and no link is lost."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "LEFT", left)
    rng = random.Random(21)
    word = lambda: f"q{rng.randint(0, 10**6)}"
    passage, texts = [word() for _ in range(60)], []
    for k in range(2000):
        own = [word() for _ in range(rng.choice([8, 20, 40, 60, 100]))]
        if k % 10 == 0 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = word()
        else:
            at = rng.randrange(len(own))
            words = [*own[:at], *passage, *own[at:]]
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)


def test_large_sets(spark):
    """Sets beyond the common sketch, on both sides of a doubling of the wide one, near, far and sharing a long passage."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    texts = []
    for n in (1900, 2040, 2060, 4050, 4150, 8300):
        base = [word() for _ in range(n)]
        for edits in (0, n // 60, n // 28, n // 8):
            words = list(base)
            for at in rng.sample(range(n), edits):
                words[at] = word()
            texts.append(" ".join(words))
        texts.append(" ".join(base + [word() for _ in range(n // 4)]))
        texts.append(" ".join(base[: n // 2] + [word() for _ in range(n // 2)]))
    rows = list(enumerate(texts))
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)


def test_every_link_shares_a_bucket():
    """The pigeonhole argument, on sets just above the threshold of all sizes."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 75, 100, 150, 151, 300, 1000, 5000]:
        for _ in range(4):
            most = int((4 * n) // 3)
            m = int(rng.integers(n, most + 1))
            inner = -(-3 * (n + m) // 7)  # least intersection at 0.75
            if inner > n:
                continue
            pool = rng.integers(0, 2**63, n + m - inner).astype(np.uint64)
            a, b = pool[:n], pool[n - inner :]
            row, key = jaccard.signatures(np.concatenate((a, b)), np.array([len(a), len(b)]))
            assert set(key[row == 0]) & set(key[row == 1])
            node, sketch = jaccard.nodes_of(np.concatenate((a, b)), np.array([len(a), len(b)]))
            assert sum(int(x).bit_count() for x in sketch[0] ^ sketch[1]) <= n + m - 2 * inner


def test_every_link_shares_a_cool_token():
    """The prefix argument: the first token in common is short in the smaller set and taken in the larger, whatever the heat."""
    rng = np.random.default_rng(6)
    for n in [*range(1, 60), 75, 300, 1000]:
        heat = rng.integers(0, 3, 1 << jaccard.HEAT).astype(np.uint8)
        for m in {n, int((4 * n) // 3), int(rng.integers(n, 4 * n // 3 + 1))}:
            inner = -(-3 * (n + m) // 7)
            if inner > n:
                continue
            pool = rng.integers(0, 2**63, n + m - inner).astype(np.uint64)
            a, b = pool[:n], pool[n - inner :]
            row, token, short = jaccard.prefixes(np.concatenate((a, b)), np.array([len(a), len(b)]), heat)
            assert set(token[(row == 0) & short]) & set(token[row == 1])
            assert n < m or set(token[(row == 1) & short]) & set(token[row == 0])


def test_shared_rows_stream():
    rng = np.random.default_rng(2)
    key, node = rng.integers(0, 40, 300), rng.integers(0, 4, 300)
    rank = jaccard.ranked(key.view(np.uint64), node.view(np.uint64)).view(np.int64)
    order = np.lexsort((rank, key))
    key, node, rank = key[order], node[order], rank[order]
    by, first = {}, {}
    for k, x in zip(key.tolist(), node.tolist(), strict=True):
        by.setdefault(k, set()).add(x)
        first.setdefault(k, x)
    for step in (1, 3, 300):
        batches = (pa.RecordBatch.from_arrays([pa.array(key[i : i + step]), pa.array(rank[i : i + step])], ["key", "rank"]) for i in range(0, 300, step))
        found = [tuple(r.values()) for b in jaccard._shared(batches) for r in b.to_pylist()]
        assert sorted(found) == sorted((k, x, first[k]) for k, v in by.items() if len(v) > 1 for x in v)


@pytest.mark.parametrize(("blocks", "step"), [(1, 7), (3, 50), (1, 500)])
def test_pairs_of_a_bucket_are_made_in_blocks(blocks, step):
    """A bucket gives a task the pairs of two blocks at most, of which only those within the bounds become rows, and each of them once."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 140).astype(np.uint64)
    held = [np.sort(np.append(pool[rng.random(140) < 0.9], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64))) for _ in range(120)]
    size = np.array([len(x) for x in held])
    node, sketch = jaccard.nodes_of(np.concatenate(held), size)
    root, short, block = rng.integers(0, 60, 120), rng.random(120) < 0.6, rng.integers(0, blocks, 120)
    rows = sorted((k, min(block[i], o), max(block[i], o), i) for k in (5, 9) for i in range(120) for o in range(blocks) if k == 5 or i % 3 == 0)
    key, lo, hi, i = (np.array(x) for x in zip(*rows, strict=True))
    names = ["key", "lo", "hi", "block", "root", "short", "node", "n", *(f"s{k}" for k in range(jaccard.SKETCH))]
    columns = [key, lo, hi, block[i], root[i], short[i], node[i].view(np.int64), size[i], *(sketch[i, k].view(np.int64) for k in range(jaccard.SKETCH))]
    table = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names)
    found = [tuple(r.values()) for b in jaccard._met(table.slice(a, step) for a in range(0, len(key), step)) for r in b.to_pylist()]
    near = lambda a, b: 4 * size[a] >= 3 * size[b] and 7 * sum(int(x).bit_count() for x in sketch[a] ^ sketch[b]) <= size[a] + size[b]
    signed = node.view(np.int64)
    expected = {tuple(sorted((signed[a].item(), signed[b].item()))): (a % 3 == 0) + (b % 3 == 0) for a in range(120) for b in range(120) if root[a] != root[b] and short[a] and size[a] <= size[b] and near(a, b)}
    expected = sorted(p for p, n in expected.items() for _ in range(2 if n == 2 else 1))
    everything = sum(root[a] != root[b] for a in range(120) for b in range(a))
    assert sorted(tuple(sorted(p)) for p in found) == expected
    assert 0 < len(set(found)) < everything


def test_only_wanted_texts_are_fetched(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k}") for k in range(300)] * 2 + [(None, "none"), (7, None)], "doc_id long, text string")
    wanted = docs.filter("doc_id = 3 OR doc_id IS NULL OR text IS NULL").select(jaccard.place("doc_id", "text").alias("place")).distinct()
    found = jaccard._texts(docs, wanted).select("text").collect()
    assert sorted(str(r.text) for r in found) == sorted(["None", "none", *(f"text {k}" for k in range(3, 300, 50))])


def test_frequent_tokens_are_told(spark):
    """What many texts share is hot before any bucket is made."""
    docs = spark.createDataFrame([(k, " ".join(["a b c d e f", *(f"w{k}x{i}" for i in range(20))])) for k in range(64)], "doc_id long, text string")
    heat = jaccard._heated(jaccard._frequent(docs), np.zeros(1 << jaccard.HEAT, np.uint8))
    tokens, _ = jaccard.shingles(pa.array(["a b c d e f"]))
    assert (heat[jaccard.heat_cell(tokens)] >= 5).all() and np.count_nonzero(heat) < 20


def test_shingles_are_those_of_the_words():
    texts = ["", None, "a", " a ", "A b", "b a", "a b c d e", "a  b\nc d e f\x0ba", "é É ß \x1c x y z", "a b c d", "a b c d e a b c d e", "x" * 5000 + " y z", "ab c d e f", "a bc d e f", "\t", "end"]
    array = pa.array(["skip", *texts, "skip"])[1:-1]
    tokens, size = jaccard.shingles(array)
    assert size.tolist() == [len(sets(t)) for t in texts]
    ends = np.cumsum(size)
    for t, a, b in zip(texts, ends - size, ends, strict=True):
        for other, c, d in zip(texts, ends - size, ends, strict=True):
            assert len(set(tokens[a:b]) & set(tokens[c:d])) == len(sets(t) & sets(other)), (t, other)
    assert len(jaccard.shingles(pa.array([], pa.string()))[0]) == 0


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long, 1), (2, long.upper(), 2), (9, long, 3), (9, long, 3), (1, "other words here", 4), (1, "other words here", 4), (None, long, 5), (3, None, 6), (4, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _twice int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r._twice) for r in kept.collect()) == [("1", 4), ("2", 2), ("3", 6), ("4", 7), ("None", 5)]
    assert jaccard.classes(docs.limit(0)).count() == 0


def links_by_null_ids():
    """A null-id near copy, a null-id bridge between texts that are not near each other, and ids that several texts share."""
    rng = random.Random(9)
    words = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    a, b, c, d = words(60), words(100), words(50), words(40)
    far = [*b[:12], *words(1), *b[13:86], *words(1), *b[87:]]
    left, right = [*far[:13], *b[13:]], [*b[:86], *far[86:]]
    left[30], right[60] = "left", "right"
    bridge = [*b]
    near = [*c[:-1], "end"]
    rows = [(None, [*a[:-1], "end"]), (20, a), (31, left), (32, right), (None, bridge), (50, near), (41, c), (50, d), (60, words(30)), (60, words(30)), (70, [*d[:-1], "end"])]
    return [(i, " ".join(w)) for i, w in rows]


def test_null_and_shared_ids(spark):
    rows = links_by_null_ids()
    without = [r for r in rows if r[0] is not None]
    bridged = lambda found: {x for i, _, x in found if i in ("31", "32")}
    assert bridged(brute(rows)) == {"31"} and bridged(brute(without)) == {"31", "32"}
    assert {x for i, _, x in brute(rows) if i == "None"} == {"20", "31"}
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute(rows)


def test_keep_one_judges_rows_by_their_text(spark):
    rows = links_by_null_ids()
    kept = jaccard.keep_one(spark.createDataFrame([*rows, rows[8]], "doc_id long, text string"))
    # Of id 50 the near copy of 41 goes and the other text stays, with 70 its near copy; both texts of 60 stay, once each.
    stay = [rows[i] for i in (0, 1, 2, 4, 6, 7, 8, 9)]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, stay))
