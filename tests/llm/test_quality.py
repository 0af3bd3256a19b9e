from collections import Counter

import pytest

from trovelight.llm import quality


def figures(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    held = Counter(grams)
    covered = {p for i, g in enumerate(grams) if held[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


GOOD = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", " \n\t", "a b c a b c", "a a a a a", "x\n\nx\nx y\n", "é # ümlaut 🙂 $$ <b>|&%*", GOOD, GOOD + "\n" + GOOD, "\x1cword\x1f \xa0nbsp", "a b c d a b c e b c d"]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, source string, _m string")


def test_figures(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, GOOD, None), (7, GOOD, "s")]
    found = sorted(quality.judge(docs(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    assert [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found] == [(i, *figures(t)) for i, t, _ in rows]
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)


def test_hosts(spark):
    """A host that mostly fails goes whole; one with a single failure among hosts like the rest stays."""
    rows = [(i, "short", "bad") for i in range(40)] + [(100, GOOD, "bad"), (101, "short", "small")]
    rows += [(200 + i, GOOD if i % 10 else "short", f"host{i % 7}") for i in range(140)] + [(400, GOOD, None)]
    kept = {r.doc_id: (r.kept, r.host_bad) for r in quality.judge(docs(spark, rows)).collect()}
    assert kept[100] == (False, True) and kept[101] == (False, False) and kept[400] == (True, False)
    assert all(kept[200 + i] == (i % 10 != 0, False) for i in range(140))
    left = quality.keep_good(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "source", "_m"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (k, _) in kept.items() if k)


def test_rates(spark):
    """The shrunk rate by hand: hosts of 2 of 4 and 0 of 8 short documents."""
    rows = [(i, "short" if i < 2 else GOOD, "a") for i in range(4)] + [(10 + i, GOOD, "b") for i in range(8)]
    measured = quality.measure(docs(spark, rows))
    found = {r.host: r.short for r in quality.host_verdicts(measured, "source", measured.columns[-1]).collect()}
    weight = max(0.25 * 0.75 / 0.0625 - 1, quality.LEAST_WEIGHT)
    assert found == {"a": pytest.approx((2 + 0.25 * weight) / (4 + weight)), "b": pytest.approx(0.25 * weight / (8 + weight))}


def test_long_texts_and_shared_hosts(spark):
    """A text of a million words, and a bad host whose documents are copies of one text, over several partitions."""
    long = " ".join(f"w{i % 700_000}" for i in range(1_000_000))
    rows = [(1, long, "fine"), (2, long.replace("w", "#"), "fine")] + [(10 + i, "copy", "bad") for i in range(90)] + [(200 + i, GOOD, f"h{i % 9}") for i in range(90)]
    found = {r.doc_id: r for r in quality.judge(docs(spark, rows).repartition(7)).collect()}
    for i, t, _ in rows[:2]:
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(t)
    assert [found[10 + i].host_bad for i in range(90)] == [True] * 90
    assert not any(found[200 + i].host_bad for i in range(90))


def test_a_bad_host_decides_over_a_whole_table(spark, folder):
    """The given documents, and as many again of a host that mostly fails: its passing ones go, all others are judged as before."""
    given = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r.kept for r in quality.judge(given).collect()}
    rows = [(10_000 + i, GOOD if i % 4 == 0 else "too short", "mostly.bad") for i in range(200)]
    added = spark.createDataFrame(rows, "doc_id long, text string, source string")
    after = {r.doc_id: (r.kept, r.base_failed, r.host_bad) for r in quality.judge(given.select("doc_id", "text", "source").unionByName(added)).collect()}
    assert {i: after[i][0] for i in before} == before and any(before.values())
    assert all(after[i] == (False, i % 4 != 0, True) for i, _, _ in rows)


def test_empty(spark):
    none = docs(spark, [(1, "x", "s")]).limit(0)
    assert quality.judge(none).count() == quality.keep_good(none).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality.judge(docs(spark, [(1, "x", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
