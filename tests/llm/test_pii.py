import random
import re
import time

from trovelight.llm import crf, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_base(text):
    """The base by the contract's words, with the patterns as they stand there."""
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        odd = digits[-1::-2]
        even = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
        if 12 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_against_the_patterns():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["a@b.c", "@", ".", "1", "23", "4111111111111111", " ", "+1 ", "(", ")", "-", "x", "é", "256.1.1.1", "10.0.0.1", "a.b", "\n"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_texts_stay_linear():
    text = "a" * 200_000 + " @ " + "1" * 50_000 + " a@b" + ".c" * 20_000
    assert [k for _, _, k in pii.base_spans(text)] == ["email"]


def test_held_out_accuracy():
    lines, tags = pii.labelled(300, seed=99)
    found = crf.decode([pii.features(x) for x in lines], pii.model(), pii.SLOTS)
    pairs = [(a, b) for x, y in zip(found, tags, strict=True) for a, b in zip(x, y, strict=True)]
    assert sum(a == b for a, b in pairs) >= 0.97 * len(pairs)


def test_added_spans():
    texts = ["call me at (212) 555-0153, please", "x +1 (314) 555-6532 4663622617512349 y", "no data here at all.\nThe dot and the line", "Chapter 12 of 1984, version 3.2"]
    found = pii.spans_of(texts, pii.model())
    assert [texts[0][a:b] for a, b, _ in found[0][1]] == ["(212) 555-0153"]
    assert [(texts[1][a:b], k) for a, b, k in found[1][0] + found[1][1]] == [("+1 (314) 555-6532", "phone"), ("4663622617512349", "card")]
    assert found[2] == found[3] == ([], [])


def test_frames(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "mail a.b@c.org now", "x", 1), (3, "mail a.b@c.org now", "x", 1), (None, "ip 10.1.2.3", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, added int")
    found = pii.find(docs).collect()
    assert [(r.doc_id, [tuple(s) for s in r.base]) for r in found] == [(1, []), (2, []), (3, [(5, 14, "email")]), (3, [(5, 14, "email")]), (None, [(3, 11, "ip")])]
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    assert [r.text for r in masked.collect()] == [None, "", "mail [EMAIL] now", "mail [EMAIL] now", "ip [IP]"]
    assert pii.find(docs.limit(0)).count() == pii.mask(docs.limit(0)).count() == 0


def test_digit_runs_stay_linear():
    """A megabyte of digits beside a dot, in several arrangements, within a time limit; and what the leftmost match is."""
    start = time.perf_counter()
    for text in ("1" * 1_000_000 + ".", "1" * 500_000 + "." + "2" * 500_000, ("1" * 1000 + ".") * 2 + "x" + "3" * 900_000 + ". "):
        assert [s for s in pii.base_spans(text) if s[2] == "ip"] == []
    assert time.perf_counter() - start < 20
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("0129.. x") for _ in range(rng.randint(0, 40)))
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_long_words_keep_their_end():
    assert pii.shape("a" * 50 + "1" * 60 + "-") == "aaa999-"
