import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trovelight.llm import packing

FILE = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
LIBRARY = Tokenizer.from_str(FILE.decode())
LIBRARY.encode_special_tokens = True
ENCODER = packing.Encoder(FILE)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    ids, size = ENCODER.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if texts else []


ODD = ["", " ", "\n\n", "a  b", "It's WE'LL 12ab", "x　y z\x85w\x1c\x1fv", "日本語 テキスト", "🙂🙂 x", "<|endoftext|> a<|startoftext|>", "ẖ H̱ İ Å ΣΑΣ Σ", "a\x01b \x01 c\x01", "\x01", "#" * 9000, "é" * 3000, "\r\n\t x", " ́x", "a. b.c, d., é, f.\ng.", "1, 2. '.s. it's. x", "a.́ b"]


def test_odd_texts():
    assert encoded(ODD) == [plain(t) for t in ODD]
    assert encoded([]) == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \nAI\x01́'.,")), max_size=40), max_size=5))
def test_any_text(texts):
    assert encoded(texts) == [plain(t) for t in texts]


def test_forgets_words(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 3)
    encoder = packing.Encoder(FILE)
    for text in ("one two three four five", "six seven one", "two nine"):
        assert encoder.encode(pa.array([text]))[0].tolist() == plain(text)


def check(pieces, documents, window):
    """Each id lies in one piece, windows are gapless from 0, and each is full or a power of two."""
    by_doc, by_window = {}, {}
    for name, start, ids, number, offset in pieces:
        by_doc.setdefault(name, []).append((start, ids))
        by_window.setdefault(number, []).append((offset, len(ids)))
    assert by_doc.keys() == documents.keys()
    for name, parts in by_doc.items():
        parts.sort()
        assert [s for s, _ in parts] == np.cumsum([0, *(len(x) for _, x in parts)])[:-1].tolist()
        assert np.concatenate([x for _, x in parts]).tolist() == list(documents[name])
    for parts in by_window.values():
        parts.sort()
        fill = sum(n for _, n in parts)
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and all(n for _, n in parts)
        assert fill == window or fill < window and fill & (fill - 1) == 0


@pytest.mark.parametrize(("window", "most", "high"), [(16, 4, 40), (64, 1, 30), (64, 500, 33), (4096, 30, 9000), (100, 3, 99)])
def test_packer(window, most, high):
    rng = random.Random(window + most)
    packer, documents = packing.Packer(window, most), {}
    for name in range(600):
        documents[name] = np.array([rng.randrange(50_000) for _ in range(rng.choice([1, high // 2 + 1, rng.randint(1, high)]))], np.uint32)
        packer.add(name, documents[name])
        assert packer.n_open <= most and packer.n_open == packer.level.sum() == sum(map(len, packer.open.values()))
    packer.finish()
    pieces, offset = [], 0
    for number, parts in packer.closed:
        offset = 0
        for name, start, ids in parts:
            pieces.append((name, start, ids, number, offset))
            offset += len(ids)
    check(pieces, documents, window)


def test_choice_is_the_least_sum_of_squares():
    rng = random.Random(4)
    for _ in range(300):
        packer = packing.Packer(20, 10**6)
        packer.level[1:20] = [rng.choice([0, 0, 1, 2, 5]) for _ in range(19)]
        s = rng.randint(1, 19)
        h = packer.choose(s)

        def total(h):
            n = packer.level.copy()
            if h:
                n[h] -= 1
            if h + s < 20:
                n[h + s] += 1
            return int((n**2).sum())

        choices = [0, *(x for x in range(1, 21 - s) if packer.level[x])]
        assert total(h) == min(map(total, choices))
        assert h == max(x for x in choices if total(x) == total(h))


def test_frames(spark):
    rng = random.Random(8)
    words = ["apple", "Bär", "running", "x1", "don't", "日本"]
    rows = [(1, None, "k"), (2, "", "k"), (3, " \n", None), (4, "word " * 20_000, "k"), (5, "<|endoftext|>", "k")]
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 900))), "k") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    found = packing.pack(docs, FILE, with_ids=True).collect()
    check([(r.doc_id, r.start, r.ids, r.sequence_id, r.offset) for r in found], {i: [*plain(t), packing.END] for i, t, _ in rows}, packing.WINDOW)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in found)
    assert {r.doc_id: r.doc_tokens for r in found} == {i: len(plain(t)) + 1 for i, t, _ in rows}
    assert len({r.sequence_id >> 40 for r in found}) == 3
    assert packing.pack(docs.limit(0), FILE).count() == 0
    twice = spark.createDataFrame([(None, "a b", "z")] * 3, "doc_id long, text string, ids string").coalesce(1)
    packed = packing.pack(twice, FILE).collect()
    assert sum(r.length for r in packed) == 9 and {r.doc_tokens for r in packed} == {3}
    assert sorted(r.length + r.offset for r in packed if r.length + r.offset not in {x.offset for x in packed if x.sequence_id == r.sequence_id}) == [1, 8]
