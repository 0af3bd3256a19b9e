import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trovelight.llm import bpe

FILE = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.splitlines())}
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(FILE, public_tokenizers.PATTERN)

ODD = ["", " ", "  ", "\n \n", "a  b", " a", "a ", "x\n\n y", "it's we'll 12 ab12", "  x　y  z", "日本語 テキスト", "🙂🙂 x", "\x1c a\x1f b\x85c", "<|endoftext|> a"]
ODD += ["ab" * 3000, "#" * 5000, " " * 3000 + "x", "ß" * 700 + " é", "\r\n\t x", "é नमस्ते"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    ids = CODEC.encode([text])[0]
    assert ids == PLAIN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60), max_size=5))
def test_any_text(texts):
    for text, ids in zip(texts, CODEC.encode(texts), strict=True):
        assert CODEC.decode(ids) == text.encode()
        if all(c < "　" for c in text):  # beyond, Unicode versions of the two pattern engines may differ
            assert ids == PLAIN.encode_ordinary(text)


def test_side_by_side_equals_alone():
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"abcthe \xc3\xa9") for _ in range(rng.randint(1, 64))) for _ in range(500)]
    assert bpe.merge_batch(pieces, CODEC.vocabulary) == [bpe.merge_one(p, CODEC.vocabulary) for p in pieces]


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the thing", "y"), (3, "the thing", "y"), (None, "a  b " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.round_trip(docs, FILE, public_tokenizers.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [PLAIN.encode_ordinary(t or "") for _, t, _ in rows]
    assert [tuple(r) for r in found] == [
        (i, len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for (i, t, _), x in zip(rows, ids, strict=True)
    ]
    back = bpe.decode(bpe.encode(docs, FILE, public_tokenizers.PATTERN), FILE).collect()
    assert [r.text for r in back] == [t or "" for _, t, _ in rows]
    assert bpe.round_trip(docs.limit(0), FILE, public_tokenizers.PATTERN).count() == 0
