"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A rank file orders the merges. Each piece of a text starts as its bytes; the
tree's leaf i holds the rank of the pair that token i forms with the next live
token, and every inner node the least rank below it, so the root leads to the
leftmost least pair. A merge puts the new token at the left position, kills the
right one and updates at most three leaves, each along one path to the root.
Many short pieces are merged side by side in NumPy, one merge of each per step;
long ones take the same steps alone, in O(n log n).

Defined cases: a null text is empty and has no tokens; any text, however long,
decodes to its own UTF-8 bytes. Repeated rows come back as often as they stand,
empty input gives empty output, and other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import bounded_chunks, col

NEVER = np.iinfo(np.int32).max
#: Longest piece that is merged side by side with others, and most leaves of such a batch.
SHORT, LEAVES = 64, 1 << 18
#: Chunks of text whose tokens a task remembers; beyond it the memory is emptied, which costs time only.
MEMORY = 400_000
#: A blank before a character that is no white space always starts a new match of the pattern.
ODD_BLANK = regex.compile(r" (?:\s|$)")
SINGLE_BLANK = regex.compile(r" (?=\S)")


class Vocabulary:
    """Ranks and the pairs they merge, from the bytes of a rank file."""

    def __init__(self, file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(self.size)]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {ranks[t[:i]] * self.size + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.pairs = pairs

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NEVER for pairs without one or without a partner (below zero)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NEVER).astype(np.int32)


def merge_batch(pieces: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Tokens of pieces of at most SHORT bytes, all trees held in one array."""
    n, width = len(pieces), 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    sizes = np.array([len(p) for p in pieces])
    token = np.where(np.arange(width) < sizes[:, None], vocabulary.byte[raw], -1)
    tree = np.full((n, 2 * width), NEVER, np.int32)
    tree[:, width : 2 * width - 1] = vocabulary.pair_ranks(token[:, :-1], token[:, 1:])
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    # From here on one flat index serves all trees: piece r has nodes from 2 r width, positions from r width.
    # A position past the end of a piece is a token of -1, which pairs with nothing; one spare cell ends the last piece.
    tree, flat = tree.ravel(), np.append(token.ravel(), -1)
    after = np.arange(1, n * width + 1)
    before = np.arange(-1, n * width - 1)
    first = np.arange(n) * width
    top = 2 * first + 1
    going = np.flatnonzero(tree[top] < NEVER)
    first, top = first[going], top[going]
    while first.size:
        least, node = tree[top], np.ones(first.size, np.int64)
        for _ in range(width.bit_length() - 1):
            node *= 2
            node += tree[2 * first + node] > least
        left = first + node - width
        right = after[left]
        beyond = after[right]
        flat[left], flat[right] = least, -1
        after[left], before[beyond[beyond < n * width]] = beyond, left[beyond < n * width]
        outside = beyond >= first + width
        earlier = before[left]
        none = earlier < first
        # The pair at `left` is new, the one at `right` is gone, and the one that ended at `left` has another partner.
        ranks = vocabulary.pair_ranks(
            np.concatenate((flat[left], np.where(none, -1, flat[earlier]))), np.concatenate((np.where(outside, -1, flat[beyond]), flat[left]))
        )
        leaf = np.concatenate((left, right, np.where(none, left, earlier)))
        base = np.concatenate((first, first, first))
        node = leaf + width + base
        tree[node[first.size : 2 * first.size]] = NEVER
        tree[node[: first.size]] = ranks[: first.size]
        has = ~none
        tree[node[2 * first.size :][has]] = ranks[first.size :][has]
        base *= 2
        node -= base
        for _ in range(width.bit_length() - 1):
            node >>= 1
            child = 2 * node + base
            tree[base + node] = np.minimum(tree[child], tree[child + 1])
        going = tree[top] < NEVER
        first, top = first[going], top[going]
    token = flat[:-1].reshape(n, width)
    whole, ends = token[token >= 0].tolist(), np.cumsum((token >= 0).sum(1)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge_one(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Tokens of one piece of any length."""
    n, pairs, size = len(piece), vocabulary.pairs, vocabulary.size
    width = 1 << max(1, (n - 1).bit_length())
    token = vocabulary.byte[np.frombuffer(piece, np.uint8)]
    tree = np.full(2 * width, NEVER, np.int32)
    tree[width : width + n - 1] = vocabulary.pair_ranks(token[:-1], token[1:])
    level = width
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2
    tree, token = tree.tolist(), token.tolist()
    before, after, never = list(range(-1, n - 1)), list(range(1, n + 1)), int(NEVER)

    def update(leaf: int, rank: int) -> None:
        node = leaf + width
        tree[node] = rank
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a <= b else b
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] < never:
        least, node = tree[1], 1
        while node < width:
            node *= 2
            if tree[node] > least:
                node += 1
        left = node - width
        right = after[left]
        beyond = after[right]
        token[left], token[right], after[left] = least, -1, beyond
        if beyond < n:
            before[beyond] = left
        update(right, never)
        update(left, pairs.get(least * size + token[beyond], never) if beyond < n else never)
        if before[left] >= 0:
            update(before[left], pairs.get(token[before[left]] * size + least, never))
    return [t for t in token if t >= 0]


class Codec:
    """Encodes and decodes texts; remembers the tokens of the chunks it has met."""

    def __init__(self, file: bytes, pattern: str):
        self.vocabulary, self.pattern = Vocabulary(file), regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.inner: dict[str, list[int]] = {}

    def _merge(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        ranks, found, short = self.vocabulary.ranks, {}, []
        for piece in pieces:
            if piece in ranks:  # a piece that is a token is that token
                found[piece] = [ranks[piece]]
            elif len(piece) > SHORT:
                found[piece] = merge_one(piece, self.vocabulary)
            else:
                short.append(piece)
        short.sort(key=len)
        for a, b in bounded_chunks(map(len, short), LEAVES):
            found.update(zip(short[a:b], merge_batch(short[a:b], self.vocabulary), strict=True))
        return found

    def _learn(self, chunks: set[str], known: dict[str, list[int]], prefix: str) -> None:
        new = list(chunks.difference(known))
        split = [[p.encode() for p in self.pattern.findall(prefix + c)] for c in new]
        merged = self._merge(list(set(chain.from_iterable(split))))
        for c, parts in zip(new, split, strict=True):
            known[c] = merged[parts[0]] if len(parts) == 1 else list(chain.from_iterable(map(merged.__getitem__, parts)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text, by the chunks between its single blanks.

        `known` holds chunks that start a text, `inner` those behind a blank,
        which is a part of them but not of their key.
        """
        for memory in (self.known, self.inner):
            if len(memory) > MEMORY:
                memory.clear()
        heads, rests = [], []
        for text in texts:
            if ODD_BLANK.search(text):
                # Cut only where a blank precedes a visible character; longer runs of white space stay whole.
                parts = SINGLE_BLANK.split(text)
            else:
                parts = text.split(" ")
            heads.append(parts.pop(0))
            rests.append(parts)
        self._learn(set(heads), self.known, "")
        self._learn(set().union(*rests), self.inner, " ")
        head, inner = self.known.__getitem__, self.inner.__getitem__
        return [list(chain(head(a), chain.from_iterable(map(inner, b)))) for a, b in zip(heads, rests, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return [x or "" for x in batch.column(at).to_pylist()]


def _groups(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some megabytes at most, or one longer text."""
    start = total = 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > most:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, file: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and n_tokens of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(file)  # the rank file: under a megabyte, whatever the corpus
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for batch in batches:
            texts = _texts(batch, 1)
            for a, b in _groups(texts, 1 << 22):
                ids = codec.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())], ["doc_id", "ids", "n_tokens"]
                )

    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long")


def round_trip(docs: DataFrame, file: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to; the ids themselves on request."""
    shared = docs.sparkSession.sparkContext.broadcast(file)
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        decimal = codec.vocabulary.decimal
        for batch in batches:
            texts = _texts(batch, 1)
            for a, b in _groups(texts, 1 << 22):
                ids = codec.encode(texts[a:b])
                columns = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_tokens": pa.array(map(len, ids), pa.int64()),
                    "ids_sha256": pa.array([sha(",".join(map(decimal.__getitem__, x)).encode()) for x in ids], pa.string()),
                    "decoded_sha256": pa.array([sha(codec.decode(x)) for x in ids], pa.string()),
                }
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, file: bytes, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of encoded rows; bytes that are no UTF-8 become replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(file)
    slim = encoded.select(col(encoded, doc_id).alias("doc_id"), F.coalesce(col(encoded, ids), F.array().cast("array<int>")).alias("ids"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(shared.value).tokens
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, x)).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return slim.mapInArrow(run, f"doc_id {kind}, text string")
