"""N-gram Jaccard join by parity sketches.

A document's set is that of its distinct five-word shingles, as 64-bit hashes. A
token flips one cell of a parity sketch, so two sketches differ in at most as many
cells as the sets have tokens that only one of them holds, and for a similarity of
t that is at most D = (1 - t) / (1 + t) of the sum of the sizes.

* Candidates. A set's tokens are put in one order for all sets, those of few sets first, by a table of fixed
  size of how often tokens occur (its cells are shared by tokens; it changes speed alone). Two sets above the threshold share
  a token among the first seventh of the smaller one and the first quarter of the larger one. Tokens that are
  many sets' own, as those of a common passage, come last and are mostly not looked at.
* Filter. A sketch of 2,048 bits per set, after a fold of it to 512, bounds the difference from below by its Hamming distance.
  Larger sets fill that, so they have a further sketch of at least as many bits as tokens.
* Verification. Sizes of intersections of the full sets.

Sets, not documents, are joined: copies share one node. In each bucket, the sets that hold a token in their first quarter, the members
are first held against one head, by one of 32 orders that the bucket's key chooses. Near
copies share many buckets and so meet many heads, which links groups of thousands without
their pairs. What then counts are open buckets, whose members lie in different components:

* with at most `FEW` pairs a member across components, a task goes through these pairs and returns those within the bounds
  of the sketches. A bucket of many members is dealt out as pairs of blocks of some `BLOCK` members, so no task holds more than two blocks.
* the others are crowded. A pair whose common buckets are all crowded has both ends among their members, so these
  alone are signed again, at most twice, while crowded buckets stand for more than `LEFT` pairs a member: by tokens once more, with the table
  raised by the members that the buckets really have; then by buckets of the parity of several tokens, for texts that hold no rare token
  but rare combinations. What is crowded then, or was before if that was less, has all its pairs gone through, in blocks.

Components are found by contracting edges towards the
smaller of two random node numbers, a logarithmic number of rounds.

Defined cases: a document without words (or with a null text) has an empty set and
links with nothing. With fewer words than a shingle, the whole sequence is the one
shingle. Repeated rows are copies of each other. Rows are told apart by id and text, so
rows with a null id link as any others do, and rows that share an id may lie in different
components. Null ids never become a component's name unless it has no other. Empty input gives empty output. Other columns are kept
by `keep_one` and dropped by `classes`. Hash collisions of 64 bits are taken as impossible.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import col, free_name
from trovelight.session import cut_lineage, spent_shuffles_dropped

WORDS = 5
#: The threshold as a fraction: intersection * UNDER >= OVER * union.
OVER, UNDER = 3, 4
#: Longs of a set's sketch, and of its fold, the sketch of as many cells that it contains.
SKETCH, FOLD = 32, 8
#: The 32 orders of buckets, and how many of them are taken at a time.
ORDERS = (0, 4, 32)
#: Pairs across components that a member of a bucket may stand for, on average, before the bucket counts as crowded.
FEW = 64
#: Pairs of all crowded buckets, for each row of members, up to which they are gone through and nothing is signed again.
LEFT = 128
#: Members of a block of a bucket, about, and pairs that a task looks at together.
BLOCK, PAIRS = 1024, 1 << 16
#: log2 of the cells of the table of frequent tokens; it is sent to all tasks, a byte a cell.
HEAT = 22
#: log2 of the bits of the table of wanted texts, which is sent to all tasks; of the first three bytes of a digest.
WANTED = 24
#: Sets that a task remembers as sent.
MEMORY = 250_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of UTF-8 with A-Z lowered, and which of them part words.
LOWERED = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
BLANKS = np.isin(np.arange(256), [32, *range(9, 14)])
BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2^64
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
PLACE = mix(np.arange(1, 64, dtype=np.uint64) * GOLD + np.uint64(7)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts one after the other, and how many each text has.

    A word's hash is a difference of prefix sums over the bytes of all texts, so no
    step runs word by word.
    """
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~BLANKS[raw]
    before = np.append(False, inside[:-1])
    edges = ends[:-1][ends[:-1] < len(raw)]
    before[edges] = False  # a text's first byte starts a word
    start = np.flatnonzero(inside & ~before)
    after = np.append(inside[1:], False)
    after[edges[edges > 0] - 1] = False
    stop = np.flatnonzero(inside & ~after) + 1
    total = np.concatenate(([np.uint64(0)], np.cumsum(BYTE[LOWERED[raw]] * _powers(BASE, len(raw)), dtype=np.uint64)))
    word = mix((total[stop] - total[start]) * _powers(pow(BASE, -1, 2**64), len(raw))[start] + (stop - start).astype(np.uint64) * GOLD)
    doc = np.searchsorted(ends, start, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    runs = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        runs += word[k : k + len(runs)] * PLACE[k]
    runs = mix(runs)
    out = []
    for a, n in zip(first.tolist(), count.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(runs[a : a + n - words + 1]))
        else:  # the whole sequence; its length keeps it apart from longer ones
            short = (word[a : a + n] * PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + PLACE[words + n]
            out.append(mix(short) if n else runs[:0])
    return (np.concatenate(out) if out else runs[:0]), np.array([len(x) for x in out], np.int64)


def nodes_of(tokens: np.ndarray, size: np.ndarray, sketch: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A number for each set, and its parity sketch if wanted; empty sets have number 0."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(tokens + GOLD), dtype=np.uint64)))
    ends = np.cumsum(size)
    node = mix((total[ends] - total[ends - size]) * GOLD + size.astype(np.uint64))
    node = np.where(size > 0, node, np.uint64(0))
    if not sketch:
        return node, np.zeros((len(size), 0), np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    cells = 64 * SKETCH
    # Cell c is bit c of the sketch; long i of a fold is the XOR of longs i, i + FOLD and so on: again a parity of cells.
    cell = (mix(tokens ^ GOLD) >> np.uint64(64 - (cells - 1).bit_length())).astype(np.int64)
    parity = np.empty((len(size), cells), np.uint8)
    for a in range(0, len(size), 256):  # counts of some rows at a time
        part = slice((ends - size)[a], ends[a : a + 256][-1])
        rows = len(size[a : a + 256])
        parity[a : a + rows] = (np.bincount((row[part] - a) * cells + cell[part], minlength=rows * cells) & 1).reshape(rows, cells)
    return node, np.packbits(parity, axis=1).view(np.uint64)


def wide_sketch(tokens: np.ndarray) -> np.ndarray:
    """A parity sketch of at least as many cells as tokens, a power of two; empty where the common sketch is that wide."""
    if len(tokens) <= 64 * SKETCH:
        return np.zeros(0, np.uint64)
    cells = 1 << (len(tokens) - 1).bit_length()
    parity = np.bincount((mix(tokens ^ GOLD) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def apart(n: np.ndarray) -> np.ndarray:
    """The most tokens by which a set of n tokens and any partner can differ."""
    return (UNDER - OVER) * (n + UNDER * n // OVER) // (UNDER + OVER)


def band(n: np.ndarray) -> np.ndarray:
    """log2 of the number of buckets for sets of n tokens: at least 0.45 n + 3."""
    return np.ceil(np.log2(0.45 * n + 3)).astype(np.int64)


def heat_cell(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens ^ BYTE[3]) >> np.uint64(64 - HEAT)).astype(np.int64)


def prefixes(tokens: np.ndarray, size: np.ndarray, heat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, short) of each set's coolest tokens: those that it shares with any partner, and which of them with a larger one."""
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((tokens, heat[heat_cell(tokens)], row))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    n = size[row]
    # A partner shares 3/4 of this set at least, a larger partner 6/7.
    take = rank <= n - -(-OVER * n // UNDER)
    short = rank <= n - -(-2 * OVER * n // (OVER + UNDER))
    return row[take], tokens[order][take], short[take]


def signatures(tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the buckets by which each set is found: those whose tokens have one parity.

    Tokens fall into 2^j buckets, each holding the XOR of its tokens. j depends on the size band; a set
    also takes part in the band of the largest partner it may have. Two sets above the threshold differ in D tokens
    at most, so they agree on all but D buckets and share one among the first D + 1 of each, in any order both follow: fullest
    first, as those say most. A set with too few filled buckets for the argument joins the next band too; a
    pair is safe as soon as one of the two has enough.
    """
    own, top = band(size), band(UNDER * size // OVER)
    rows, keys = [], []
    start = np.cumsum(size) - size

    def emit(which: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Emit the first buckets of the rows `which`; return which of them were too few to be sure."""
        n = size[which]
        row = np.repeat(np.arange(len(which)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[which], n)
        own_tokens, bits = tokens[at], np.repeat(level, n)
        bucket = mix(own_tokens * GOLD + np.uint64(1)) >> (64 - bits).astype(np.uint64)
        order = np.lexsort((bucket, row)) if bits.max() > 30 else np.argsort((row.astype(np.uint64) << np.uint64(32)) | bucket, kind="stable")
        row, bucket, own_tokens = row[order], bucket[order], own_tokens[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])))
        held = np.diff(np.append(first, len(row)))
        parity = np.bitwise_xor.reduceat(own_tokens, first)
        row, bucket = row[first], bucket[first]
        key = mix(mix(parity) + mix(bucket * np.uint64(64) + level[row].astype(np.uint64)))
        order = np.lexsort((key, -held, row))
        row, key = row[order], key[order]
        filled = np.bincount(row, minlength=len(which))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(filled) - filled, filled)
        most = apart(n)
        take = rank <= most[row]
        rows.append(which[row[take]])
        keys.append(key[take])
        return filled <= most

    for level, which in ((own, np.flatnonzero(size)), (top, np.flatnonzero((size > 0) & (top > own)))):
        lv = level[which]
        while len(which):
            few = emit(which, lv)
            which, lv = which[few], lv[few] + 1
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, int), np.zeros(0, np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _slices(batch: pa.RecordBatch, at: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a megabyte of text at most, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def place(doc_id: str | Column, text: str | Column) -> Column:
    """What tells rows apart: 128 bits of a digest of id and text, null ids included."""
    doc_id, text = (F.col(x) if isinstance(x, str) else x for x in (doc_id, text))
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("id "), doc_id.cast("string")), F.lit("none")), F.lit("\n"), F.coalesce(text, F.lit("")))))


def described(docs: DataFrame) -> DataFrame:
    """Of `docs` (doc_id, text): doc_id, place, node, n, s0..s31 (the sketch), wide (that of a large set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                tokens, size = shingles(part.column(2))
                node, sketch = nodes_of(tokens, size)
                ends = np.cumsum(size)
                wide = [wide_sketch(tokens[b - k : b]) for b, k in zip(ends.tolist(), size.tolist(), strict=True)]
                places = np.concatenate(([0], np.cumsum([len(x) for x in wide]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), _signed(node), pa.array(size, pa.int32()), *(_signed(sketch[:, i]) for i in range(SKETCH)), pa.ListArray.from_arrays(places, _signed(np.concatenate(wide)))],
                    ["doc_id", "place", "node", "n", *names, "wide"],
                )

    return docs.select("doc_id", place("doc_id", "text").alias("place"), "text").mapInArrow(run, f"doc_id {kind}, place binary, node long, n int, {', '.join(f'{s} long' for s in names)}, wide array<long>")


def ranked(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A node's place in its bucket's order: one of 32 orders, by the key, so that buckets have different heads. Its own inverse."""
    return node ^ mix(key & np.uint64(31))


def _new(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which nodes a task has not had: copies are the same set. Forgetting some costs time only."""
    if len(seen) > MEMORY:
        seen.clear()
    new = np.zeros(len(node), bool)
    new[np.unique(node, return_index=True)[1]] = True
    new &= [x not in seen for x in node.tolist()]
    seen.update(node[new].tolist())
    return new


def _frequent(docs: DataFrame) -> DataFrame:
    """cell, log: cells of the table that tokens fall into more often than by chance, and log2 of how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        count = np.zeros(1 << HEAT, np.uint32)
        for batch in batches:
            for part in _slices(batch, 0):
                tokens, size = shingles(part.column(0))
                node, _ = nodes_of(tokens, size, sketch=False)
                np.add.at(count, heat_cell(tokens[np.repeat(_new(node, seen), size)]), np.uint32(1))
        # What chance puts together is left out, or nearly every cell of every task would be sent.
        at = np.flatnonzero(count >= 2 + int(3 * (count.sum() / len(count))))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at].astype(np.int64))], ["cell", "n"])

    return docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.log2(F.sum("n")).cast("short").alias("log"))


def _keyed(docs: DataFrame, heat: np.ndarray) -> DataFrame:
    """key, rank, short: the coolest tokens of every document's set, with the node in its rank's dress."""
    table = docs.sparkSession.sparkContext.broadcast(heat)  # a byte a cell, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _slices(batch, 0):
                tokens, size = shingles(part.column(0))
                node, _ = nodes_of(tokens, size, sketch=False)
                new = _new(node, seen)
                row, key, short = prefixes(tokens[np.repeat(new, size)], size[new], table.value)
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(ranked(key, node[new][row])), pa.array(short)], ["key", "rank", "short"])

    return docs.select("text").mapInArrow(run, "key long, rank long, short boolean")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and rank, those whose key has several nodes, with the first of these as head and what else they have.

    One row is held back between batches, so a key of any size streams through.
    """
    held = None
    head = more = None  # of the key held back: its first node, and whether it has had another

    def part(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        nonlocal held, head, more
        key, node = (rows.column(i).to_numpy() for i in (0, 1))
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        key, node = key[new], node[new]
        begins = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(begins)
        heads, run = node[first].copy(), np.cumsum(begins) - 1
        several = np.diff(np.append(first, len(key))) > 1
        if head is not None:  # the row held back continues the run that began before
            heads[0], several[0] = head, several[0] or more
        stop = len(key) if last else len(key) - 1
        emit = several[run][:stop]
        if not last:
            head, more, held = heads[-1], bool(several[-1]), rows.slice(int(new[-1]), 1)
            # The last row waits: whether its key has another node may show in the next batch.
        rest = [x.take(pa.array(new[:stop][emit])) for x in rows.columns[2:]]
        key, found = key[:stop][emit].view(np.uint64), (x[:stop][emit].view(np.uint64) for x in (node, heads[run]))
        return pa.RecordBatch.from_arrays([_signed(key), *(_signed(ranked(key, x)) for x in found), *rest], ["key", "node", "head", *rows.schema.names[2:]])

    for batch in batches:
        if batch.num_rows:
            yield part(batch if held is None else pa.concat_batches([held, batch]), False)
    if held is not None:
        yield part(held, True)


def shared_buckets(keyed: DataFrame) -> DataFrame:
    """key, node, head, short of the buckets that more than one set falls into."""
    met = keyed.repartition("key").sortWithinPartitions("key", "rank")
    return met.mapInArrow(_shared, "key long, node long, head long, short boolean")


def _near(a: str, b: str, longs: int) -> Column:
    """Size and Hamming bounds of two sets with columns prefixed a and b."""
    n = F.col(f"{a}n") + F.col(f"{b}n")
    far = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(longs)), F.lit(0))
    return (UNDER * F.least(f"{a}n", f"{b}n") >= OVER * F.greatest(f"{a}n", f"{b}n")) & ((UNDER + OVER) * far <= (UNDER - OVER) * n)


def _as(nodes: DataFrame, p: str, longs: int) -> DataFrame:
    """The nodes with columns prefixed p; of the sketch, its fold to so many longs."""
    folds = [reduce(Column.bitwiseXOR, (F.col(f"s{k}") for k in range(i, SKETCH, longs))).alias(f"{p}s{i}") for i in range(longs)]
    return nodes.select(F.col("node").alias(p), F.col("n").alias(f"{p}n"), *folds)


def _close(pairs: DataFrame, nodes: DataFrame, longs: int) -> DataFrame:
    """The pairs (a, b, and what else they have) within the bounds."""
    return pairs.join(_as(nodes, "a", longs), "a").join(_as(nodes, "b", longs), "b").filter(_near("a", "b", longs)).select(pairs.columns)


def _wide_close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs but for those of two large sets whose wide sketches, the longer folded to the shorter, lie too far apart."""
    large = nodes.filter(F.size("wide") > 0)
    for p in "ab":
        pairs = pairs.join(large.select(F.col("node").alias(p), F.col("n").alias(f"{p}n"), F.col("wide").alias(f"{p}w")), p, "left")
    longs = F.least(F.size("aw"), F.size("bw"))

    def folded(w: str) -> Column:
        # Sizes within the bounds differ by less than two, so one fold is enough.
        half = F.zip_with(F.slice(w, 1, longs), F.slice(w, longs + 1, longs), Column.bitwiseXOR)
        return F.when(F.size(w) > longs, half).otherwise(F.col(w))

    bits = F.zip_with(folded("aw"), folded("bw"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    far = F.aggregate(bits, F.lit(0), lambda s, x: s + x)
    both = F.col("aw").isNotNull() & F.col("bw").isNotNull()
    near = F.when(both, (UNDER + OVER) * far <= (UNDER - OVER) * (F.col("an") + F.col("bn"))).otherwise(True)
    return pairs.filter(near).drop("an", "aw", "bn", "bw")


def _maybe(wanted: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """Tells of places whether they may be among the wanted ones: never no for one that is."""
    cell = F.conv(F.hex(F.substring("place", 1, 3)), 16, 10).cast("int").alias("cell")
    bits = np.zeros(1 << WANTED, bool)
    bits[wanted.select(cell).distinct().toArrow()["cell"].to_numpy()] = True
    table = wanted.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def told(places: pa.Array) -> np.ndarray:
        digest = np.frombuffer(b"".join(places.to_pylist()), np.uint8).reshape(-1, 16).astype(np.int64)
        at = digest[:, 0] << 16 | digest[:, 1] << 8 | digest[:, 2]
        return (table.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    return told


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """place, text and what else `wanted` has, of the rows of `docs` whose place is wanted, each place once.

    A table of bits keeps nearly all other texts from being moved; the join is exact.
    """
    told = _maybe(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(told(batch.column(0))))

    likely = docs.select(place("doc_id", "text").alias("place"), "text").mapInArrow(run, "place binary, text string")
    return likely.join(wanted, "place").dropDuplicates(["place"])


def _sets(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, t: the sets of the nodes in pairs, made anew from the documents that stand for them, and stored."""
    both = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(both.join(nodes.select("node", "place"), "node").select("place"))
    # A place has one text, so one node.
    return cut_lineage(_with_sets(_texts(docs, wanted)))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.withColumn("i", shared).filter(UNDER * F.col("i") >= OVER * (F.size("ta") + F.size("tb") - F.col("i"))).select("a", "b")


def _with_sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0):
                tokens, size = shingles(part.column(0))
                node, _ = nodes_of(tokens, size)
                yield pa.RecordBatch.from_arrays([_signed(node), pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), _signed(tokens))], ["node", "t"])

    return texts.select("text").mapInArrow(run, "node long, t array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of `edges` (a, b), by contraction towards smaller numbers, which are random here."""
    edges, maps = cut_lineage(edges.filter("a <> b")), []
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut_lineage(ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"))
        maps.append(up)
        moved = edges.join(up.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = cut_lineage(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0]
    for up in maps[1:]:
        step = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
        found = found.join(step, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    return cut_lineage(found)


def _of(roots: DataFrame, x: str) -> DataFrame:
    return roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))


def _token_cells(counts: DataFrame) -> DataFrame:
    """cell, log of tokens with more than a few members, whether these lie in different components or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = heat_cell(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(1)], ["cell", "log"])

    return counts.filter(F.col("n") > FEW).select("key", F.log2("n").cast("short").alias("log")).mapInArrow(run, "cell int, log short")


def _heated(cells: DataFrame, heat: np.ndarray) -> np.ndarray:
    """The table with these cells as hot as they say at least."""
    found = cells.groupBy("cell").agg(F.max("log").alias("log")).toArrow()  # a row a cell at most
    at, log = found["cell"].to_numpy(), found["log"].to_numpy().astype(np.uint8)
    out = heat.copy()
    out[at] = np.maximum(out[at], log)
    return out


def _signed_again(texts: DataFrame, heat: np.ndarray | None) -> DataFrame:
    """key, node, root, short, stored: the coolest tokens of the set of every row of `texts` (text, node, root); without heat its buckets."""
    table = texts.sparkSession.sparkContext.broadcast(heat)  # a byte a cell, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0):
                tokens, size = shingles(part.column(0))
                if table.value is None:
                    row, key = signatures(tokens, size)
                    short = np.ones(len(row), bool)
                else:
                    row, key, short = prefixes(tokens, size, table.value)
                owner = pa.array(row)
                yield pa.RecordBatch.from_arrays([_signed(key), part.column(1).take(owner), part.column(2).take(owner), pa.array(short)], ["key", "node", "root", "short"])

    members = cut_lineage(texts.select("text", "node", "root").mapInArrow(run, "key long, node long, root long, short boolean"))
    table.destroy()
    return members


def _meeting(rows: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) within the groups of rows, `ends[i]` being the end of row i's group: across components, one short and not the larger, within the bounds."""
    at = {name: rows.column(name).to_numpy(zero_copy_only=False) for name in ("lo", "hi", "block", "root", "short", "node", "n")}
    sketch = np.stack([rows.column(f"s{i}").to_numpy().view(np.uint64) for i in range(SKETCH)], 1)
    fold = np.bitwise_xor.reduce(sketch.reshape(len(sketch), SKETCH // FOLD, FOLD), 1)
    n, root, short, node, block = at["n"].astype(np.int64), at["root"], at["short"], at["node"], at["block"]
    inner = at["lo"] == at["hi"]
    later = ends - np.arange(len(ends)) - 1
    before = np.concatenate(([0], np.cumsum(later)))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + PAIRS, "right")) - 1)
        own = np.arange(start, stop)
        i = np.repeat(own, later[start:stop])
        j = np.arange(len(i)) - np.repeat(before[start:stop] - before[start], later[start:stop]) + i + 1
        take = (root[i] != root[j]) & (inner[i] | (block[i] != block[j]))
        i, j = i[take], j[take]
        i, j = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
        take = (UNDER * n[i] >= OVER * n[j]) & (short[i] | (short[j] & (n[i] == n[j])))
        i, j = i[take], j[take]
        for bits in (fold, sketch):
            far = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            take = (UNDER + OVER) * far <= (UNDER - OVER) * (n[i] + n[j])
            i, j = i[take], j[take]
        i, j = node[i], node[j]
        if len(i):
            found = np.unique(np.stack((np.minimum(i, j), np.maximum(i, j)), 1), axis=0)
            yield pa.RecordBatch.from_arrays([_signed(found[:, 0]), _signed(found[:, 1])], ["a", "b"])
        start = stop


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of rows sorted by key, lo and hi: those of each such group, which is two blocks at most."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = batch if held is None else pa.concat_batches([held, batch])
            key, lo, hi = (rows.column(i).to_numpy() for i in range(3))
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
            last = int(first[-1])  # the last group may go on in the next batch
            if last:
                yield from _meeting(rows.slice(0, last), np.repeat(first[1:], np.diff(first)))
            held = rows.slice(last)
    if held is not None:
        yield from _meeting(held, np.full(held.num_rows, held.num_rows))


def _across(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of the members (key, node, short, root, blocks) of a bucket in different components, within the bounds.

    Pairs that the bounds rule out are never rows: tasks go through the pairs of two blocks at most in memory.
    """
    held = members.join(_as(nodes, "a", SKETCH), F.col("node") == F.col("a"))
    held = held.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "root", "short", "node", F.col("an").alias("n"), *(F.col(f"as{i}").alias(f"s{i}") for i in range(SKETCH)))
    return held.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_met, "a long, b long").distinct()


def _open(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Of members (key, node, root, short): those of open buckets with few pairs; those of crowded ones, both with their number of blocks;
    key and n of the buckets with several members; and the pairs that crowded buckets stand for.

    Most buckets have one member or one component and leave by one aggregate, before anything is joined.
    """
    n, s = F.col("n"), F.col("s")
    counts = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).filter("n > 1")
    counts = cut_lineage(counts.select("key", "n", (F.col("least") < F.col("most")).alias("split")))
    held = cut_lineage(members.join(counts.filter("split").select("key"), "key", "left_semi"))
    sizes = held.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum(F.col("short").cast("long")).alias("s"))
    sizes = sizes.groupBy("key").agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(n * s).alias("own"))
    pairs = n * s - F.col("own")
    keys = cut_lineage(sizes.filter(pairs > 0).select("key", (pairs > 2 * FEW * n).alias("many"), F.ceil(n / BLOCK).cast("int").alias("blocks"), pairs.alias("pairs")))
    total = keys.filter("many").agg(F.sum("pairs")).first()[0] or 0
    few, crowded = (held.join(keys.filter(which).select("key", "blocks"), "key") for which in (~F.col("many"), F.col("many")))
    return few, crowded, counts, total


def _left_open(members: DataFrame, docs: DataFrame, nodes: DataFrame, roots: DataFrame, heat: np.ndarray) -> DataFrame:
    """Pairs (a, b) of members (key, node, short) that the heads of the buckets have not settled: within the bounds of size and sketch."""
    found, texts, left = [], None, None
    members = cut_lineage(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "short"))
    by_tokens = True
    while True:
        few, crowded, counts, pairs = _open(members)
        # Each lot is a plan of its own: a driver need not hold the broadcasts of all rounds at once.
        found.append(cut_lineage(_across(few, nodes)))
        if not pairs:
            left = None
            break
        # What all rounds so far have not found lies in the crowded buckets of each of them, so the least of these will do.
        left = min(left or (pairs, crowded), (pairs, crowded), key=lambda x: x[0])
        if not by_tokens or pairs <= LEFT * members.count():
            break
        if texts is None:
            asked = cut_lineage(crowded.select("node", "root").distinct().join(nodes.select("node", "place"), "node"))
            texts = cut_lineage(_texts(docs, asked).select("text", "node", "root"))
            hotter = _heated(_token_cells(counts), heat)
            by_tokens = bool((hotter > heat).any())
        else:
            texts = cut_lineage(texts.join(crowded.select("node").distinct(), "node", "left_semi"))
            by_tokens = False
        members = _signed_again(texts, hotter if by_tokens else None)
    if left:
        found.append(cut_lineage(_across(left[1], nodes)))
    pairs = reduce(DataFrame.unionByName, found)
    return cut_lineage(pairs.distinct()) if len(found) > 1 else pairs


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes whose connected components are those of all links."""
    heat = _heated(_frequent(docs), np.zeros(1 << HEAT, np.uint8))
    shared = cut_lineage(shared_buckets(_keyed(docs, heat)))
    stars = shared.filter("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"), F.col("key").bitwiseAND(31).alias("o"))
    stars = stars.groupBy("a", "b").agg(F.min("o").alias("o"))
    folded = cut_lineage(_close(stars, nodes, FOLD))
    close = cut_lineage(_wide_close(cut_lineage(_close(folded, nodes, SKETCH)), nodes))
    sets, edges, roots = _sets(close, docs, nodes), None, None
    # One order links most of a large group; the pairs of each further order are needed only across what is not yet linked.
    for low, high in pairwise(ORDERS):
        pairs = close.filter(F.col("o").between(low, high - 1)).select("a", "b")
        if roots is not None:
            pairs = pairs.join(_of(roots, "a"), "a", "left").join(_of(roots, "b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        found = _verified(cut_lineage(pairs), sets)
        edges = cut_lineage(found if edges is None else edges.unionByName(found))
        roots = components(edges)
    # Each bucket's head has met all its members.
    met = _left_open(shared.filter("node <> head").select("key", "node", "short"), docs, nodes, roots, heat)
    met = cut_lineage(_wide_close(met.join(close, ["a", "b"], "left_anti"), nodes))
    return edges if met.isEmpty() else cut_lineage(edges.unionByName(_verified(met, _sets(met, docs, nodes))))


def _classified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: doc_id, place, n, root (null without words), component_id."""
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    sets = cut_lineage(described(slim))
    sketch = [f"s{i}" for i in range(SKETCH)]
    # A node's text is read from one of its rows, of those with an id if there are any.
    stands = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.col("place"))), F.min("place")).alias("place")
    nodes = cut_lineage(sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), stands, F.first("n").alias("n"), *(F.first(s).alias(s) for s in [*sketch, "wide"])))
    with spent_shuffles_dropped(docs.sparkSession):
        roots = components(links(slim, nodes))
    named = nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    where = cut_lineage(named.join(least, "root").select("node", "root", "component_id"))
    return sets.join(where, "node", "left").select(
        "doc_id", "place", "n", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _classified(docs, doc_id, text).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that a smaller id of their class stands for, with the columns they came with.

    Each row is judged by its own text. Of several rows of a class with its smallest id
    one stays; rows without words or id all stay.
    """
    found = cut_lineage(_classified(docs, doc_id, text))
    own = found.filter("doc_id = component_id AND n > 0")
    several = cut_lineage(own.groupBy("root").agg(F.count("*").alias("n"), F.min("place").alias("stays")).filter("n > 1").select("root", "stays"))
    others = own.join(several, "root").filter("place <> stays").select("place")
    gone = cut_lineage(found.filter("doc_id <> component_id").select("place").union(others).distinct())
    here = place(col(docs, doc_id), col(docs, text))
    told = _maybe(gone)
    maybe = F.pandas_udf(lambda places: pd.Series(told(pa.array(places, pa.binary()))), "boolean", F.PandasUDFType.SCALAR)(here)
    # Rows that are surely not gone need not move to be joined.
    rest = docs.filter(~maybe).union(docs.filter(maybe).join(gone, here == gone["place"], "left_anti"))
    if several.isEmpty():
        return rest
    mark = free_name(rest, "twice")
    marked = rest.join(several.select(F.col("stays").alias(mark)), place(col(rest, doc_id), col(rest, text)) == F.col(mark), "left")
    return marked.filter(F.col(mark).isNull()).unionByName(marked.filter(F.col(mark).isNotNull()).dropDuplicates([mark])).drop(mark)
