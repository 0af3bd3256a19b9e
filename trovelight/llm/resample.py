"""Importance resampling towards a target distribution: array-scored weights, a cutoff by bisection, ranks by ranges.

1. Counts. Features are runs of 1 to `longest` words, hashed into buckets. Each task
   adds its features up in one array, so what leaves it is a row a bucket, and the sums over the tasks
   are one array as long as there are buckets: its size is a parameter, whatever the corpus.
2. Scores. A document's weight is the sum of its features' gains, read from the array
   of log ratios between target and source; noise drawn from the document's id (a
   Gumbel variate) makes the highest scores a weighted draw without replacement. Scores are
   written to the shared folder; nothing after this reads a text.
3. Cutoff. The k-th place is found by bisection: exact counts over the stored
   scores, for `PIVOTS` cuts of the interval at a time; then in the same way over the ids of
   the rows with that very score, and over row numbers where rows share an id too. No rows are
   sorted or gathered for it.
4. Ranks. The drawn rows alone are dealt by range and sorted inside the ranges; a rank is the
   position in the range and the sizes of the ranges before it.

Defined cases: a null text, or one without words, has no features, weight 0 and is never drawn. A null id stands as the word
`null` in the noise and comes after all ids at ties. Rows that share score and id are drawn in
the order of the stored rows, which is fixed; repeated rows count as documents of their own. With
no documents, or too few for a draw, all ranks are null; an empty target leaves gains by the
smoothing alone. Columns beside the two named are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.llm.common import LOWER, UPPER, col, text_slices
from trovelight.session import cut_lineage

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Cuts of an interval that one count job tries.
PIVOTS = 31
#: Bytes of UTF-8: plain letters lowered, what parts words made blank.
WORD_BYTES = bytes(i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else ord(LOWER[i - 0x41]) if chr(i) in UPPER else 0x20 for i in range(256))


def hashed(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all texts' features, how many each text has, and its words."""
    parts = [(t or "").encode().translate(WORD_BYTES).split() for t in texts]
    words = np.array([len(p) for p in parts], np.int64)
    runs = parts if longest == 1 else [[b" ".join(p[i : i + n]) for n in range(1, longest + 1) for i in range(len(p) - n + 1)] for p in parts]
    size = np.array([len(r) for r in runs], np.int64)
    crc = np.fromiter((zlib.crc32(x) for r in runs for x in r), np.int64, int(size.sum()))
    return crc % buckets, size, words


def bucket_counts(texts: DataFrame, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                held += np.bincount(hashed(part.column(0).to_pylist(), longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["bucket", "n"])

    sums = texts.select(col(texts, text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # a row a bucket at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of each bucket's shares."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    ratio = ((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(doc_id: object, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, doc_id: str, text: str, target_text: str, longest: int, buckets: int, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and a number `row` of every row."""
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                bucket, size, words = hashed(part.column(1).to_pylist(), longest, buckets)
                total = np.concatenate(([0], np.cumsum(gain[bucket])))
                ends = np.cumsum(size)
                weight = total[ends] - total[ends - size]
                score = weight + np.array([noise(i, seed) for i in part.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (size, words, weight, score))], ["doc_id", "n_features", "n_words", "weight", "score"])

    found = slim.mapInArrow(run, f"doc_id {kind}, n_features long, n_words long, weight long, score long")
    return found.withColumn("row", F.monotonically_increasing_id())


def least_reaching(rows: DataFrame, value: Column, wanted: int) -> tuple[int, int]:
    """The smallest v with at least `wanted` rows of value <= v, and how many rows lie below v.

    Each job counts the rows up to some cuts of the interval that still holds v.
    """
    held = rows.select(value.alias("v"))
    low, high = held.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high:
        steps = min(PIVOTS, high - low)
        cuts = sorted({low + (high - low) * k // (steps + 1) for k in range(1, steps + 1)} - {high})
        inside = held.filter(F.col("v").between(low, high))
        counts = inside.agg(*(F.count(F.when(F.col("v") <= c, 1)) for c in cuts)).first()
        before, done = 0, False
        for cut, n in zip(cuts, counts, strict=True):
            if below + n >= wanted:
                high, done = cut, True
                break
            low, before = cut + 1, n
        below += before
        if not done and low > high:
            low = high
    return low, below


def cutoff(rows: DataFrame, wanted: int) -> Column:
    """Whether a row is one of the first `wanted` by falling score, then id (nulls last), then row number."""
    worst, taken = least_reaching(rows, -F.col("score"), wanted)
    score = -worst
    drawn, tied = F.col("score") > score, F.col("score") == score
    wanted -= taken
    ties = rows.filter(tied)
    named = ties.filter(F.col("doc_id").isNotNull())
    n_named = named.count()
    if n_named < wanted:  # all of them, and some without id
        drawn, tied = drawn | (tied & F.col("doc_id").isNotNull()), tied & F.col("doc_id").isNull()
        wanted -= n_named
    else:
        last, taken = least_reaching(named, F.col("doc_id"), wanted)
        drawn, tied = drawn | (tied & (F.col("doc_id") < last)), tied & (F.col("doc_id") == last)
        wanted -= taken
    last, _ = least_reaching(rows.filter(tied), F.col("row"), wanted)
    return F.coalesce(drawn | (tied & (F.col("row") <= last)), F.lit(False))


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with their rank by falling score, then id (nulls last), then row number."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Such a number holds the partition above bit 33 and the position below it.
    held = cut_lineage(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return held.join(ranges, part == F.col("part")).withColumn("rank", F.col("first") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "first", "_at")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """One row per document: doc_id (an integer), n_features, weight, score, rank (null if not drawn)."""
    rows = cut_lineage(scored(docs, target, doc_id, text, target_text, longest, buckets, seed))
    eligible = F.col("n_words") >= least_words
    wanted = percent * rows.filter(eligible).count() // 100
    names = ("doc_id", "n_features", "weight", "score")
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*names, none)
    drawn = eligible & cutoff(rows.filter(eligible), wanted)
    return rows.filter(~drawn).select(*names, none).unionByName(ranked(rows.filter(drawn)).select(*names, "rank"))
