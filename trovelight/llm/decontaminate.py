"""Benchmark decontamination as a prefix-filtered set join with exact windows.

A window is `width` consecutive words of an item (the whole item where it is
shorter). It lies in a document only if all its shingles do, so with shingles
ordered by rarity one shingle of each window is a sufficient prefix: the rarest.
One pass over all documents counts in how many of them each of the windows'
shingles stands; a second meets the documents' shingles with the prefixes alone. A
hit gives the one place where the window would stand; bounds on length and
position (it starts at a word and ends by the last) and word-for-word comparison decide.

The windows are the query side. They go out in blocks of `BLOCK` at most, so what
a task holds is bounded whatever the size of the benchmark, and every block meets all
documents. With one block the verdict on a document needs no shuffle; with more, only hits
are gathered by document.

Defined cases: null and empty texts have no words, so no windows and no hits. Items
with the same text each count. Rows that repeat come back as often as they stand;
documents that share an id but not a text are judged apart. With no items, all
documents are clean; with no documents, the result is empty. Other columns are
kept by `keep_clean` and dropped by `hits`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import LOWER, NOT_ALNUM, UPPER, ascii_lower, col, pieces
from trovelight.session import cut_lineage

WIDTH = 10
SHINGLE = 3
BLOCK = 100_000
#: Bytes of UTF-8 to words: A-Z lowered, other ASCII but letters and digits blank, the rest as it is.
TO_WORDS = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))

Window = tuple[bytes, ...]
#: By shingle: its windows' offset, words and items.
Index = dict[Window, list[tuple[int, Window, tuple[str, ...]]]]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


def runs(words: list[bytes], k: int) -> Iterator[Window]:
    return zip(*(words[j:] for j in range(k)), strict=False)


def item_windows(items: DataFrame, item_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """win (words, joined by blanks), items (the ids that hold it, as strings): one row per distinct window."""
    words = items.select(F.coalesce(col(items, item_id).cast("string"), F.lit("")).alias("item"), pieces(ascii_lower(col(items, text)), NOT_ALNUM).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    each = words.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, width), " "))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def _frequencies(docs: DataFrame, wanted: set[Window]) -> Counter:
    """In how many documents each of a block's shingles stands: partial counts per task, summed by shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, held = sorted({len(s) for s in shared.value}), Counter()
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                for k in lengths:
                    held.update(shared.value.intersection(runs(words, k)))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s).decode() for s in held], pa.string()), pa.array(held.values(), pa.int64())], ["s", "n"])

    counted = docs.select("text").mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return Counter({tuple(r.s.encode().split()): r.n for r in counted.collect()})  # the shingles of one block at most


def index(windows: list[tuple[str, list[str]]], docs: DataFrame, shingle: int) -> Index:
    """The windows of a block under their rarest shingle; those with a shingle that no document has are in none."""
    cut = [(tuple(w.encode().split()), tuple(items)) for w, items in windows]
    count = _frequencies(docs, {s for w, _ in cut for s in runs(w, min(shingle, len(w)))})
    found: Index = {}
    for w, items in cut:
        rarest, offset = min((count[s], i) for i, s in enumerate(runs(w, min(shingle, len(w)))))
        if rarest:
            found.setdefault(w[offset : offset + min(shingle, len(w))], []).append((offset, w, items))
    return found


def spans(words: list[bytes], by: Index, lengths: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
    """Where windows stand (start, end), and the items they are from."""
    found, ids = [], set()
    for k in lengths:
        for at, s in enumerate(runs(words, k)):
            if s in by:
                for offset, w, items in by[s]:
                    start = at - offset
                    if start >= 0 and start + len(w) <= len(words) and tuple(words[start : start + len(w)]) == w:
                        found.append((start, start + len(w)))
                        ids.update(items)
    return found, ids


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as spans that do not touch."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(windows: DataFrame, block: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The windows, by hash, in lists of about `block`."""
    n = max(1, -(-windows.count() // block))
    for i in range(n):
        yield [(r.win, r["items"]) for r in windows.filter(F.pmod(F.xxhash64("win"), F.lit(n)) == i).collect()]


def _indexes(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, width: int, shingle: int, block: int) -> list[Index]:
    windows = cut_lineage(item_windows(items, item_id, item_text, width))
    return [index(b, docs, shingle) for b in _blocks(windows, block)]


def _lengths(by: Index) -> list[int]:
    return sorted({len(s) for s in by})


def hits(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    shingle: int = SHINGLE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids, n_items, contaminated."""
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest long, n_words long, spans array<struct<a:int,b:int>>, item_ids array<string>"
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def pass_over(by: Index) -> Callable:
        shared, lengths = slim.sparkSession.sparkContext.broadcast(by), _lengths(by)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, places, ids = [], [], []
                for x in batch.column(2):
                    words = words_of(x.as_py())
                    found, who = spans(words, shared.value, lengths)
                    n.append(len(words))
                    places.append([{"a": a, "b": b} for a, b in merged(found)])
                    ids.append(sorted(who))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(places, span), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "digest", "n_words", "spans", "item_ids"]
                )

        return run

    rows = slim.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    passes = [rows.mapInArrow(pass_over(by), schema) for by in _indexes(slim, items, item_id, item_text, width, shingle, block)]
    found = passes[0]
    if len(passes) > 1:
        # Only rows with hits leave the further passes; documents are told apart by id and digest.
        more = reduce(DataFrame.unionByName, (p.filter(F.size("item_ids") > 0) for p in passes[1:]))
        more = more.dropDuplicates(["doc_id", "digest", "item_ids", "spans"]).groupBy(F.struct("doc_id", "digest").alias("k"))
        more = more.agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("item_ids")).alias("more_ids"))
        both = found.join(more, F.struct("doc_id", "digest").eqNullSafe(F.col("k")), "left")
        none = lambda c, like: F.coalesce(c, F.filter(like, lambda _: F.lit(False)))
        found = both.select(
            "doc_id",
            "n_words",
            F.sort_array(F.concat("spans", none(F.col("more_spans"), F.col("spans")))).alias("spans"),
            F.sort_array(F.array_distinct(F.concat("item_ids", none(F.col("more_ids"), F.col("item_ids"))))).alias("item_ids"),
        )
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(s["end"], x["a"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
        lambda s: s["n"],
    )
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.size("item_ids") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents that hold no window, with the columns they came with; one pass per block, no shuffle."""
    slim = docs.select(col(docs, text).alias("text"))
    left = docs
    for by in _indexes(slim, items, item_id, item_text, WIDTH, SHINGLE, block):
        shared, lengths, at = docs.sparkSession.sparkContext.broadcast(by), _lengths(by), docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, lengths=lengths, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not spans(words_of(x.as_py()), shared.value, lengths)[0] for x in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        left = left.mapInArrow(run, docs.schema)
    return left
