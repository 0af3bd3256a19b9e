"""Token-bounded chunks: sliding windows and sentence packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.functions import text as T

# Window size, overlap.
CHUNK_TOKENS = 1024
OVERLAP_TOKENS = 128


def sliding_chunks(
    documents: DataFrame,
    tokens: Column,
    document_id: str = "document_id",
    keep: tuple[str, ...] = (),
    label: str | None = None,
    size: int = CHUNK_TOKENS,
    overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Fixed windows over a token array; the last one ends at the last token.

    The windows are cut inside the row before it is exploded, so the whole
    token array is never copied into each output row.
    """
    stride = size - overlap
    name = F.col(label or document_id)
    words = documents.select(document_id, *keep, name.alias("_label"), tokens.alias("_tokens"))
    last_start = F.greatest(F.size("_tokens") - F.lit(overlap + 1), F.lit(0))
    # No filter on the token count: it would be pushed below and tokenise twice.
    starts = F.when(F.size("_tokens") > 0, F.sequence(F.lit(0), last_start, F.lit(stride)))
    windows = F.transform(
        starts,
        lambda start: F.struct(
            start.alias("token_start"),
            F.least(start + size, F.size("_tokens")).alias("token_end"),
            F.trim(F.array_join(F.slice("_tokens", start + 1, F.lit(size)), " ")).alias("content"),
        ),
    )
    return (
        words.select(document_id, *keep, "_label", F.posexplode(windows).alias("chunk_position", "_w"))
        .select(
            F.format_string("%s::c%02d", "_label", "chunk_position").alias("chunk_id"),
            F.col(document_id),
            *keep,
            "chunk_position",
            "_w.token_start",
            "_w.token_end",
            (F.col("_w.token_end") - F.col("_w.token_start")).alias("n_tokens"),
            "_w.content",
        )
    )


def encoded_chunks(
    documents: DataFrame,
    tokenizer,
    document_id: str = "document_id",
    body: str = "body",
    keep: tuple[str, ...] = (),
    size: int = CHUNK_TOKENS,
    overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """`sliding_chunks` for a tokenizer whose windows must be decoded by itself."""
    kind = "array<struct<token_start:int,token_end:int,content:string>>"

    @F.pandas_udf(kind)
    def cut(bodies: pd.Series) -> pd.Series:
        def one(text: str) -> list[dict]:
            ids = tokenizer.encode(text or "")
            starts = range(0, max(len(ids) - overlap, 1), size - overlap) if len(ids) else ()
            return [
                {
                    "token_start": at,
                    "token_end": min(at + size, len(ids)),
                    "content": tokenizer.decode(ids[at : at + size]).strip(),
                }
                for at in starts
            ]

        return bodies.map(one)

    windows = F.posexplode(cut(F.col(body))).alias("chunk_position", "_w")
    return documents.select(document_id, *keep, windows).select(
        F.format_string("%s::c%02d", F.col(document_id), "chunk_position").alias("chunk_id"),
        document_id,
        *keep,
        "chunk_position",
        "_w.token_start",
        "_w.token_end",
        (F.col("_w.token_end") - F.col("_w.token_start")).alias("n_tokens"),
        "_w.content",
    )


#: What a window is made of.
UNIT = "array<struct<paragraph:int,content:string,cost:int>>"


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _short_tail(costs: Column, overlap: int) -> Column:
    """The costs of the shortest tail that reaches the overlap, none if only the whole does."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("held"))
    tail = F.aggregate(
        F.reverse(costs),
        start,
        lambda t, c: F.when(t["held"] >= overlap, t).otherwise(
            F.struct((t["n"] + 1).alias("n"), (t["held"] + c).alias("held"))
        ),
        lambda t: t["n"],
    )
    return _let(tail, lambda n: F.when(n < F.size(costs), F.slice(costs, F.size(costs) - n + 1, n)).otherwise(_no_costs()))


def _no_costs() -> Column:
    return F.array().cast("array<int>")


def _total(costs: Column) -> Column:
    return F.aggregate(costs, F.lit(0), lambda t, c: t + c)


def packed_windows(units: Column, size: int, overlap: int) -> Column:
    """array<struct<first,n>>: whole units packed in order into windows of at most `size`.

    One fold on the JVM. Its state is the closed windows and the costs of the open
    one. A unit that does not fit closes the open window, which goes on as its own
    shortest tail of `overlap` or more; where the unit does not fit behind that tail
    either, the tail is a window too and the unit opens a new one. A last window of the
    same units as the one before it is left out.
    """
    span = "array<struct<first:int,n:int>>"

    def window(at: Column, costs: Column) -> Column:
        n = F.size(costs)
        return F.struct((at - n).alias("first"), n.alias("n"))

    def step(state: Column, unit: Column) -> Column:
        at, cost = state["at"], unit["cost"]

        def fits(costs: Column) -> Column:
            return (F.size(costs) == 0) | (_total(costs) + cost <= size)

        def added(done: Column, costs: Column) -> Column:
            grown = F.concat(costs, F.array(cost))
            return F.struct(done.alias("done"), grown.alias("costs"), (at + 1).alias("at"))

        def after(tail: Column) -> Column:
            closed = F.concat(state["done"], F.array(window(at, state["costs"])))
            twice = F.concat(closed, F.array(window(at, tail)))
            return F.when(fits(tail), added(closed, tail)).otherwise(added(twice, _no_costs()))

        return F.when(fits(state["costs"]), added(state["done"], state["costs"])).otherwise(
            _let(_short_tail(state["costs"], overlap), after)
        )

    def of(w: Column) -> Column:
        return F.slice(units, w["first"] + 1, w["n"])

    def finish(state: Column) -> Column:
        last, done = window(state["at"], state["costs"]), state["done"]
        same = F.coalesce(of(last) == of(F.try_element_at(done, F.lit(-1))), F.lit(False))
        return F.when((F.size(state["costs"]) == 0) | same, done).otherwise(F.concat(done, F.array(last)))

    start = F.struct(F.array().cast(span).alias("done"), _no_costs().alias("costs"), F.lit(0).alias("at"))
    return F.aggregate(units, start, step, finish)


def _word_units(split: Column, size: int) -> Column:
    """Sentences as units that cost their words; a longer one in pieces of `size` words."""

    def unit(number: Column, parts: Column) -> Column:
        return F.struct(number.cast("int").alias("paragraph"), F.array_join(parts, " ").alias("content"), F.size(parts).alias("cost"))

    def of_sentence(number: Column, parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(parts), F.lit(size))
        return F.transform(starts, lambda at: unit(number, F.slice(parts, at, size)))

    def of_paragraph(sentences: Column, number: Column) -> Column:
        spoken = F.filter(sentences, lambda x: x != "")
        return F.flatten(F.transform(spoken, lambda x: of_sentence(number, F.split(x, " "))))

    return F.flatten(F.transform(split, of_paragraph)).cast(UNIT)


def _encoded_units(split: Column, tokenizer, size: int) -> Column:
    """The same with a tokenizer's own tokens; a piece costs what its decoded text encodes to."""

    @F.pandas_udf(UNIT)
    def units(batch: pd.Series) -> pd.Series:
        def pieces(sentence: str):
            ids = tokenizer.encode(sentence)
            if len(ids) <= size:
                yield sentence, len(ids)
            else:
                texts = (tokenizer.decode(ids[i : i + size]).strip() for i in range(0, len(ids), size))
                yield from ((text, len(tokenizer.encode(text))) for text in texts)

        return batch.map(lambda split: [(p, *piece) for p, part in enumerate(split) for x in part if x for piece in pieces(x)])

    return units(split)


def sentence_chunks(
    documents: DataFrame,
    document_id: str = "document_id",
    body: str = "body",
    keep: tuple[str, ...] = (),
    label: str | None = None,
    tokenizer=None,
    size: int = CHUNK_TOKENS,
    overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Pack whole sentences into windows, carrying a tail of sentences over.

    By default tokens are whitespace words, and all of it is Column functions inside
    the document's row: no shuffle, no Python. `tokenizer` has ``encode``/``decode``
    like a BPE tokenizer; then its calls alone run in Python. A null or blank body has
    no windows.
    """
    split = F.transform(
        T.paragraphs(T.blank_if_null(F.col(body))), lambda p: T.sentences(T.collapse_space(p))
    )
    units = _word_units(split, size) if tokenizer is None else _encoded_units(split, tokenizer, size)
    rows = documents.select(document_id, *keep, F.col(label or document_id).alias("_label"), units.alias("_units"))
    rows = rows.withColumn("_spans", packed_windows(F.col("_units"), size, overlap))

    def content(span: Column) -> Column:
        own = F.slice("_units", span["first"] + 1, span["n"])
        return F.struct(F.array_join(own["content"], " ").alias("joined"), _total(own["cost"]).alias("cost"))

    windows = F.posexplode(F.transform("_spans", content)).alias("chunk_position", "_w")
    if tokenizer is None:
        tokens = F.col("_w.cost")
    else:
        tokens = F.pandas_udf(lambda s: s.map(lambda x: len(tokenizer.encode(x))), "int")(F.col("_w.joined"))
    return rows.select(document_id, *keep, "_label", windows).select(
        F.format_string("%s::l%d", "_label", "chunk_position").alias("chunk_id"),
        F.col(document_id),
        *keep,
        "chunk_position",
        tokens.alias("n_tokens"),
        F.trim("_w.joined").alias("content"),
    )


class WordTokenizer:
    """Whitespace words with the encode/decode shape of a subword tokenizer."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, ids: list[str]) -> str:
        return " ".join(ids)
