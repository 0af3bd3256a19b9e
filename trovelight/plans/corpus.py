"""From fetched pages to a selected, chunked corpus with an audit of every page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.functions import markup as H
from trovelight.functions import text as T
from trovelight.operators import selection as P
from trovelight.operators.chunking import sliding_chunks
from trovelight.session import cut_lineage


@dataclass
class Corpus:
    documents: DataFrame
    chunks: DataFrame
    audit: DataFrame


def clean_pages(
    pages: DataFrame, inside: str | None = "main", site_suffix: str | None = None, tokens=T.word_tokens
) -> DataFrame:
    """Title, body, category, lengths and digest of every page that arrived."""
    read = pages.withColumn("_a", H.extract_article(inside)("html"))
    titled = read.withColumn(
        "title",
        F.when(F.col("_a.title") != "", F.col("_a.title")).otherwise(
            H.fallback_title(F.col("html"), F.col("url"), site_suffix)
        ),
    ).withColumn("_clean", H.clean_text(F.col("_a.raw")))
    bodied = titled.withColumn("body", T.drop_leading_title(F.col("title"), F.col("_clean")))
    counted = bodied.withColumn("token_count", F.size(tokens(F.col("body"))))
    return counted.select(
        "ordinal",
        "url",
        "last_modified",
        "error",
        "title",
        "body",
        T.category_for(F.col("url")).alias("category"),
        "token_count",
        F.length("body").alias("character_count"),
        T.body_digest(F.col("body")).alias("digest"),
    )


def build_corpus(
    pages: DataFrame,
    source: str,
    language: str,
    prefix: str = "doc",
    inside: str | None = "main",
    site_suffix: str | None = None,
    tokens=T.word_tokens,
    tokenizer_name: str = "words",
    limits: tuple[int, int] = (P.MIN_TOKENS, P.MAX_TOKENS),
    target: int = P.TARGET_DOCUMENTS,
    priority: tuple[str, ...] = tuple(P.CATEGORY_PRIORITY),
    preferred: int = P.PREFERRED_TOKENS,
) -> Corpus:
    """`pages`: ordinal (inventory place), url, last_modified, html, error.

    Pages as fetched carry bytes: see `sources.readers.page_text`. Pages without
    html are audited as download errors.
    """
    arrived = pages.filter(F.col("html").isNotNull())
    cleaned = clean_pages(arrived, inside, site_suffix, tokens).withColumn(
        "status", P.length_status(F.col("token_count"), *limits)
    )
    marked = cut_lineage(P.mark_duplicates(cleaned))
    chosen = cut_lineage(P.select_by_priority(marked, priority, target, preferred))
    named = P.restore_order(chosen, pages.select("url", "ordinal"), prefix)
    dated = F.when(F.col("last_modified") != "", F.col("last_modified"))
    nothing = F.lit(None).cast("string")
    documents = cut_lineage(
        named.select(
            "document_id",
            "title",
            nothing.alias("author"),
            F.lit(source).alias("source"),
            nothing.alias("published_at"),
            dated.alias("date"),
            F.when(dated.isNotNull(), "last_modified").alias("date_type"),
            "category",
            "url",
            F.lit(language).alias("language"),
            F.lit(tokenizer_name).alias("tokenizer"),
            "token_count",
            F.col("digest").alias("body_sha256"),
            "body",
        )
    )
    pieces = sliding_chunks(documents, tokens(F.col("body")), keep=("title", "url", "date", "category"))
    chunks = pieces.withColumnsRenamed({"n_tokens": "token_count", "content": "text"}).drop(
        "chunk_position"
    )
    columns = ["url", "title", "category", "last_modified", "token_count", "character_count", "status", "error"]
    lost = pages.filter(F.col("html").isNull()).select(
        "url", F.lit(P.DOWNLOAD_ERROR).alias("status"), "error"
    )
    audit = P.mark_unselected(marked, chosen).select(*columns)
    return Corpus(documents, chunks, audit.unionByName(lost, allowMissingColumns=True))
