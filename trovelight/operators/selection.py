"""Corpus construction: length status, exact duplicates, priority selection, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelight.operators.ordinals import first_by_key

# Accepted length range, preferred length, corpus size.
MIN_TOKENS = 1500
MAX_TOKENS = 5000
PREFERRED_TOKENS = 2500
TARGET_DOCUMENTS = 340

# Status labels of the audit.
ELIGIBLE = "eligible"
LENGTH_EXCLUDED = "length_excluded"
DUPLICATE_EXCLUDED = "duplicate_excluded"
CAP_EXCLUDED = "eligible_not_selected_target_cap"
DOWNLOAD_ERROR = "download_error"

# Category order of the selection; others come last.
CATEGORY_PRIORITY = (
    "news faqs uslugi planove rouming digitalni-uslugi tv-internet nashata-mrezha "
    "ustoychivo-razvitie bezopasen-internet business ustroystva za-nas karieri go-plus"
).split()


def length_status(token_count: Column, low: int = MIN_TOKENS, high: int = MAX_TOKENS) -> Column:
    return F.when(token_count.between(low, high), ELIGIBLE).otherwise(LENGTH_EXCLUDED)


def mark_duplicates(pages: DataFrame, order: str = "ordinal") -> DataFrame:
    """Among eligible pages keep the first of each identical body; mark the rest."""
    eligible = pages.filter(F.col("status") == ELIGIBLE)
    firsts = first_by_key(eligible.select(order, "digest"), "digest", order)
    repeats = firsts.filter(~F.col("is_first")).select(order, F.lit(True).alias("_repeat"))
    return (
        pages.join(repeats, order, "left")
        .withColumn(
            "status", F.when(F.col("_repeat"), DUPLICATE_EXCLUDED).otherwise(F.col("status"))
        )
        .drop("_repeat")
    )


def priority_rank(category: Column, priority: list[str] | tuple[str, ...]) -> Column:
    position = F.array_position(F.array(*[F.lit(c) for c in priority]), category)
    return F.when(position > 0, position - 1).otherwise(F.lit(999))


def select_by_priority(
    pages: DataFrame,
    priority: list[str] | tuple[str, ...] = tuple(CATEGORY_PRIORITY),
    limit: int = TARGET_DOCUMENTS,
    preferred: int = PREFERRED_TOKENS,
    key: str = "url",
) -> DataFrame:
    """The first `limit` eligible pages by category, closeness in length, and key.

    Planned as TakeOrderedAndProject: each task offers at most `limit` rows.
    """
    return (
        pages.filter(F.col("status") == ELIGIBLE)
        .orderBy(
            priority_rank(F.col("category"), priority),
            F.abs(F.col("token_count") - preferred),
            key,
        )
        .limit(limit)
    )


def mark_unselected(pages: DataFrame, selected: DataFrame, key: str = "url") -> DataFrame:
    chosen = selected.select(key, F.lit(True).alias("_chosen"))
    return (
        pages.join(chosen, key, "left")
        .withColumn(
            "status",
            F.when((F.col("status") == ELIGIBLE) & F.col("_chosen").isNull(), CAP_EXCLUDED).otherwise(
                F.col("status")
            ),
        )
        .drop("_chosen")
    )


def restore_order(selected: DataFrame, inventory: DataFrame, prefix: str = "doc") -> DataFrame:
    """Number the selected pages by the first place of their URL in the inventory.

    `selected` holds at most the selection limit, so the unpartitioned window is
    bounded by that limit and not by the data.
    """
    places = inventory.join(selected.select("url"), "url", "left_semi")
    first = places.groupBy("url").agg(F.min("ordinal").alias("_place"))
    order = Window.orderBy("_place")
    return (
        selected.join(first, "url")
        .withColumn(
            "document_id", F.format_string(prefix + "_%04d", F.row_number().over(order))
        )
        .drop("_place")
    )


def corpus_summary(documents: DataFrame, tokens: str = "token_count") -> DataFrame:
    return documents.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.min(tokens).alias("minimum_document_tokens"),
        F.max(tokens).alias("maximum_document_tokens"),
        F.round(F.avg(tokens), 2).alias("mean_document_tokens"),
    )
