"""Downloading an inventory of pages, spread over the cluster."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGE_SCHEMA = "ordinal long, url string, last_modified string, html binary, error string"


def http_get(url: str, timeout: int = 60) -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "trovelight"}), timeout=timeout) as reply:
        return reply.read()


def fetch_pages(
    inventory: DataFrame,
    stored: DataFrame | None = None,
    get: Callable[[str], bytes] = http_get,
    refresh: bool = False,
    attempts: int = 3,
    pause: Callable[[float], None] = time.sleep,
    workers: int = 6,
) -> DataFrame:
    """Pages of the inventory not stored yet, each tried up to three times.

    `error` keeps the last failure even when a later attempt succeeded; a page
    that never arrived has NULL html. Write the result next to `stored`.
    """
    wanted = inventory
    if stored is not None and not refresh:
        wanted = inventory.join(stored.filter("length(html) > 0").select("url"), "url", "left_anti")

    def one(url: str) -> tuple[bytes | None, str]:
        error = ""
        for attempt in range(attempts):
            try:
                return get(url), error
            except Exception as problem:
                error = f"{type(problem).__name__}: {problem}"
                pause(1.5 * (attempt + 1))
        return None, error

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [one(url) for url in batch["url"]]
            batch["html"] = [html for html, _ in pages]
            batch["error"] = [error for _, error in pages]
            yield batch[["ordinal", "url", "last_modified", "html", "error"]]

    return wanted.repartition(workers, "url").mapInPandas(each, PAGE_SCHEMA)
