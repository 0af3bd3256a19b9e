"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Fixed by the contracts: what separates words of prose, and what words of letters and digits exclude.
BLANK = r"[\x20\x09-\x0D]"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the input does not use, compared as Spark does, without case."""
    taken, name = {c.lower() for c in df.columns}, f"_{wanted}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(df: DataFrame, name: str) -> Column:
    """The column as it is, however odd its name or that of its neighbours."""
    return df[f"`{name}`"]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def pieces(text: Column, separators: str) -> Column:
    """Words between runs of `separators`; an empty array for none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators + "+"), lambda w: w != "")


def let(value: Column, then) -> Column:
    """Bind a costly array once, so that lambdas inside `then` do not compute it for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def bounded_chunks(sizes: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Index ranges whose padded area (rows x longest) stays below `most`; sizes ascend."""
    start, sizes = 0, list(sizes)
    for end in range(1, len(sizes) + 1):
        if end == len(sizes) or (end + 1 - start) * max(1, sizes[end]) > most:
            yield start, end
            start = end


def text_slices(batch: pa.RecordBatch, at: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts, column `at`, take `most` bytes together, or that are one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder below the shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        cut_lineage(spark.range(1))  # in a local session this makes the folder
        root = spark.sparkContext.getCheckpointDir()
    root = root if re.match(r"[a-z0-9]+:", root) else f"file://{root}"
    return re.sub(r"^file:/+", "file:///", root).rstrip("/") + f"/{name}-{uuid4().hex}"
