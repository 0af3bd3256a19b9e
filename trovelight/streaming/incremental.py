"""Resumable embedding of texts that keep arriving, as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trovelight import schemas
from trovelight.functions.embedding import Embedder, embed_missing
from trovelight.sources.checkpoints import append_rows, read_checkpoint


def embed_arrivals(
    spark: SparkSession, source: str, cache: str, state: str, embedder: Embedder
) -> StreamingQuery:
    """Embed each new (text) row the vector cache lacks and append it to the cache.

    A batch replayed after a failure finds its vectors in the cache and adds none,
    so every distinct text is embedded and stored once.
    """

    def add(batch: DataFrame, _: int) -> None:
        stored = read_checkpoint(batch.sparkSession, cache, schemas.VECTORS)
        append_rows(embed_missing(batch, stored, embedder), cache)

    return (
        spark.readStream.schema("text string")
        .parquet(source)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
