"""Writers and resumable stage outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trovelight.operators.corpora import upsert_condition
from trovelight.operators.evidence import last_per_key


def write_jsonl(rows: DataFrame, path: str, ascii_only: bool = False) -> None:
    """JSON lines; `ascii_only` escapes every character beyond ASCII as \\uXXXX."""
    if not ascii_only:
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        return
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    rows.select(_escape_non_ascii(line).alias("value")).write.mode("overwrite").text(path)


def _escape_non_ascii(line):
    units = F.hex(F.encode(line, "UTF-16BE"))
    codes = F.regexp_extract_all(units, F.lit("[0-9A-F]{4}"), F.lit(0))

    def shown(code):
        value = F.conv(code, 16, 10).cast("int")
        return F.when(value < 128, F.char(value)).otherwise(F.concat(F.lit("\\u"), F.lower(code)))

    return F.when(line.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(codes, shown), "")).otherwise(line)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def compact(
    spark: SparkSession, path: str, target: str, schema: str | StructType, key: str, success=None, order: str | None = None
) -> DataFrame:
    """Rewrite an appended checkpoint with one row per key, successes only.

    With `order` that is the newest row of each key, by that column. Writes to `target`, never over the files being read.
    """
    rows = read_checkpoint(spark, path, schema)
    if success is not None:
        rows = rows.filter(success)
    kept = last_per_key(rows, [key], order) if order else rows.dropDuplicates([key])
    kept.write.mode("overwrite").parquet(target)
    return spark.read.schema(schema).parquet(target)


def store_metrics(spark: SparkSession, path: str, target: str, fresh: DataFrame) -> DataFrame:
    """Upsert condition rows by name into a stored metrics table."""
    stored = read_checkpoint(spark, path, fresh.schema)
    upsert_condition(stored, fresh).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def write_rankings(rankings: DataFrame, metrics: DataFrame, path: str) -> None:
    """Nested export: per query and condition the ranked ids and the metrics."""
    ids = rankings.groupBy("condition", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("_r")
    )
    names = [c for c in metrics.columns if c not in ("condition", "query_id")]
    nested = ids.join(metrics, ["condition", "query_id"]).select(
        "condition",
        "query_id",
        F.col("_r.chunk_id").alias("ranked_chunk_ids"),
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("metrics"),
    )
    write_jsonl(nested, path)
