"""Readers for the file formats a corpus arrives in."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight import schemas


def read_jsonl(
    spark: SparkSession, path: str, schema: str, missing_ok: bool = False, encoding: str = "UTF-8"
) -> DataFrame:
    """JSON lines under a declared schema; a missing path may stand for no rows."""
    try:
        return spark.read.schema(schema).option("encoding", encoding).json(path)
    except AnalysisException as problem:
        if missing_ok and problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array per file, with each element's place as ``position``.

    Positions are taken inside the array, before any filter, so ids built from
    them match the source file.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", f"array<struct<{_as_struct(schema)}>>")
    return whole.select(F.posexplode(rows).alias("position", "_r")).select("position", "_r.*")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, schemas.ARTICLES)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, schemas.RAW_QUERIES)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(position, text, vector) out of a {"texts": [...], "vectors": [...]} file."""
    stored = spark.read.schema(schemas.VECTOR_FILE).option("multiLine", True).json(path)
    pairs = F.posexplode(F.arrays_zip("texts", "vectors")).alias("position", "_p")
    return stored.select(pairs).select(
        "position", F.col("_p.texts").alias("text"), F.col("_p.vectors").alias("vector")
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Stored results, one row per condition with its position in the file."""
    stored = spark.read.schema(schemas.METRICS_FILE).option("multiLine", True).json(path)
    return stored.select(F.posexplode("conditions").alias("position", "_c")).select(
        "position", "_c.*"
    )


def sitemap_entries(payload: Column) -> Column:
    """array<struct(url, last_modified)> of one sitemap document; empty URLs dropped."""
    blocks = F.regexp_extract_all(payload, F.lit(r"(?s)<(?:\w+:)?url>(.*?)</(?:\w+:)?url>"), F.lit(1))

    def inner(block: Column, tag: str) -> Column:
        text = F.regexp_extract(block, rf"(?s)<(?:\w+:)?{tag}>(.*?)</(?:\w+:)?{tag}>", 1)
        for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
            text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
        return F.trim(text)

    rows = F.transform(
        blocks, lambda b: F.struct(inner(b, "loc").alias("url"), inner(b, "lastmod").alias("last_modified"))
    )
    return F.filter(rows, lambda r: r["url"] != "")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, url, last_modified) of a sitemap file, in file order."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string")
    loaded = raw.load(path).select(
        F.monotonically_increasing_id().alias("ordinal"),
        F.trim("loc").alias("url"),
        F.coalesce(F.trim("lastmod"), F.lit("")).alias("last_modified"),
    )
    return loaded.filter(F.coalesce("url", F.lit("")) != "")


def page_text(content: Column) -> Column:
    """UTF-8 bytes of a page as text; undecodable bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """Cached pages: path and page text; empty files do not count as cached."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return files.filter(F.col("length") > 0).select("path", page_text(F.col("content")).alias("html"))


def _as_struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString().removeprefix("struct<").removesuffix(">")
