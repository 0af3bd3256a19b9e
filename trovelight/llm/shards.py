"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split.

Documents hash to bits. A bucket is a prefix; while the bytes below it exceed
the limit it splits on the next bit, and no other bucket does. Splitting works
on sums by prefix, never on documents: each round sums the rows of the buckets
that still have to split, `STEP` bits deeper, and settles the depths between.

A round's part of the directory has a slot for each prefix at its deepest level,
as in extendible hashing, but later rounds hold slots only below the buckets that
went on, so one deep bucket does not double the whole directory. Documents meet
the slots of each round in a plain join on evenly spread keys.

Defined cases: a null text has no bytes but is placed. The hash covers id and
text, so rows with a null or repeated id still part. Identical rows have equal bits and
no bit can part them; they stay together, and a shard that is above the limit for
that reason, or for one huge document, is marked `oversized`. Empty input gives
empty output. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import col
from trovelight.session import cut_lineage

BITS = 60
STEP = 8


def bits(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 over id and text, as a non-negative long."""
    name = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def up(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", value, by if isinstance(by, Column) else F.lit(by))


def _round(rows: DataFrame, limit: int, depth: int, top: int) -> DataFrame:
    """Totals of all prefixes from depth to top: depth, bucket, n_bytes, splits."""
    fine = rows.groupBy(up(F.col("code"), BITS - top).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes"), F.min("code").alias("low"), F.max("code").alias("high"))
    each = fine.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(top)))).withColumn("bucket", up(F.col("fine"), F.lit(top) - F.col("depth")))
    totals = each.groupBy("depth", "bucket").agg(F.sum("n_bytes").alias("n_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    # Equal lowest and highest bits: no further bit parts these rows.
    return totals.select("depth", "bucket", "n_bytes", ((F.col("n_bytes") > limit) & (F.col("low") < F.col("high"))).alias("splits"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets of rows (code, n_bytes): level (of the round's slots), depth, bucket, n_bytes. At most BITS / STEP rounds."""
    leaves, depth, active = [], 0, None
    while depth < BITS:
        top = min(BITS, depth + STEP)
        within = rows if active is None else rows.join(active, up(rows["code"], BITS - depth) == active["root"], "left_semi")
        totals = cut_lineage(_round(within, limit, depth, top))
        parents = totals.filter("splits").select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
        whole = totals.filter(~F.col("splits")).withColumn("parent", up(F.col("bucket"), 1))
        born = whole.join(parents, ["depth", "parent"], "left_semi").select("depth", "bucket", "n_bytes")
        if depth == 0:
            born = born.unionByName(whole.filter("depth = 0").select("depth", "bucket", "n_bytes"))
        leaves.append(born.select(F.lit(top).alias("level"), "depth", "bucket", "n_bytes"))
        active = totals.filter(F.col("splits") & (F.col("depth") == top)).select(F.col("bucket").alias("root"))
        depth = top
        if active.isEmpty():
            break
    return cut_lineage(reduce(DataFrame.unionByName, leaves))


def assign(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth, shard (the prefix as bits), shard_bytes, oversized."""
    size = F.octet_length(F.coalesce(col(docs, text), F.lit(""))).cast("long")
    rows = docs.select(col(docs, doc_id).alias("doc_id"), size.alias("n_bytes"), bits(col(docs, doc_id), col(docs, text)).alias("code"))
    buckets = directory(rows.select("code", "n_bytes"), limit)
    found, place = rows, F.lit(None)
    for (level,) in sorted(buckets.select("level").distinct().collect()):  # the rounds: 8 at most
        own = buckets.filter(F.col("level") == level)
        spread = F.lit(level) - F.col("depth")
        slots = own.select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), spread) - 1)).alias("i"), "depth", "bucket", "n_bytes", spread.alias("spread")
        ).select((F.call_function("shiftleft", F.col("bucket"), F.col("spread")) + F.col("i")).alias("slot"), F.struct("depth", "bucket", "n_bytes").alias(f"at_{level}"))
        found = found.join(slots, up(F.col("code"), BITS - level) == F.col("slot"), "left").drop("slot")
        place = F.coalesce(place, F.col(f"at_{level}"))
    if place is None or len(found.columns) == 3:
        return rows.select("doc_id", "n_bytes", F.lit(0).alias("depth"), F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(False).alias("oversized"))
    found = found.select("doc_id", "n_bytes", place.alias("p"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.col("p.depth").alias("depth"),
        F.when(F.col("p.depth") == 0, "").otherwise(F.lpad(F.bin("p.bucket"), F.col("p.depth"), F.lit("0"))).alias("shard"),
        F.col("p.n_bytes").alias("shard_bytes"),
        (F.col("p.n_bytes") > limit).alias("oversized"),
    )
