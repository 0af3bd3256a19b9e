"""Token counts kept by deltas: signed inserts, deletes and revisions add up to totals by source, language and tokenizer version.

A ledger folder holds one sub-folder per committed batch. A batch of changes
names documents with their counts (none for a delete). The batch is turned into
signed entries: the new count, minus what earlier batches made of the same
document. Entries are pre-aggregated to deltas by group, so totals are sums of
small tables, and a hot source costs no more than another.

A batch is committed by one move of a finished folder to its final name, and a
batch whose name exists is left alone, so a batch that is sent again, or whose
driver was lost after the commit, counts once.

Defined cases: null source, language or version form a group of their own. A null
document id names one document as any other value does. A count of null, or an
operation "delete", removes the document; removing what was never there does
nothing. If a batch names a document and version more than once, the last by
`seq` holds, and among equals the larger count. Empty batches commit and change nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



GROUP = ("source", "lang", "version")
KEY = ("doc_id", "version")
ENTRY = "doc_id string, version string, source string, lang string, docs long, tokens long"

#: Tokenizer versions: words between white space, and runs of letters and digits.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "alnum-2": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["version"].eqNullSafe(b["version"])


class Ledger:
    """Committed batches under one folder of a store that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder)))
        return sorted(n for n in names if not n.startswith((".", "_")))

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{b}/{part}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """What stands for each document and version: the sum of its signed entries by group."""
        entries = self._read("entries", ENTRY)
        held = entries.groupBy(*KEY, "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return held.filter("docs <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (doc_id, version, source, lang, op, tokens, seq); False if the batch is known."""
        final = self._path(f"{self.folder}/{batch}")
        if self._fs.exists(final):
            return False
        rows = changes.select(
            F.col("doc_id").cast("string").alias("doc_id"),
            *(F.col(c).cast("string").alias(c) for c in ("version", "source", "lang")),
            F.when((F.col("op") == "delete") & F.col("op").isNotNull(), F.lit(None)).otherwise(F.col("tokens")).cast("long").alias("tokens"),
            F.col("seq").cast("long").alias("seq"),
        )
        last = rows.groupBy(*KEY).agg(F.max(F.struct("seq", "tokens", "source", "lang")).alias("x")).select(*KEY, "x.tokens", "x.source", "x.lang")
        new = last.filter("tokens IS NOT NULL").select(*KEY, "source", "lang", F.lit(1).cast("long").alias("docs"), "tokens")
        entries = new
        if self.batches():
            now = self.current()
            back = now.join(last, _same(now, last), "left_semi").withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})
            entries = new.unionByName(back.select(new.columns))
        pending = f"{self.folder}/.{batch}-{self.spark.sparkContext.applicationId}"
        entries.write.mode("overwrite").parquet(f"{pending}/entries")
        written = self.spark.read.schema(ENTRY).parquet(f"{pending}/entries")
        deltas = written.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{pending}/deltas")
        return bool(self._fs.rename(self._path(pending), final))

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of what stands, from the batches' deltas."""
        deltas = self._read("deltas", "source string, lang string, version string, docs long, tokens long")
        sums = deltas.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")


def counts(docs: DataFrame, version: str) -> DataFrame:
    """Changes that insert each document with its count under a version of VERSIONS."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(VERSIONS[version]))
    return docs.select("doc_id", F.lit(version).alias("version"), "source", "lang", F.lit("insert").alias("op"), n.cast("long").alias("tokens"), F.lit(0).alias("seq"))


