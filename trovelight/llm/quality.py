"""Quality rules at host level: failures by host, rates shrunk by an empirical beta prior, verdicts joined back.

All of it is DataFrame functions. A document's own rules decide `base_failed`;
a document that passes them still goes if its host is bad. A host is bad when,
for some rule, the posterior mean of its failure rate exceeds `HOST_LIMIT`: the
prior of each rule is a beta distribution with the mean and variance of the
rates of all hosts (method of moments), so a host with few documents is judged
by what hosts are usually like.

Defined cases: a null text has no words and fails; an empty one too. A null host
is no host: its documents answer only for themselves. Repeated rows count, and
come back, as often as they stand. Empty input gives empty output. Other columns,
whatever their names, are kept by `keep_good` and dropped by `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import BLANK, col, free_name, let, pieces
from trovelight.session import cut_lineage

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
MOST_SYMBOLS = 30  # per 100 words, host rule only
MOST_DUP_LINES = 30  # per 100 lines with a word, host rule only
HOST_LIMIT = 0.6
LEAST_WEIGHT = 5.0
RULES = ("short", "repetitive", "symbols", "dup_lines")
SALTS = 16


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Most texts repeat none, which a set of their windows shows. In others the windows
    are sorted with their positions; a window equal to a neighbour is
    repeated, and each repeated start adds the words not covered by the one before.
    """

    def starts(order: Column) -> Column:
        same = lambda i, j: F.get(order, i)["w"] == F.get(order, j)["w"]
        kept = F.filter(order, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"],
        )

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))

    def placed(held: Column) -> Column:
        return F.sort_array(F.transform(held, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

    def counted(held: Column) -> Column:
        return F.when(F.size(F.array_distinct(held)) == F.size(held), F.lit(0).cast("long")).otherwise(let(let(placed(held), starts), covered))

    return let(let(words, windows), counted)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with one more column `_m`: the figures of the text and the rules it fails."""
    raw, words, m = F.coalesce(col(df, text), F.lit("")), free_name(df, "words"), free_name(df, "m")
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_lines, n_distinct = let(lines, lambda x: F.array(F.size(x), F.size(F.array_distinct(x)))), free_name(df, "lines")
    held = df.withColumn(words, pieces(raw, BLANK)).withColumn(n_distinct, n_lines)
    n = F.size(F.col(words)).cast("long")
    of = lambda x: F.element_at(F.col(n_distinct), x).cast("long")
    figures = F.struct(
        n.alias("n_words"),
        F.length(F.regexp_replace(raw, BLANK + "+", "")).cast("long").alias("word_chars"),
        (F.length(raw) - F.length(F.translate(raw, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (of(1) - of(2)).alias("n_dup_lines"),
        of(1).alias("n_lines"),
        _repeated(F.col(words)).alias("n_repeat_words"),
    )
    return held.withColumn(m, figures).drop(words, n_distinct)


def failures(m: Column) -> dict[str, Column]:
    return {
        "short": m["n_words"] < LEAST_WORDS,
        "repetitive": 100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"],
        "symbols": 100 * m["n_symbols"] > MOST_SYMBOLS * m["n_words"],
        "dup_lines": 100 * m["n_dup_lines"] > MOST_DUP_LINES * m["n_lines"],
    }


def host_verdicts(measured: DataFrame, host: str, m: str) -> DataFrame:
    """One row per host: n_docs, the shrunk rate of each rule, bad.

    Partial sums leave the tasks, so a host with a third of all rows is no
    heavier than another. The prior is one row of averages over the hosts.
    """
    fails = failures(F.col(m))
    totals = (
        measured.filter(col(measured, host).isNotNull())
        .groupBy(col(measured, host).alias("host"))
        .agg(F.count("*").alias("n_docs"), *(F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in fails.items()))
    )
    totals = cut_lineage(totals)
    rate = lambda k: F.col(k) / F.col("n_docs")
    prior = totals.agg(*(f(rate(k)).alias(f"{k}_{f.__name__}") for k in RULES for f in (F.avg, F.var_pop))).first()

    def shrunk(k: str) -> Column:
        mean, var = prior[f"{k}_avg"] or 0.0, prior[f"{k}_var_pop"] or 0.0
        # Rates that lie far apart make a weak prior; equal ones leave no variance to tell. Either way it weighs as LEAST_WEIGHT documents at least, so that no single one condemns its host.
        weight = max(mean * (1 - mean) / var - 1, LEAST_WEIGHT) if var > 1e-12 else LEAST_WEIGHT
        return (F.col(k) + mean * weight) / (F.col("n_docs") + weight)

    rates = totals.select("host", "n_docs", *(shrunk(k).alias(k) for k in RULES))
    return rates.withColumn("bad", F.greatest(*(F.col(k) for k in RULES)) > HOST_LIMIT)


def _judged(rows: DataFrame, text: str, host: str, kept: list[str]) -> tuple[DataFrame, str, str]:
    """The columns `kept` of the rows with their figures, and whether the host is bad.

    Texts are measured once: rows are stored with their figures, and hosts and verdicts read
    those. The bad hosts are stored too, so their true size decides whether Spark
    broadcasts them; beyond its limit both sides meet on (host, salt), and the
    salt, dealt by row number, cuts a hot host into pieces.
    """
    measured = measure(rows, text)
    m = measured.columns[-1]
    held = cut_lineage(measured.select(*(col(measured, c) for c in kept), m))
    hosts = cut_lineage(host_verdicts(held, host, m).filter("bad").select("host"))
    salted = hosts.select(F.col("host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt, bad = free_name(held, "salt"), free_name(held, "bad_host")
    with_salt = held.withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int"))
    marked = salted.withColumn(bad, F.lit(True))
    on = (col(with_salt, host) == marked["host"]) & (F.col(salt) == marked["salt"])
    return with_salt.join(marked, on, "left").drop(salt).drop(marked["host"], marked["salt"]), m, bad


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: the figures, base_failed, host_bad, kept."""
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"), col(docs, host).alias("host_of"))
    rows, m, bad = _judged(slim, "text", "host_of", ["doc_id", "host_of"])
    fails = failures(F.col(m))
    failed, host_bad = fails["short"] | fails["repetitive"], F.coalesce(F.col(bad), F.lit(False))
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        "doc_id", *(F.col(m)[k].alias(k) for k in figures), failed.alias("base_failed"), host_bad.alias("host_bad"), (~failed & ~host_bad).alias("kept")
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of documents that pass, with the columns they came with."""
    rows, m, bad = _judged(docs, text, host, docs.columns)
    fails = failures(F.col(m))
    return rows.filter(~(fails["short"] | fails["repetitive"]) & F.col(bad).isNull()).drop(m, bad)
