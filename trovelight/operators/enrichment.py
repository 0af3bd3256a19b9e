"""Facts, question budgets and question pools, in long form.

Pools are plain tables of (owner, text) rows, so a chunk or document with very
many facts is just many rows; nothing gathers a document's facts in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.operators.ordinals import ordinal_within

# Questions per fact and the bounds of the bounded rule.
QUESTIONS_PER_FACT = 0.5
MIN_QUESTIONS = 5
MAX_QUESTIONS = 20

# Chunk positions per placement unit of a document (see `placement_unit`).
UNIT_CHUNKS = 64


def unbounded_budget(n_facts: Column) -> Column:
    """Half the facts, rounded half to even."""
    return F.bround(n_facts * F.lit(QUESTIONS_PER_FACT)).cast("int")


def bounded_budget(n_facts: Column) -> Column:
    return F.greatest(
        F.lit(MIN_QUESTIONS), F.least(F.lit(MAX_QUESTIONS), unbounded_budget(n_facts))
    )


def score_1_to_5(value: Column) -> Column:
    """Clamp a generator's score; anything that is no number counts as 1."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(value.try_cast("int"), F.lit(1))))


def valid_fact_ids(raw: Column, n_facts: Column) -> Column:
    """Sorted distinct ids that name an existing fact."""
    ids = F.transform(raw, lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: (x >= 0) & (x < n_facts))))


def sentence_facts(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Offline fact source: a chunk's distinct sentences, in order.

    Adds ``facts``: array of (fact, key), using the key of generated facts; the
    first sentence of each non-empty key stays.
    """
    split = F.filter(T.sentences(T.collapse_space(F.col(content))), lambda s: s != "")
    keyed = chunks.withColumn("_said", split).withColumn("_keys", F.transform("_said", T.normalize))
    first = F.filter(
        F.transform("_said", lambda s, i: F.struct(s.alias("fact"), F.get("_keys", i).alias("key"))),
        lambda x, i: (x["key"] != "") & (F.array_position("_keys", x["key"]) == i + 1),
    )
    return keyed.withColumn("facts", first).drop("_said", "_keys")


def placement_unit(document_id: Column, chunk_position: Column) -> Column:
    """Chunks of a document that are scored together. A document of any length is
    cut into units of at most `UNIT_CHUNKS` chunks, so none makes a hot block."""
    return F.concat_ws(
        "#", document_id.cast("string"), F.floor(chunk_position / UNIT_CHUNKS).cast("string")
    )


def question_text(fact: Column, round_number: Column) -> Column:
    """Offline question template; later rounds over the same fact stay distinct."""
    return F.concat(F.lit("Statement "), round_number.cast("string"), F.lit(": "), fact)


def chunk_questions(chunks: DataFrame, budget: Column, pool: str) -> DataFrame:
    """`budget` questions per chunk, cycling through its facts."""
    n = F.size("facts")
    numbers = F.when((n > 0) & (budget > 0), F.sequence(F.lit(0), budget - 1))
    questions = F.transform(
        numbers,
        lambda j: F.struct(
            j.alias("number"),
            question_text(
                F.element_at("facts", (j % n + 1).cast("int"))["fact"],
                (F.floor(j / n) + 1),
            ).alias("text"),
        ),
    )
    return chunks.select(
        F.lit(pool).alias("pool"),
        "chunk_id",
        "document_id",
        "unit",
        F.inline(questions).alias("number", "text"),
    )


def document_facts(chunks: DataFrame) -> DataFrame:
    """Union of a document's chunk facts: first per key in chunk and fact order.

    Returns document_id, key, fact, chunk_position, fact_index, ordinal, n_ordinal.
    """
    facts = chunks.select(
        "document_id", "chunk_position", F.posexplode("facts").alias("fact_index", "_f")
    ).select("document_id", "chunk_position", "fact_index", "_f.fact", "_f.key")
    first = (
        facts.groupBy("document_id", "key")
        .agg(F.min(F.struct("chunk_position", "fact_index", "fact")).alias("_first"))
        .select("document_id", "key", "_first.*")
    )
    bucket = F.floor(F.col("chunk_position") / UNIT_CHUNKS)
    return ordinal_within(first, "document_id", bucket, ("chunk_position", "fact_index"))


def document_questions(facts: DataFrame, bounded: bool, pool: str) -> DataFrame:
    """Questions per document from `document_facts`, same cycling rule as for chunks."""
    n = F.col("n_ordinal")
    budget = bounded_budget(n) if bounded else unbounded_budget(n)
    turns = F.when(
        F.col("ordinal") < budget, F.sequence(F.col("ordinal"), budget.cast("long") - 1, n)
    )
    return facts.select("document_id", "ordinal", n, "fact", F.explode(turns).alias("number")).select(
        F.lit(pool).alias("pool"),
        "document_id",
        "number",
        question_text(F.col("fact"), F.floor(F.col("number") / n) + 1).alias("text"),
    )


# --- generation records -----------------------------------------------------------------------


def with_default_generation(chunks: DataFrame, generations: DataFrame) -> DataFrame:
    """Every chunk with its generation, or an empty one marked as skipped."""
    columns = [c for c in generations.columns if c not in ("chunk_id", "generation_skipped")]
    kinds = dict(generations.dtypes)
    joined = chunks.join(
        generations.select("chunk_id", *columns, F.lit(False).alias("_made")), "chunk_id", "left"
    )
    made = F.col("_made").isNotNull()

    def or_empty(name: str) -> Column:
        empty = F.array() if kinds[name].startswith("array") else F.lit(0)
        return F.when(made, F.col(name)).otherwise(empty.cast(kinds[name])).alias(name)

    return joined.select(*chunks.columns, *map(or_empty, columns), (~made).alias("generation_skipped"))


def still_to_do(
    sources: DataFrame, done: DataFrame, key: str = "chunk_id", complete: Column | None = None
) -> DataFrame:
    """Rows without a finished checkpoint row; `complete` says what counts as finished."""
    finished = done if complete is None else done.filter(complete)
    return sources.join(finished.select(key), key, "left_anti")


def skip_manifest(chunks: DataFrame, done: DataFrame) -> DataFrame:
    return still_to_do(chunks, done).select("chunk_id", "document_id", "document_title")


def reuse_generations(
    chunks: DataFrame, old_chunks: DataFrame, old_generations: DataFrame
) -> DataFrame:
    """Carry generations over to re-numbered chunks with the same place and content.

    Of old chunks that agree on all three columns, the one written last counts.
    """
    place = ["document_id", "chunk_position", "content"]
    newest = old_chunks.groupBy(*place).agg(F.max_by("chunk_id", "row_number").alias("_old"))
    renamed = old_generations.withColumnRenamed("chunk_id", "_old")
    matched = chunks.select("chunk_id", *place).join(newest, place).join(renamed, "_old")
    own = F.array("chunk_id")
    for pool in ("bounded_questions", "unbounded_questions"):
        matched = matched.withColumn(
            pool, F.transform(pool, lambda q: q.withField("supporting_chunk_ids", own))
        )
    return matched.select("chunk_id", *[c for c in old_generations.columns if c != "chunk_id"])


def pool_quality(counts: DataFrame, *keys: str, n: str = "n_questions") -> DataFrame:
    """Question statistics per pool from one row per owner with its question count."""
    return counts.groupBy(*keys).agg(
        F.sum(n).alias("generated_questions"),
        F.min(n).alias("questions_min"),
        F.avg(n).alias("questions_mean"),
        F.max(n).alias("questions_max"),
        F.count_if(F.col(n) > 0).alias("owners_with_questions"),
        F.count_if(F.col(n) == 0).alias("owners_without_questions"),
    )


def flatten_questions(generations: DataFrame, pool: str, owner: str = "chunk_id") -> DataFrame:
    """Question rows (owner, position, text) out of a nested generation record."""
    return generations.select(
        F.col(owner).alias("owner"), F.posexplode(pool).alias("position", "_q")
    ).select("owner", "position", F.col("_q.question").alias("text"))
