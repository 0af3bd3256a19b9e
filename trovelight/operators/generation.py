"""Model-generated facts and questions as staged plans.

A retry state is a table: one row per list of questions still to be completed, with its
text, facts, budget and the questions accepted so far. Each attempt is one plan over the
rows that are not complete: the prompt is a Column expression, the model call one Pandas UDF,
and checks, ids, duplicates and budgets are Column functions again. The new state is stored
before the next attempt reads it, so no call is ever paid for twice and a lost executor costs its own rows.

A failing call leaves its row as it was, with the failure beside it; other rows go on.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from functools import reduce
from itertools import islice
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.functions import text as T
from trovelight.functions.embedding import with_retries
from trovelight.functions.similarity import (
    FACT_DUPLICATE,
    QUESTION_DUPLICATE,
    QUESTION_DUPLICATE_RETRY,
    fresh_positions,
)
from trovelight.operators.enrichment import bounded_budget, score_1_to_5, unbounded_budget, valid_fact_ids
from trovelight.session import cut_lineage

# Sampling seed, attempts to complete a list.
SEED = 42
ATTEMPTS = 3

CALLS = 256  # prompts and answers held as Python strings at a time

FACTS_TASK = (
    "List every distinct atomic fact the text states. Leave out headings, opinion and "
    'inference. Answer with JSON {"facts":[{"fact":"","evidence":"verbatim quote",'
    '"importance":1,"distinctiveness":1}]}; both scores go from 1 to 5.'
)
QUESTIONS_TASK = (
    "Write the requested number of different retrieval questions that the text alone "
    'answers. Answer with JSON {"questions":[{"question":"","source_fact_ids":[0]}]}.'
)

FACT_TYPE = "array<struct<fact:string,evidence:string,importance:int,distinctiveness:int>>"
QUESTION_TYPE = (
    "array<struct<question:string,source_fact_ids:array<int>,supporting_chunk_ids:array<string>>>"
)

class Generator(Protocol):
    """One JSON answer per call; `seed` varies between attempts."""

    def __call__(self, task: str, content: str, seed: int) -> dict: ...


class SentenceGenerator:
    """Offline generator: sentences become facts, facts become questions."""

    def __call__(self, task: str, content: str, seed: int) -> dict:
        if task == FACTS_TASK:
            found = [s for s in re.split(r"(?<=[.!?])\s+", " ".join(content.split())) if s]
            return {"facts": [{"fact": s, "evidence": s} for s in found]}
        listed = re.findall(r"(?m)^\[(\d+)\] (.*)$", content)
        wanted = int(re.findall(r"(\d+) questions", content)[-1])
        attempt = seed - SEED
        offered = (
            {"question": self._ask(fact, turn), "source_fact_ids": [number]}
            for turn in range(wanted + ATTEMPTS)
            for number, fact in listed
        )
        unused = (q for q in offered if q["question"] not in content)
        return {"questions": list(islice(unused, attempt * wanted, (attempt + 1) * wanted))}

    @staticmethod
    def _ask(fact: str, turn: int) -> str:
        """A fact as a question; each turn begins at another word of it."""
        words = fact.split()
        at = turn * len(words) // 5 % len(words)
        return f"{turn + 1}: what of {' '.join(words[at:] + words[:at])}?"


class ChatGenerator:
    """Chat endpoint behind a plain `send(messages, temperature, seed) -> str`."""

    def __init__(self, send, temperature: float = 0.3, attempts: int = 6, pause=time.sleep):
        self.send, self.temperature, self.attempts, self.pause = send, temperature, attempts, pause

    def __call__(self, task: str, content: str, seed: int) -> dict:
        tries = iter(range(self.attempts))

        def once() -> dict:
            attempt = next(tries)
            note = "\nReturn a single valid JSON object." if attempt else ""
            messages = [
                {"role": "system", "content": task},
                {"role": "user", "content": content + note},
            ]
            return parse_reply(self.send(messages, self.temperature, seed + attempt))

        return with_retries(once, self.attempts, jitter=1.0, pause=self.pause)


def parse_reply(reply: str) -> dict:
    """JSON object of a reply with optional reasoning, fences or surrounding text."""
    text = re.sub(r"(?s)<think>.*?</think>", "", reply or "")
    text = re.sub(r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    spans = [text, *re.findall(r"(?s)\{.*\}", text)]
    for span in spans:
        try:
            value = json.loads(span)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
        break
    raise ValueError("reply holds no JSON object")


# --- the model call, and what decides on its answers -------------------------------------------


def answered(rows: DataFrame, generator: Generator, task: str, seed: int, prompt: Column) -> DataFrame:
    """The rows with the model's `answer` to their prompt, as JSON text, or the `failure` of the call.

    The caller stores what it makes of them at once, so that no call is made twice. Texts and answers
    are Python strings for `CALLS` rows at a time.
    """
    kind = pa.struct([("answer", pa.string()), ("failure", pa.string())])

    @F.arrow_udf("answer string, failure string")
    def call(prompts: pa.Array) -> pa.Array:
        parts = [pa.array([], kind)]
        for low in range(0, len(prompts), CALLS):
            out = []
            for text in prompts.slice(low, CALLS).to_pylist():
                try:
                    out.append({"answer": json.dumps(generator(task, text, seed)), "failure": None})
                except Exception as problem:  # kept with its row
                    out.append({"answer": None, "failure": str(problem) or type(problem).__name__})
            parts.append(pa.array(out, kind))
        return pa.concat_arrays(parts)

    asked = rows.withColumn("_reply", call.asNondeterministic()(prompt))
    return asked.select(*rows.columns, "_reply.answer", "_reply.failure")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once a row, also where lambdas over arrays refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fresh(items: Column, text: str, limit: float, near: bool, accepted: Column | None = None) -> Column:
    """Items whose text repeats neither an earlier one nor an accepted one; `near` counts similar texts as repeats."""
    before = F.transform(accepted, lambda x: T.normalize(x[text])) if accepted is not None else F.array().cast("array<string>")
    if near:
        keys = F.transform(items, lambda x: T.normalize(x[text]))

        @F.pandas_udf("array<int>")
        def kept(new: pd.Series, old: pd.Series) -> pd.Series:
            return pd.Series([fresh_positions(list(n), limit, list(o)) for n, o in zip(new, old, strict=True)])

        return F.transform(kept(keys, before), lambda i: F.get(items, i))
    # Accepted keys come as -1, before the places of their repeats; the first place of a key is fresh.
    old = F.transform(before, lambda k: F.struct(k.alias("key"), F.lit(-1).alias("at")))

    def unrepeated(held: Column) -> Column:
        new = F.transform(held, lambda x, i: F.struct(T.normalize(x[text]).alias("key"), i.alias("at")))
        places = bound(
            F.array_sort(F.concat(old, new)),
            lambda marks: F.filter(marks, lambda m, i: (m["key"] != "") & (m["at"] >= 0) & ((i == 0) | (F.get(marks, i - 1)["key"] != m["key"]))),
        )
        return F.transform(F.array_sort(F.transform(places, lambda m: m["at"])), lambda i: F.get(held, i))

    return bound(items, unrepeated)


def stated_facts(answer: Column, near: bool) -> Column:
    """Facts of an answer that quote their text, trimmed and with scores from 1 to 5, without repeats."""
    raw = F.from_json(answer, "facts array<struct<fact:string,evidence:string,importance:string,distinctiveness:string>>")["facts"]
    trimmed = F.transform(
        F.coalesce(raw, F.array().cast("array<struct<fact:string,evidence:string,importance:string,distinctiveness:string>>")),
        lambda x: F.struct(
            T.trim_space(x["fact"]).alias("fact"), T.trim_space(x["evidence"]).alias("evidence"),
            score_1_to_5(x["importance"]).alias("importance"), score_1_to_5(x["distinctiveness"]).alias("distinctiveness"),
        ),
    )
    return fresh(F.filter(trimmed, lambda x: x["evidence"] != ""), "fact", FACT_DUPLICATE, near)


def with_facts(texts: DataFrame, generator: Generator, near: bool = True) -> DataFrame:
    """`texts` (owner, content, ...) with their facts; those that gave none are asked again, then carry a failure. All parts are stored."""
    columns, done, rest = texts.columns, [], texts
    for _ in range(ATTEMPTS):
        found = cut_lineage(answered(rest, generator, FACTS_TASK, SEED, F.col("content")).withColumn("facts", stated_facts(F.col("answer"), near)).drop("answer"))
        done.append(found.filter(F.size("facts") > 0).withColumn("failure", F.lit(None).cast("string")))
        rest = found.filter(F.size("facts") == 0)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        last, rest = rest, rest.select(*columns)
    reason = F.coalesce("failure", F.concat(F.lit("no facts for "), "owner"))
    return reduce(DataFrame.unionByName, [*done, last.withColumn("failure", reason)])


def fact_texts() -> Column:
    return F.transform("facts", lambda f: F.struct(f["fact"].alias("fact")))


def question_prompt() -> Column:
    """What is asked for a row of the retry state: after the first attempt also what not to repeat, and the facts without a question."""
    numbered = F.transform("facts", lambda f, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), f["fact"]))
    covered = F.flatten(F.transform("accepted", lambda q: q["source_fact_ids"]))
    open_ids = F.array_except(F.transform("facts", lambda _, i: i), covered)
    missing = (F.col("budget") - F.size("accepted")).cast("string")
    again = F.concat(
        F.lit("Do not repeat:\n"), F.array_join(F.transform("accepted", lambda q: q["question"]), "\n"),
        F.lit("\nFacts not covered yet: ["), F.array_join(F.transform(open_ids, lambda i: i.cast("string")), ", "), F.lit("]\n"),
    )
    return F.concat(
        F.when(F.size("accepted") > 0, again).otherwise(""), F.lit("Text:\n"), "content",
        F.lit("\n\nFacts:\n"), F.array_join(numbered, "\n"), F.lit("\n\nWrite "), missing, F.lit(" questions."),
    )


def offered_questions(answer: Column, n_facts: Column, supporting: Column) -> Column:
    """Questions of an answer that name facts that exist."""
    raw = F.from_json(answer, "questions array<struct<question:string,source_fact_ids:array<string>>>")["questions"]
    trimmed = F.transform(
        F.coalesce(raw, F.array().cast("array<struct<question:string,source_fact_ids:array<string>>>")),
        lambda x: F.struct(
            T.trim_space(x["question"]).alias("question"),
            F.coalesce(valid_fact_ids(x["source_fact_ids"], n_facts), F.array().cast("array<int>")).alias("source_fact_ids"),
            supporting.alias("supporting_chunk_ids"),
        ),
    )
    return F.filter(trimmed, lambda x: (x["question"] != "") & (F.size(x["source_fact_ids"]) > 0))


def completed(wanted: DataFrame, generator: Generator, near: bool = True) -> DataFrame:
    """`wanted` (content, facts, supporting, budget, ...) with `accepted`, exactly `budget` questions, and why a list is shorter.

    Each attempt is one plan over the lists that are not complete. Of facts the state holds the texts alone, and
    once a list is complete neither these nor the content.
    """
    wanted = wanted.withColumn("facts", fact_texts())
    state, done = wanted.withColumn("accepted", F.array().cast(QUESTION_TYPE)).withColumn("failure", F.lit(None).cast("string")), []
    for attempt in range(ATTEMPTS):
        complete = F.size("accepted") >= F.col("budget")
        done.append(state.filter(complete).withColumn("failure", F.lit(None).cast("string")))
        rest = state.filter(~complete)
        if attempt and rest.isEmpty():
            break
        asked = answered(rest.drop("failure"), generator, QUESTIONS_TASK, SEED + attempt, question_prompt())
        limit = QUESTION_DUPLICATE_RETRY if attempt else QUESTION_DUPLICATE
        offered = asked.withColumn("_offered", offered_questions(F.col("answer"), F.size("facts"), F.col("supporting")))
        more = fresh(F.col("_offered"), "question", limit, near, F.col("accepted"))
        grown = offered.withColumn("accepted", F.slice(F.concat("accepted", more), 1, F.col("budget"))).drop("_offered", "answer")
        state = cut_lineage(grown.withColumns({c: F.when(~complete, F.col(c)) for c in ("content", "facts")}), codec="zstd")
    else:
        short = F.concat(F.size("accepted").cast("string"), F.lit(" of "), F.col("budget").cast("string"), F.lit(" questions"))
        done.append(state.withColumn("failure", F.when(F.size("accepted") < F.col("budget"), F.coalesce("failure", short))))
    return reduce(DataFrame.unionByName, done)


# --- records -----------------------------------------------------------------------------------


def _only_complete(records: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """Where a record has an error, nothing but `kept` and the error."""
    return records.select(*(c if c in (*kept, "error") else F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in records.columns))


def generate_chunks(todo: DataFrame, generator: Generator, near: bool = True) -> DataFrame:
    """Generation record per chunk; a failed row carries only its id and the error.

    Where both budgets agree, the pools share one list of questions.
    """
    found = with_facts(todo.select(F.col("chunk_id").alias("owner"), "content"), generator, near)
    n = F.size("facts")
    budgets = found.withColumns({"unbounded_budget": unbounded_budget(n), "bounded_budget": bounded_budget(n), "supporting": F.array("owner")})
    pools = F.array(
        F.struct(F.lit("unbounded").alias("pool"), F.col("unbounded_budget").alias("budget")),
        F.struct(F.lit("bounded").alias("pool"), F.col("bounded_budget").alias("budget")),
    )
    needed = F.filter(pools, lambda p: (p["pool"] == "unbounded") | (p["budget"] != F.col("unbounded_budget")))
    wanted = budgets.filter("failure IS NULL").select("owner", "content", "facts", "supporting", F.inline(needed))
    made = completed(wanted, generator, near)
    lists = made.groupBy("owner").agg(
        *(F.first(F.when(F.col("pool") == p, F.col("accepted")), ignorenulls=True).alias(p) for p in ("unbounded", "bounded")), F.first("failure", ignorenulls=True).alias("_short")
    )
    records = budgets.join(lists, "owner", "left").select(
        F.col("owner").alias("chunk_id"), n.alias("n_distinct_facts"), "unbounded_budget", "bounded_budget", "facts",
        F.coalesce("bounded", "unbounded").alias("bounded_questions"), F.col("unbounded").alias("unbounded_questions"), F.coalesce("failure", "_short").alias("error"),
    )
    return _only_complete(records, ("chunk_id",))


def generate_articles(todo: DataFrame, generator: Generator, bounded: bool = True, near: bool = True) -> DataFrame:
    """The same per document, from the facts of its chunks; documents without any are asked for facts first.

    A failed document keeps its id, title and chunks beside the error, so that callers can tell placeholders from results.
    """
    rows = cut_lineage(
        todo.select(F.col("article_id").alias("owner"), "title", "content", F.col("chunk_ids").alias("supporting"), fact_texts().alias("facts")), codec="zstd"
    )
    known = rows.filter(F.size("facts") > 0).withColumn("failure", F.lit(None).cast("string"))
    asked = with_facts(rows.filter("facts IS NULL OR size(facts) = 0").drop("facts"), generator, near)
    found = known.unionByName(asked.withColumn("facts", fact_texts())).withColumn("n_facts", F.size("facts"))
    n = F.col("n_facts")
    budgets = found.withColumn("budget", bounded_budget(n) if bounded else unbounded_budget(n))
    failed = budgets.filter("failure IS NOT NULL").withColumn("accepted", F.lit(None).cast(QUESTION_TYPE))
    made = completed(budgets.filter("failure IS NULL").drop("failure"), generator, near).unionByName(failed)
    records = made.select(
        F.col("owner").alias("article_id"), "title", F.col("supporting").alias("chunk_ids"), n.alias("n_distinct_article_facts"),
        F.col("budget").alias("question_budget"), F.col("accepted").alias("questions"), F.col("failure").alias("error"),
    )
    return _only_complete(records, ("article_id", "title", "chunk_ids"))


def results_and_placeholders(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished records, and for the failed ones a record without questions that says why."""
    failed = made.filter("error IS NOT NULL")
    counts = {c: F.lit(0) for c, kind in made.dtypes if kind == "int"}
    lists = {c: F.array().cast(kind) for c, kind in made.dtypes if c.endswith("questions") or c == "facts"}
    return made.filter("error IS NULL").drop("error"), failed.withColumns(counts | lists)


def until_complete(sources: DataFrame, key: str, load, save, generate, rounds: int = 10) -> None:
    """Generate what is missing, store successes, repeat until nothing is missing.

    `load()` reads the checkpoint, `save(df)` appends to it. Failures are not
    stored, so the next round retries exactly those.
    """
    for _ in range(rounds):
        todo = sources.join(load().select(key), key, "left_anti")
        if todo.isEmpty():
            return
        save(generate(todo).filter("error IS NULL").drop("error"))
    if not sources.join(load().select(key), key, "left_anti").isEmpty():
        raise RuntimeError(f"rows without a generation after {rounds} rounds")
