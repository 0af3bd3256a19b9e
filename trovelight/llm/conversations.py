"""Repair of conversation structure: the cheapest edits that make a conversation alternate.

Rows are dealt out by conversation and sorted by turn inside the partitions, so a
conversation of any length streams through one task. `mapInPandas` carries from
batch to batch what a dynamic program over (what the roles so far end in) needs:

* four states: nothing written yet, after a system turn, after a user turn, after an
  assistant turn. For each, the cost of its cheapest edits so far, and where these stand among each
  other in ASCII order, which settles ties: edits of equal cost that end in the
  same state cannot be prefixes of one another, as insertions cost, so the order at a row decides for good.
* a hash state for each of them, so digests of repaired texts need no second look at a text.
* backpointers: costs matter by their differences only, and a state that another is sure
  to beat is dropped, so few different steps occur. They are numbered as they appear, and a row keeps its
  step's number, two bytes. Every `SPILL` rows these go to a file in the shared folder and
  are read back from the last to the first once the conversation has ended.

Whether the same role and text stood at an earlier turn is found before, by a partial
aggregate over their digests; the few groups that span turns are stored, so Spark sees
their size when it plans the join. Equal rows of one turn meet in the sort.

Defined cases: null roles and texts are one space. Rows without a turn come first; rows of one turn
are taken by role, then text. A null conversation id is a conversation of its own. Repeated rows are duplicates. A conversation of
which no row is left gives zeros and empty edits. Empty input gives empty output. Texts of any length are hashed whole.
Columns beside the four named are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import col, shared_folder
from trovelight.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow each state by the role's initial, and what an insertion leads to.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WANTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: How much dearer than x a state y may be before x beats it for certain: from x, one writes what y would write, at this cost more.
LEAD = {
    (ASSISTANT, NONE): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3, (USER, ASSISTANT): 3, (NONE, SYSTEM): 0,
    (NONE, ASSISTANT): 0, (NONE, USER): 3, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 6,
}
#: Backpointers of a conversation that are held before they go to a file.
SPILL = 1 << 22
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Steps:
    """The steps of the dynamic program, each worked out once.

    A situation is, for each state, its cost above the least and its place in the order of
    edits, or None. A step is (next situation, what all costs rise by, for each state the state before it and the edits).
    """

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.known: list[tuple] = []

    def take(self, now: tuple, initial: str, must_go: bool, truncated: bool) -> int:
        key = now, initial if initial in ("s", "u", "a") else "", must_go, truncated
        if key not in self.number:
            self.number[key] = len(self.known)
            self.known.append(self._work_out(*key))
        return self.number[key]

    def _work_out(self, now: tuple, initial: str, must_go: bool, truncated: bool) -> tuple:
        best: list[tuple | None] = [None] * 4
        for x, held in enumerate(now):
            if held is None:
                continue
            (cost, place), y, edits = held, x, ""
            for _ in range(3):  # with up to two turns inserted before the row
                ends = [(y, DELETE, "D")]
                if not must_go:
                    if initial in NEXT[y]:
                        ends.append((NEXT[y][initial], KEEP + TRUNCATED * truncated, "K"))
                    ends.append((WANTED[y], REROLE + TRUNCATED * truncated, "R"))
                for z, more, edit in ends:
                    found = (cost + more, place, edits + edit, x)
                    if best[z] is None or found < best[z]:
                        best[z] = found
                cost, y, edits = cost + INSERT, WANTED[y], edits + "I"
        for (x, y), lead in LEAD.items():
            if best[x] and best[y] and best[y][0] > best[x][0] + lead:
                best[y] = None
        least = min(b[0] for b in best if b)
        order = sorted(b[1:3] for b in best if b)
        after = tuple(b and (b[0] - least, order.index(b[1:3])) for b in best)
        return after, least, tuple(b and (b[3], b[2]) for b in best)


class Conversation:
    """The figures and the cheapest edits of one conversation, row by row."""

    def __init__(self, name: str | None, steps: Steps, spill: int, folder: str):
        self.name, self.steps, self.spill, self.folder = name, steps, spill, folder
        self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.low = self.high = self.before = self.last = None
        self.now = ((0, 0), None, None, None)
        self.hashes = [hashlib.sha256(), None, None, None]
        self.back, self.files = array("H"), []

    def add(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.rows > 0 and self.last + initial not in ("su", "ua", "au")
        duplicate = not blank and (again or self.before == (turn, role, text))
        truncated = truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.before, self.last, self.rows = (turn, role, text), initial, self.rows + 1
        step = self.steps.take(self.now, initial, blank or duplicate, truncated)
        self.now, more, ways = self.steps.known[step]
        self.cost += more
        self.hashes = [way and self._hash(*way, z, role, text) for z, way in enumerate(ways)]
        self.back.append(step)
        if len(self.back) >= self.spill:
            self._spill()

    def _hash(self, x: int, edits: str, z: int, role: str, text: str):
        held = self.hashes[x]
        if edits == "D":
            return held
        held = held.copy()
        for edit in edits:
            if edit == "D":
                break
            to = z if edit == "K" else WANTED[x]
            written = f"{role}:{text}" if edit == "K" else f"{ROLE[to]}:{text}" if edit == "R" else f"{ROLE[to]}:"
            held.update(("\n" * (x != NONE) + written).encode())
            x = to
        return held

    def _spill(self) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root)
        self.files.append(f"{root}/{uuid4().hex}")
        with system.open_output_stream(self.files[-1]) as out:
            out.write(self.back.tobytes())
        self.back = array("H")

    def _blocks(self) -> Iterator[array]:
        yield self.back
        if self.files:
            system, _ = fs.FileSystem.from_uri(self.folder)
            for file in reversed(self.files):
                with system.open_input_stream(file) as held:
                    yield array("H", held.read())
                system.delete_file(file)

    def end(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        figures = (self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal)
        if not self.rows:
            return (*figures, 0, "", hashlib.sha256().hexdigest())
        tails = ("", "II", "I", "")
        cost, _, tail, z = min((held[0] + INSERT * len(tails[x]), held[1], tails[x], x) for x, held in enumerate(self.now) if held)
        digest = self._hash(z, tail, z, "", "").hexdigest()
        audit, known = bytearray(tail.encode()), self.steps.known
        for block in self._blocks():
            for step in reversed(block):
                z, edits = known[step][2][z]
                audit += edits[::-1].encode()
        audit.reverse()
        return (*figures, self.cost + cost, audit.decode(), digest)


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and `copies` of every row: 0 dropped, 2 repeated; some emptied, without ends of sentences, or of another role."""
    name, at = col(rows, conv_id), col(rows, turn)
    held = rows.select(
        name.alias("conv_id"), at.alias("turn"), F.coalesce(col(rows, role), F.lit(" ")).alias("role"), F.coalesce(col(rows, text), F.lit(" ")).alias("text"),
        (F.crc32(F.concat(F.coalesce(name.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(at.cast("string"), F.lit(" "))).cast("binary")) % 20).alias("kind"),
    )
    kind = F.col("kind")
    return held.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _slim(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    filled = lambda name: F.coalesce(col(rows, name), F.lit(" ")).alias
    return rows.select(col(rows, conv_id).alias("conv_id"), col(rows, turn).cast("long").alias("turn"), filled(role)("role"), filled(text)("text"), (col(rows, copies) if copies else F.lit(1)).alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """The rows with blank, truncated and `again`: the role and text stood at an earlier turn."""
    key = ("conv_id", "role", F.md5("text").alias("digest"))
    seen = rows.filter("copies > 0").groupBy(*key).agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("*").alias("n"), F.count("turn").alias("n_turns"))
    null = F.col("n_turns") < F.col("n")
    seen = cut_lineage(seen.filter((F.col("low") < F.col("high")) | (null & (F.col("n_turns") > 0))).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "digest", F.when(~null, F.col("low")).alias("low")))
    on = rows["conv_id"].eqNullSafe(F.col("c")) & (rows["role"] == F.col("r")) & (F.md5(rows["text"]) == F.col("digest"))
    again = F.col("digest").isNotNull() & F.col("turn").isNotNull() & (F.col("low").isNull() | (F.col("turn") > F.col("low")))
    return rows.join(seen, on, "left").select(
        *rows.columns, (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"), F.coalesce(again, F.lit(False)).alias("again")
    )


def _dealt(rows: DataFrame, *first: Column) -> DataFrame:
    """One conversation's rows follow each other in one partition, by turn. Ids travel as text and turns with a flag, as pandas has no integers with nulls."""
    sorted_ = rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "text")
    return sorted_.withColumns({"conv_id": F.col("conv_id").cast("string"), "no_turn": F.col("turn").isNull(), "turn": F.coalesce("turn", F.lit(0))})


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, spill: int = SPILL
) -> DataFrame:
    """One row per conversation: conv_id, the figures, audit (its edits' initials) and repaired_sha256.

    `copies` may name a column that tells how often a row stands there, 0 included.
    """
    kind = rows.schema[conv_id].dataType
    slim = _dealt(_faults(_slim(rows, conv_id, turn, role, text, copies)))
    folder = shared_folder(rows.sparkSession, "backpointers")
    names = ["conv_id", *FIGURES, "audit", "repaired_sha256"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, steps = None, Steps()
        for frame in frames:
            done = []
            columns = (frame[c].tolist() for c in ("conv_id", "turn", "no_turn", "role", "text", "copies", "blank", "truncated", "again"))
            for name, at, no_turn, who, said, n, blank, truncated, again in zip(*columns, strict=True):
                if held is None or held.name != name:
                    if held is not None:
                        done.append(held.end())
                    held = Conversation(name, steps, spill, folder)
                for _ in range(n):
                    held.add(None if no_turn else at, who, said, blank, truncated, again)
            yield pd.DataFrame(done, columns=names)
        if held is not None:
            yield pd.DataFrame([held.end()], columns=names)

    figures = ", ".join(f"{x} long" for x in FIGURES)
    found = slim.mapInPandas(run, f"conv_id string, {figures}, audit string, repaired_sha256 string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_rows(
    rows: DataFrame, audits: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None
) -> DataFrame:
    """The repaired conversations: conv_id, position, edit, role, text, by the `audit` of each in `audits` (from `repair`).

    The audit goes ahead of its conversation's rows in the same stream.
    """
    kind = rows.schema[conv_id].dataType
    slim = _slim(rows, conv_id, turn, role, text, copies).withColumn("edits", F.lit(None).cast("string"))
    ahead = audits.select(F.col("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.col("audit").alias("edits"))
    sent = _dealt(ahead.unionByName(slim), F.col("edits").isNull())
    names = ["conv_id", "position", "edit", "role", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, audit, at, state, position = None, "", 0, NONE, 0

        def inserted() -> Iterator[tuple]:
            nonlocal at, state, position
            while audit[at : at + 1] == "I":
                state, at = WANTED[state], at + 1
                yield name, position, "I", ROLE[state], ""
                position += 1

        for frame in frames:
            done = []
            for new, who, said, n, edits in zip(*(frame[c].tolist() for c in ("conv_id", "role", "text", "copies", "edits")), strict=True):
                if isinstance(edits, str):
                    done += inserted()  # what the last conversation ends with
                    name, audit, at, state, position = new, edits, 0, NONE, 0
                    continue
                for _ in range(n):
                    done += inserted()
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        continue
                    state = NEXT[state][who[:1]] if edit == "K" else WANTED[state]
                    done.append((name, position, edit, who if edit == "K" else ROLE[state], said))
                    position += 1
            yield pd.DataFrame(done, columns=names)
        done = list(inserted())
        if done:
            yield pd.DataFrame(done, columns=names)

    return sent.mapInPandas(run, "conv_id string, position long, edit string, role string, text string").withColumn("conv_id", F.col("conv_id").cast(kind))
