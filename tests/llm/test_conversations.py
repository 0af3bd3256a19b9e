import hashlib
import heapq
import random
import re
import zlib

import pytest

from trovelight.llm import conversations


def damaged(rows):
    """(conv_id, turn, role, text) as damage leaves them, by turn."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2], r[3]))


def cheapest(rows):
    """(cost, audit, written) by a search over whole edit strings in order of (cost, string)."""
    roles = re.compile("(s?(ua)+)?")
    queue, settled = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, written, out = heapq.heappop(queue)
        if (i, written[-1:], written[:1] == "s" and len(written) == 1) in settled:
            continue
        settled.add((i, written[-1:], written[:1] == "s" and len(written) == 1))
        if i == len(rows) + 1:
            return cost, audit, out
        if i == len(rows):
            if roles.fullmatch(written):
                heapq.heappush(queue, (cost, audit, i + 1, written, out))
        else:
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, written, out))
            if fault in (None, "truncated"):
                late = 3 * (fault == "truncated")
                heapq.heappush(queue, (cost + late, audit + "K", i + 1, written + (role[:1] or "?"), (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(queue, (cost + late + 3, audit + "R", i + 1, written + r[0], (*out, f"{r}:{text}")))
        for r in ("user", "assistant"):
            heapq.heappush(queue, (cost + 3, audit + "I", i, written + r[0], (*out, f"{r}:")))
        queue = [x for x in queue if roles.fullmatch(x[3]) or roles.fullmatch(x[3] + "a") or x[3] == "s"]
        heapq.heapify(queue)


def faults(rows):
    found, seen = [], set()
    for _, _, role, text in rows:
        ends = [c for c in text if c not in " \t\n\x0b\x0c\r"][-1:]
        found.append((role, text, "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[0] not in ".!?" else None))
        seen.add((role, text))
    return found


def brute(rows):
    out, left = [], damaged(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in left if r[0] == conv]
        turns = {r[1] for r in own} - {None}
        marked = faults(own)
        count = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, written = cheapest(marked) if own else (0, "", ())
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 11])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.5 else ["user", "assistant"][turn % 2] if turn or rng.random() < 0.6 else "system"
            role = rng.choice([role] * 9 + ["tool", "system", None, "", "User"])
            text = rng.choice(["Yes.", "No", "Why?", f"It is {conv}.", f"t{turn}!  \n", "", None, " \t", "…", "ends. "])
            rows.append((conv, rng.choice([turn] * 8 + [None, turn - 3, turn + 7]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_search(spark, seed):
    rows = talk(seed, 150) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (2**60 + 1, 2**60 + 1, "user", "Big."), (7, 3, "user", "Yes.")]
    rows += [(900, t, r, "x.") for t, r in enumerate("suauuaas")] + [(901, i, "user", "A.") for i in range(12)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", copies string").repartition(5)
    hurt = conversations.damage(frame)
    found = conversations.repair(hurt, copies="copies", spill=3)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    written = {}
    for r in sorted(conversations.repaired_rows(hurt, found, copies="copies").collect(), key=lambda r: (str(r.conv_id), r.position)):
        assert r.position == len(written.setdefault(r.conv_id, []))
        written[r.conv_id].append(f"{r.role}:{r.text}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(written.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_long_conversation(spark):
    """One conversation over many batches and files, against the search on its own."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), f"{rng.choice(['word', 'x' * 50])} {t}{rng.choice(['.', ''])}") for t in range(1500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = conversations.repair(spark.createDataFrame(rows, SCHEMA), spill=100).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    marked = faults(rows)
    cost, audit, written = cheapest(marked)
    assert (found.cost, found.audit) == (cost, audit)
    assert found.repaired_sha256 == hashlib.sha256("\n".join(written).encode()).hexdigest()


def test_steps_stay_few():
    """Differences of cost are bounded, so steps repeat however long a conversation is."""
    rng = random.Random(3)
    steps, now = conversations.Steps(), ((0, 0), None, None, None)
    for k in range(200_000):
        if k % 5000 < 2000:  # stretches of one kind
            kind = (("t", False, True), ("s", False, False), ("u", True, False), ("u", False, False))[k // 5000 % 4]
        else:
            kind = rng.choice("suat"), rng.random() < 0.3, rng.random() < 0.4
        now = steps.known[steps.take(now, *kind)][0]
    assert len(steps.known) < 5000


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    found = conversations.repair(conversations.damage(none), copies="copies")
    assert found.count() == conversations.repaired_rows(conversations.damage(none), found, copies="copies").count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    only = spark.createDataFrame([(5, dropped, "user", "Gone.")], SCHEMA)
    assert tuple(conversations.repair(conversations.damage(only), copies="copies").first()) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
