"""Personal data: patterns of four kinds, and a conditional random field over word shapes for what they miss.

The patterns give the base spans. A linear-chain CRF over the shapes of the
words of a line, trained on a small labelled table and decoded by Viterbi in
NumPy batches, adds spans of the same kinds in other dress: phone numbers without
a country code, addresses spelled with "at" and "dot", cards in groups parted by
dots. Added spans never touch base spans, and only lines with a digit, an
at sign or a spelled dot are decoded: without one there is nothing to label.

Defined cases: a null text is empty and has no spans. Repeated rows come back as
often as they stand; empty input gives empty output; very long texts and lines
are worked through whole. Other columns, whatever their names, are kept by `mask`
and dropped by `find`.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from trovelight.llm import crf
from trovelight.llm.common import col

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract, apart from the part of an address before its at sign.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# A match begins where a run of digits does, and takes runs whole; saying so keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
SPELLED = re.compile(r"(?i)\bdot\b")
WORD = re.compile(r"[^\s]+")
EDGE = "\"'`,;:!?()[]{}<>.|"

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Addresses from their at signs: the characters before one run back to the last match at most, so the search stays linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), "email"
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The contract's matches, by start and then kind."""
    found = list(_emails(text))
    if DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> str:
    """Digits as 9, letters as a or A, runs cut at three; other characters stand."""
    out = "".join("9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1{2,}", r"\1\1\1", out)


#: Words that the field may read as such.
NEAR = frozenset("at dot call phone tel mobile fax mail email e-mail contact card visa account ip host server address version page chapter year figure total (at) [at] (dot) [dot]".split())


def _one(word: str) -> tuple[str, str, str, str]:
    bare, n = word.strip(EDGE), len(_digits(word))
    low = bare.lower()
    return shape(word), "n" + str(min(n, 12)), low if low in NEAR or word.lower() in NEAR else "-", "l" + str(min(len(bare), 20) // 2)


SLOTS = 11


def features(words: list[str]) -> list[list[str]]:
    own = [_one(w) for w in words]
    pad = ("^", "n-", "^", "l-")
    out = []
    for i, (s, n, w, size) in enumerate(own):
        b, a = own[i - 1] if i else pad, own[i + 1] if i + 1 < len(own) else pad
        bb, aa = own[i - 2] if i > 1 else pad, own[i + 2] if i + 2 < len(own) else pad
        out.append(["s" + s, n, "w" + w, size, "b" + b[0], "bw" + b[2], "a" + a[0], "aw" + a[2], "bb" + bb[2] + b[2], "aa" + a[2] + aa[2], "ns" + b[1] + a[1]])
    return out


def labelled(n: int = 500, seed: int = 11) -> tuple[list[list[str]], list[list[str]]]:
    """The training table: lines of words with labels, made from patterns of personal data and of harmless numbers."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    pick = r.choice

    def personal() -> tuple[str, list[str]]:
        return pick(
            [
                lambda: ("phone", [f"({d(3)})", f"{d(3)}-{d(4)}"]),
                lambda: ("phone", [f"{d(3)}-{d(3)}-{d(4)}"]),
                lambda: ("phone", [f"{d(3)}.{d(3)}.{d(4)}"]),
                lambda: ("phone", ["+" + d(1), f"({d(3)})", f"{d(3)}-{d(4)}"]),
                lambda: ("phone", ["+" + d(2), d(2), d(3), d(4)]),
                lambda: ("phone", [f"00{d(2)}", d(3), d(3), d(4)]),
                lambda: ("email", [name(), pick(["at", "(at)", "[at]"]), name(), pick(["dot", "(dot)", "[dot]"]), pick(["com", "org", "net", "de"])]),
                lambda: ("email", [f"{name()}.{d(2)}@{name()}{d(1)}.{name()}.com"]),
                lambda: ("email", [f"{name()}@{name()}.org"]),
                lambda: ("card", [d(4), d(4), d(4), d(4)]),
                lambda: ("card", [f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"]),
                lambda: ("card", [d(16)]),
                lambda: ("card", [f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"]),
                lambda: ("ip", [".".join(str(r.randint(1, 255)) for _ in range(4))]),
                lambda: ("ip", [".".join(str(r.randint(1, 255)) for _ in range(4)) + ":" + d(4)]),
            ]
        )()

    def harmless() -> list[str]:
        return pick(
            [
                lambda: [d(4)],
                lambda: [d(r.randint(1, 3))],
                lambda: [f"{d(4)}-{d(2)}-{d(2)}"],
                lambda: [f"{d(2)}/{d(2)}/{d(4)}"],
                lambda: [f"{d(2)}.{d(2)}.{d(4)}"],
                lambda: [f"{d(2)}:{d(2)}:{d(2)}"],
                lambda: ["$" + d(3) + "," + d(3)],
                lambda: [d(2) + "." + d(1) + "%"],
                lambda: ["version", f"{d(1)}.{d(1)}.{d(2)}"],
                lambda: ["v" + d(1) + "." + d(1)],
                lambda: [pick(["password=", "id=", "sha", "key:"]) + "".join(pick("0123456789abcdef") for _ in range(r.randint(8, 40)))],
                lambda: ["token", "=", '"' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"'],
                lambda: ["page", d(2), "of", d(3)],
                lambda: [d(r.randint(5, 7))],
                lambda: [d(1), d(3), d(3)],
                lambda: ["dot", name()],
                lambda: ["at", name(), name()],
                lambda: ["@" + name()],
                lambda: [name() + d(2)],
                lambda: ["AB-" + d(6)],
                lambda: ["".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(r.randint(12, 20)))],
                lambda: ["978-" + d(1) + "-" + d(4) + "-" + d(4) + "-" + d(1)],
            ]
        )()

    lines, tags = [], []
    for _ in range(n):
        words: list[str] = []
        marks: list[str] = []
        for _ in range(r.randint(1, 3)):
            filler = [pick([name(), name().title(), name() + pick(",.;")]) for _ in range(r.randint(0, 6))]
            words += filler
            marks += ["O"] * len(filler)
            if r.random() < 0.45:
                kind, parts = personal()
                if r.random() < 0.3:
                    parts = [*parts[:-1], parts[-1] + pick(",.;")]
                words += parts
                marks += ["B-" + kind] + ["I-" + kind] * (len(parts) - 1)
            else:
                parts = harmless()
                words += parts
                marks += ["O"] * len(parts)
        lines.append(words)
        tags.append(marks)
    return lines, tags


LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


@lru_cache(maxsize=1)
def model() -> crf.Model:
    """Trained once per process from the labelled table; its size is fixed, so its training costs the same for any corpus."""
    lines, tags = labelled()
    return crf.train([features(x) for x in lines], tags, LABELS)


def _plausible(found: str, kind: str) -> bool:
    """What a span of a kind needs besides its label: an at sign or spelled words, or as many digits or parts as the kind has."""
    n = len(_digits(found))
    if kind == "email":
        return "@" in found or len(found.split()) >= 5 and bool(SPELLED.search(found))
    return found.count(".") >= 3 and n >= 4 if kind == "ip" else 12 <= n <= 19 if kind == "card" else 7 <= n <= 15


def _added(words: list[re.Match], tags: list[str], offset: int, text: str) -> Iterator[Span]:
    i = 0
    while i < len(tags):
        if tags[i] == "O":
            i += 1
            continue
        kind, j = tags[i][2:], i + 1
        while j < len(tags) and tags[j] == "I-" + kind:
            j += 1
        start, end = offset + words[i].start(), offset + words[j - 1].end()
        while start < end and text[start] in EDGE and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        if start < end and _plausible(text[start:end], kind):
            yield start, end, kind
        i = j


def spans_of(texts: list[str], trained: crf.Model) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    base, lines = [base_spans(t) for t in texts], []
    for k, text in enumerate(texts):
        if "@" in text or DIGIT.search(text) or SPELLED.search(text):
            at = 0
            for line in text.split("\n"):
                if "@" in line or DIGIT.search(line) or SPELLED.search(line):
                    if words := list(WORD.finditer(line)):
                        lines.append((k, at, words))
                at += len(line) + 1
    added: list[list[Span]] = [[] for _ in texts]
    for a in range(0, len(lines), 2000):
        some = lines[a : a + 2000]
        for (k, at, words), tags in zip(some, crf.decode([features([w[0] for w in ws]) for _, _, ws in some], trained, SLOTS), strict=True):
            added[k] += _added(words, tags, at, texts[k])
    out = []
    for own, more in zip(base, added, strict=True):
        taken, kept, i, reach = sorted(own), [], 0, 0
        for span in sorted(more):
            while i < len(taken) and taken[i][0] < span[1]:
                reach, i = max(reach, taken[i][1]), i + 1
            # `reach` is where base spans that start before this one's end stop.
            if span[0] >= reach:
                kept.append(span)
        out.append((own, kept))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; spans that overlap are covered together."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `base`, `added`: arrays of (start, end, kind), code points, end exclusive."""
    trained = model()
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = spans_of([x or "" for x in batch.column(1).to_pylist()], trained)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rows(b) for b, _ in found], span), pa.array([rows(a) for _, a in found], span)], ["doc_id", "base", "added"])

    one = "array<struct<start:int,end:int,kind:string>>"
    return slim.mapInArrow(run, f"doc_id {kind}, base {one}, added {one}")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns; in the text each span is replaced by its kind in brackets. Null stays null."""
    trained, at = model(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = spans_of([x or "" for x in texts], trained)
            new = [None if t is None else masked(t, b + a) for t, (b, a) in zip(texts, found, strict=True)]
            columns = [pa.array(new, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
