"""Packing of documents into training windows by the sum of squares of partially filled ones.

Each task packs the documents that it reads, one after the other and without a
shuffle. Whole windows are cut off a document; what is left of it, s tokens, goes
where the sum over all levels h of N(h)^2 becomes least, N(h) being the number of
open windows filled to h: into a window of some level h, which moves it to h + s or
closes it, or into a new one. N is an array by level, so one look at it prices every
choice. Ties go to the fullest level.

Documents may be cut, so two things differ from packing whole items. A task
holds at most `OPEN` open windows: where a new one would exceed that, and no
open one takes the rest of the document whole, the rest is cut to fill a window of the most
crowded level and goes on with what remains. At the end of a task the
fullest open windows are filled up with pieces of the emptiest, and the last one is
cut into windows whose lengths are powers of two, which need no padding. So every
window is full or a power of two, and few documents are cut beyond what their length asks for.

A window's number is that of its task and a count within it. A task reads its part of the table in
order, so one that runs again gives the same rows.

Token ids are those of the `tokenizers` library, asked once for each distinct word of
the texts a task reads: a blank or a line end never lies inside a token of this
vocabulary, so a text's ids are those of its words one after the other.

Defined cases: a null or empty text is a document of its end token alone. Texts of any
length are packed whole. Repeated rows, and rows with null ids, are documents of their own.
Empty input gives empty output. Columns beside the two named are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trovelight.llm.common import col, text_slices

WINDOW = 4096
END = 2
#: Windows a task holds open; bounds its memory.
OPEN = 512
#: Words whose ids a task remembers; forgetting them costs time only.
WORDS = 1 << 20
#: A word of its own between the words sent to the library; words that hold it are sent alone.
MARK = "\x01"
#: Words that the vocabulary's pattern keeps in one piece, whatever the Unicode version.
LETTERS = re.compile("[a-zß-öø-ÿ]+")


class Encoder:
    """Ids of texts, their words looked up once."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file.decode())
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = self._ids([MARK])[0]
        if len(self.mark) != 1:
            raise ValueError("the vocabulary has no token for the mark between words")
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        kinds: tuple[list[str], ...] = [], [], []
        for w in words:
            kinds[0 if LETTERS.fullmatch(w) else 2 if MARK in w else 1].append(w)
        letters, marked, alone = kinds
        flat, sizes = [self.flat], []
        # A word of letters alone ends where a token ends a word.
        for ids in self._ids([" ".join(letters[i : i + 100]) for i in range(0, len(letters), 100)]):
            sizes.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
            flat.append(ids)
        for ids in self._ids([f" {MARK} ".join(marked[i : i + 100]) for i in range(0, len(marked), 100)]):
            at = np.flatnonzero(ids == self.mark[0])
            sizes.append(np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1)
            flat.append(ids[ids != self.mark[0]])
        flat += self._ids(alone)
        size = np.concatenate([*sizes, [len(x) for x in flat[len(flat) - len(alone) :]]]).astype(np.int64)
        begin = len(self.flat) + np.cumsum(size) - size
        self.place.update(zip(letters + marked + alone, range(len(self.start), len(self.start) + len(size)), strict=True))
        self.flat = np.concatenate(flat)
        self.start, self.count = np.append(self.start, begin), np.append(self.count, size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        if len(self.place) > WORDS:
            self._forget()
        texts = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), "\n", " ")
        # A full stop or comma behind a letter is a token of its own: parted from the word, which then is met more often.
        parts = pc.split_pattern(pc.replace_substring_regex(texts, r"(\p{L})([.,]) ", r"\1 \2 "), " ")
        edges = parts.offsets.to_numpy() - parts.offsets[0].as_py() if len(parts) else np.zeros(1, np.int64)
        coded = parts.flatten().dictionary_encode()
        # The library lowers letters one by one; for plain ones that can be done before.
        words = pc.if_else(pc.string_is_ascii(coded.dictionary), pc.ascii_lower(coded.dictionary), coded.dictionary).to_pylist()
        slots = list(map(self.place.get, words))
        if None in slots:
            self._learn(list(dict.fromkeys(w for w, k in zip(words, slots, strict=True) if k is None)))
            slots = [self.place[w] if k is None else k for w, k in zip(words, slots, strict=True)]
        slot = np.array(slots, np.int64)[coded.indices.to_numpy()]
        size = self.count[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(total[-1]) + np.repeat(self.start[slot] - total[:-1], size)
        return self.flat[at], np.diff(total[edges])


class Packer:
    """Open windows by level, and the pieces of those that have closed.

    A piece is [document, start, ids]; `document` is whatever the caller tells documents apart by.
    """

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most, self.n_open, self.next = window, most, 0, 0
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # by level, windows as lists of pieces
        self.closed: list[tuple[int, list]] = []  # a window's number and its pieces

    def _close(self, pieces: list) -> None:
        self.closed.append((self.next, pieces))
        self.next += 1

    def choose(self, s: int) -> int:
        """The level to put s tokens on, 0 for a new window, or -1 if they must be cut."""
        n, full = self.level, self.window - s
        held = np.flatnonzero(n[1 : full + 1]) + 1
        price = 2 * (n[held + s] - n[held] + 1)
        if len(held) and held[-1] == full:  # such a window closes, and counts on no level
            price[-1] = 1 - 2 * n[full]
        best = len(held) - 1 - int(np.argmin(price[::-1])) if len(held) else -1
        if self.n_open < self.most and (best < 0 or 2 * n[s] + 1 < price[best]):
            return 0
        return int(held[best]) if best >= 0 else -1

    def _take(self, h: int) -> list:
        stack = self.open[h]
        pieces = stack.pop()
        if not stack:
            del self.open[h]
        self.level[h] -= 1
        self.n_open -= 1
        return pieces

    def _put(self, pieces: list, fill: int) -> None:
        if fill == self.window:
            self._close(pieces)
        else:
            self.open.setdefault(fill, []).append(pieces)
            self.level[fill] += 1
            self.n_open += 1

    def add(self, document, ids: np.ndarray) -> None:
        start, n = 0, len(ids)
        while n - start >= self.window:
            self._close([[document, start, ids[start : start + self.window]]])
            start += self.window
        while start < n:
            h = self.choose(n - start)
            if h >= 0:
                # Copied, so that an open window holds its own ids and not a whole document's.
                pieces = self._take(h) if h else []
                pieces.append([document, start, ids[start:].copy()])
                self._put(pieces, h + n - start)
                return
            h = int(np.argmax(self.level))
            room = self.window - h
            self._put([*self._take(h), [document, start, ids[start : start + room].copy()]], self.window)
            start += room

    def finish(self) -> None:
        """Close what is open without padding."""
        rest = [(h, pieces) for h in sorted(self.open) for pieces in self.open[h]]
        self.open, self.n_open = {}, 0
        self.level[:] = 0
        for h, pieces in [x for x in rest if x[0] & (x[0] - 1) == 0]:
            self._close(pieces)
        rest = [x for x in rest if x[0] & (x[0] - 1)]
        low, high = 0, len(rest) - 1
        while low < high:  # the fullest takes from the emptiest
            fill, pieces = rest[high]
            left, source = rest[low]
            while fill < self.window and source:
                document, start, ids = source.pop()
                given = min(len(ids), self.window - fill)
                if given < len(ids):  # its beginning goes, the remainder stays
                    source.append([document, start + given, ids[given:]])
                pieces.append([document, start, ids[:given]])
                fill, left = fill + given, left - given
            rest[low] = left, source
            if not source:
                low += 1
            if fill == self.window:
                self._close(pieces)
                high -= 1
            else:
                rest[high] = fill, pieces
        for fill, pieces in rest[low : high + 1]:
            while fill:
                size, part = 1 << (fill.bit_length() - 1), []
                fill -= size
                while size:
                    document, start, ids = pieces.pop(0)
                    if len(ids) > size:
                        pieces.insert(0, [document, start + size, ids[size:]])
                        ids = ids[:size]
                    part.append([document, start, ids])
                    size -= len(ids)
                self._close(part)


def pack(docs: DataFrame, file: bytes, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, most: int = OPEN, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; the ids themselves on request."""
    shared = docs.sparkSession.sparkContext.broadcast(file)  # the vocabulary file: a few megabytes, whatever the corpus
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    field = slim.schema["doc_id"]
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = f"doc_id {field.dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names) + ", ids array<int>" * with_ids

    def rows(packer: Packer, kind: pa.DataType, first: int) -> pa.RecordBatch:
        out, kept = [], []
        for number, pieces in packer.closed:
            offset = 0
            for (name, total), start, ids in pieces:
                out.append((name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, first + number, offset))
                offset += len(ids)
                if with_ids:
                    kept.append(ids.astype(np.int32))
        packer.closed = []
        columns = list(zip(*out, strict=True)) or [()] * 7
        arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])]
        if with_ids:
            arrays.append(pa.array(kept, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, *["ids"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, kind = Encoder(shared.value), Packer(window, most), None
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in text_slices(batch, 1, 1 << 23):
                ids, size = encoder.encode(part.column(1))
                stop = 0
                for name, n in zip(part.column(0).to_pylist(), size.tolist(), strict=True):
                    packer.add((name, n + 1), np.append(ids[stop : stop + n], np.uint32(end)))
                    stop += n
                yield rows(packer, kind, first)
        packer.finish()
        if packer.closed:
            yield rows(packer, kind, first)

    return slim.mapInArrow(run, schema)
