"""WARC archives: writing records with revisits, and a reader that salvages what damaged archives still hold.

Writing. Pages are dealt to tasks; each task writes gzip members, one per record,
into archives of bounded size in a folder that all executors share, and returns
a manifest row per finished archive. File names are new for every attempt, and
only archives of the manifest count, so a repeated or lost task leaves no double
records. Of pages with equal payloads the largest id carries the payload, the
others are revisit records that refer to it.

Reading. Every archive is read in pieces; per record the version line, the
headers, the length, the trailing blank lines and the digests are checked. After
a failed check the reader searches for the next version line that passes, in plain
archives and inside gzip members alike, goes on from there, and logs the bytes
between as a quarantined gap. Of a member of several records that breaks off or
fails its check, the records with a block digest that holds are kept, and the search
goes on for the next gzip member. Headers have no check but the member's: `checked` is
true where that holds, false where it does not, and null in plain archives. A length is
believed only where a record ends at that distance, which is looked up ahead, so a
wrong one fills no memory. Headers and records may be of any length.

Offsets. `offset` is the place of the record, or of its gzip member, in the
archive, and `inner_offset` the place in what the member unpacks to. A gap inside
a whole member counts unpacked bytes from its inner offset; every other gap counts
bytes of the archive, and an inner offset there says how far its first member was sound.

Defined cases: a null html is an empty payload; a null url gives a record without
a target, read back as null; a null page id is kept as such. Rows that share the
largest id of a payload are all responses. Empty input writes nothing and reads
back as no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm.common import col
from trovelight.session import cut_lineage

DATE = "2024-01-01T00:00:00Z"
ROTATE = 64 << 20
PIECE = 1 << 20
MAGIC = b"\x1f\x8b\x08"
MARK = b"WARC/1."
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
CONTROL = re.compile(rb"[\x00-\x08\x0a-\x0c\x0e-\x1f]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = (
    "path string, offset long, inner_offset long, checked boolean, record_id string, record_type string, target string, page_id string, refers_to string, payload_bytes long, payload_digest string, payload binary"
)
GAP = "path string, offset long, inner_offset long, n_bytes long, reason string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, 'page:' + page_id) if page_id is not None else uuid4()}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record with its payload, or a revisit record without."""
    block = b"" if refers_to is not None else HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    clean = lambda x: re.sub(r"[\r\n]+", " ", x)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else clean(url)),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to)),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        # Extension fields: ids of the table, and the length that a revisit's own block does not show.
        ("Page-ID", page_id),
        ("Page-Refers-To", refers_to),
        ("Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def decisions(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to. Only digests that occur twice or more are joined back."""
    payload = F.encode(F.coalesce(col(pages, "html"), F.lit("")), "UTF-8")
    rows = pages.select(col(pages, "page_id").alias("page_id"), col(pages, "url").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    light = rows.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n"))
    twice = cut_lineage(light.filter("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("z"), "chosen"))
    joined = rows.join(twice, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("z")), "left")
    refers = F.when(F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen")), F.col("chosen").cast("string"))
    return joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, rotate: int = ROTATE, compress: bool = True) -> DataFrame:
    """Write the archives; the manifest (path, n_records, n_bytes), itself stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = path = None
        n = size = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])], ["path", "n_records", "n_bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                if out is None:
                    path = f"{base}/{uuid4().hex}.warc" + ".gz" * compress
                    out, n, size = store.open_output_stream(path, compression=None), 0, 0
                data = record(page_id, url, payload, refers_to)
                data = member(data) if compress else data
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= rotate:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return cut_lineage(decisions(pages, least_bytes).mapInArrow(run, MANIFEST))


class Archive:
    """Bytes of a plain archive from a position on; `look` reads ahead without keeping what lies between."""

    def __init__(self, file, size: int, at: int = 0):
        self.file, self.size, self.at = file, size, at

    def _read(self, at: int, n: int) -> bytes:
        if at >= self.size:
            return b""
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def pull(self) -> bytes:
        piece = self._read(self.at, PIECE)
        self.at += len(piece)
        return piece

    def look(self, skip: int, n: int) -> bytes:
        return self._read(self.at + skip, n)

    def whole(self) -> bool:
        return True


class Member(Archive):
    """Unpacked bytes of the gzip member at a position; `fault` tells why they end early, `end` where a whole member ends."""

    def __init__(self, file, size: int, at: int):
        super().__init__(file, size, at)
        self.unpack, self.rest = zlib.decompressobj(31), b""
        self.fault: str | None = None
        self.end: int | None = None
        self._whole: bool | None = None

    def pull(self) -> bytes:
        while self.fault is None and self.end is None:
            packed = self.rest or super().pull()
            before = self.unpack.copy()
            try:
                piece = self.unpack.decompress(packed, PIECE)
            except zlib.error as e:
                self.fault = f"bad member: {str(e)[:60]}"
                return self._up_to_fault(before, packed)
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.end = self.at - len(self.unpack.unused_data)
            elif not packed and not piece:
                self.fault = "truncated member"
            if piece:
                return piece
        return b""

    @staticmethod
    def _up_to_fault(state, packed: bytes) -> bytes:
        """What still unpacks; less than a piece, as the call that failed had not reached its limit."""
        out, step = b"", len(packed) // 2
        while step:
            twin = state.copy()
            try:
                out += twin.decompress(packed[:step])
            except zlib.error:
                step //= 2
                continue
            state, packed = twin, packed[step:]
        return out

    def look(self, skip: int, n: int) -> bytes:
        """Unpacks a second time from here, dropping what it passes."""
        if self.fault is not None or self.end is not None:
            return b""
        twin, found = self._twin(), b""
        while len(found) < n and (piece := twin.pull()):
            found += piece[skip : skip + n - len(found)] if skip < len(piece) else b""
            skip = max(0, skip - len(piece))
        return found

    def whole(self) -> bool:
        """Whether the member unpacks to its end and passes its own check."""
        if self._whole is None and self.fault is None and self.end is None:
            twin = self._twin()
            while twin.pull():
                pass
            self._whole = twin.end is not None
        return self.end is not None if self._whole is None else self._whole

    def _twin(self) -> Member:
        twin = Member(self.file, self.size, self.at)
        twin.unpack, twin.rest = self.unpack.copy(), self.rest
        return twin


class Scan:
    """Records in a run of bytes: after a failed check it goes on from the next version line that passes.

    Held in memory are a piece, a header line, and a block whose end was looked at and found sound.
    """

    def __init__(self, source: Archive):
        self.source, self.buffer, self.base = source, bytearray(), 0
        self.open: tuple[int, str] | None = None  # where unsound bytes began, and why

    def _more(self) -> bool:
        piece = self.source.pull()
        self.buffer += piece
        return bool(piece)

    def _need(self, n: int) -> bool:
        while len(self.buffer) < n and self._more():
            pass
        return len(self.buffer) >= n

    def _drop(self, n: int) -> None:
        del self.buffer[:n]
        self.base += n

    def items(self) -> Iterator[tuple]:
        """("record", start, row) and ("gap", start, length, reason); a gap up to the end stays in `open`."""
        while self._need(1):
            row, used, reason = self._record()
            if reason is None:
                if self.open is not None:
                    yield "gap", self.open[0], self.base - self.open[0], self.open[1]
                    self.open = None
                yield "record", self.base, row
                self._drop(used)
            else:
                self.open = self.open or (self.base, reason)
                self._seek()

    def _seek(self) -> None:
        self._drop(1)
        while (at := self.buffer.find(MARK)) < 0:
            self._drop(max(0, len(self.buffer) - len(MARK) + 1))
            if not self._more():
                self._drop(len(self.buffer))
                return
        self._drop(at)

    def _headers(self) -> tuple[dict[str, str], int, str | None]:
        """Header fields, where the block begins, and what is wrong with a line."""
        head: dict[str, str] = {}
        key, at = None, self.buffer.find(b"\n") + 1
        while True:
            seen = at
            while (end := self.buffer.find(b"\r\n", max(at, seen - 1))) < 0:
                if CONTROL.search(self.buffer, seen):
                    return head, at, "bad header"
                seen = len(self.buffer)
                if not self._more():
                    return head, at, "no end of headers"
            line = bytes(self.buffer[at:end])
            at = end + 2
            if not line:
                return head, at, None
            name, colon, value = line.partition(b":")
            if line[:1] in b" \t" and key is not None:
                head[key] = f"{head[key]} {line.strip().decode(errors='replace')}".strip()
            elif not colon or CONTROL.search(line):
                return head, at, "bad header"
            else:
                key = name.strip().lower().decode("latin-1")
                head[key] = value.strip().decode(errors="replace")

    def _record(self) -> tuple[tuple | None, int, str | None]:
        """The record at the buffer's start and its length, or why there is none."""
        self._need(10)
        if not VERSION.match(self.buffer):
            return None, 0, "no version line"
        head, start, reason = self._headers()
        if reason:
            return None, 0, reason
        size = head.get("content-length", "")
        if not size.isascii() or not size.isdigit():
            return None, 0, "no length"
        if len(size := size.lstrip("0")) > 18:  # beyond any file
            return None, 0, "truncated block"
        stop = start + int(size or 0)
        tail = bytes(self.buffer[stop : stop + 4])
        if len(tail) < 4:
            tail += self.source.look(max(0, stop - len(self.buffer)), 4 - len(tail))
        if tail != b"\r\n\r\n" or not self._need(stop + 4):
            return None, 0, "truncated block"
        if "warc-block-digest" not in head and not self.source.whole():
            return None, 0, "no digest in a broken member"
        row, reason = described(head, bytes(self.buffer[start:stop]))
        return row, stop + 4, reason


def described(head: dict[str, str], block: bytes) -> tuple[tuple | None, str | None]:
    """The row of a record, or which of its digests differs."""
    digest = head.get("warc-block-digest")
    if digest and digest.lower().startswith("sha1:") and digest[5:] != base32_sha1(block):
        return None, "block digest differs"
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    kind, length = head.get("warc-type"), head.get("payload-length", "")
    payload_digest = head.get("warc-payload-digest", "").partition(":")[2] or None
    if kind == "response" and payload_digest and payload_digest != base32_sha1(payload):
        return None, "payload digest differs"
    # A revisit's own block is empty; all others are counted.
    said = int(length) if length.isascii() and length.isdigit() and len(length) < 19 else None
    known = said if kind == "revisit" else len(payload)
    return (head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("page-id"), head.get("page-refers-to"), known, payload_digest, payload), None


@dataclass
class Salvage:
    """Reads one archive from a seekable file; records and gaps in order."""

    path: str
    file: object
    size: int

    def items(self) -> Iterator[tuple[str, tuple]]:
        """("record", (path, offset, inner_offset, checked, ...)) and ("gap", (path, offset, inner_offset, n_bytes, reason))."""
        packed = Archive(self.file, self.size).look(0, 3) == MAGIC or self.path.endswith(".gz")
        return self._members() if packed else self._plain()

    def _plain(self) -> Iterator[tuple[str, tuple]]:
        scan = Scan(Archive(self.file, self.size))
        for kind, start, *rest in scan.items():
            yield kind, (self.path, start, None, *((None, *rest[0]) if kind == "record" else rest))
        if scan.open is not None:
            yield "gap", (self.path, scan.open[0], None, scan.base - scan.open[0], scan.open[1])

    def _members(self) -> Iterator[tuple[str, tuple]]:
        at, bad = 0, None  # bad: where the archive's unsound bytes began, inside which member, and why
        while at < self.size:
            if Archive(self.file, self.size, at).look(0, 3) != MAGIC:
                bad, at = bad or (at, None, "no gzip member"), self._next(at + 1)
                continue
            source = Member(self.file, self.size, at)
            scan, sound, held, was = Scan(source), 0, [], bad
            for kind, start, *rest in scan.items():
                if sound:
                    yield from held
                    held = []
                if bad is not None:
                    held.append(("gap", (self.path, *bad[:2], at - bad[0], bad[2])))
                    bad = None
                sound += kind == "record"
                held.append((kind, (self.path, at, start, *((source.whole(), *rest[0]) if kind == "record" else rest))))
            if source.end is None and sound == 1 and scan.open is None:
                sound, held, bad = 0, [], was  # the failed check was this record's own
            yield from held
            if source.end is None:
                inner = scan.open[0] if scan.open is not None else scan.base
                bad, at = bad or (at, inner if sound else None, source.fault), self._next(at + 1)
                continue
            if scan.open is not None and sound:
                yield "gap", (self.path, at, scan.open[0], scan.base - scan.open[0], scan.open[1])
            elif scan.open is not None:
                bad = bad or (at, None, scan.open[1])
            elif bad is not None:
                yield "gap", (self.path, *bad[:2], at - bad[0], bad[2])
                bad = None
            at = source.end
        if bad is not None:
            yield "gap", (self.path, *bad[:2], self.size - bad[0], bad[2])

    def _next(self, at: int) -> int:
        """Where the next member may begin."""
        rest = Archive(self.file, self.size, at)
        buffer = b""
        while piece := rest.pull():
            buffer = buffer[-len(MAGIC) + 1 :] + piece
            if (found := buffer.find(MAGIC)) >= 0:
                return rest.at - len(buffer) + found
        return self.size


def _read(manifest: DataFrame, folder: str, what: str, schema: str, payloads: bool) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[part.split()[1]] for part in schema.split(", ")]
        rows, held = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as file:
                    for kind, row in Salvage(path, file, file.size()).items():
                        if kind != what:
                            continue
                        if kind == "record":
                            held += len(row[-1])
                            row = row if payloads else (*row[:-1], None)
                        rows.append(row)
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield made()
                            rows, held = [], 0
        if rows:
            yield made()

    files = manifest.select("path")
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, files.rdd.getNumPartitions())).mapInArrow(run, schema)


def read_records(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives; without payloads if only their figures are wanted."""
    return _read(manifest, folder, "record", RECORD, payloads)


def read_gaps(manifest: DataFrame, folder: str) -> DataFrame:
    """The quarantined byte ranges of the manifest's archives."""
    return _read(manifest, folder, "gap", GAP, False)
