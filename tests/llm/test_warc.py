import gzip
import io
import random
import re

import pytest

from trovelight.llm import warc
from trovelight.llm.common import shared_folder

PAGES = [(str(i), f"https://x/{i}", f"<p>{'é' * i} page {i}</p>".encode()) for i in range(12)]


def archive(compress):
    parts = [warc.record(i, u, p, None) for i, u, p in PAGES]
    return [warc.member(p) if compress else p for p in parts]


def salvaged(data, path):
    found = list(warc.Salvage(path, io.BytesIO(data), len(data)).items())
    return [r[1][7] for r in found if r[0] == "record"], [r[1] for r in found if r[0] == "gap"]


@pytest.mark.parametrize("compress", [True, False])
def test_sound_archive(compress):
    parts = archive(compress)
    ids, gaps = salvaged(b"".join(parts), "a.warc" + ".gz" * compress)
    assert ids == [i for i, _, _ in PAGES] and gaps == []
    if compress:
        assert gzip.decompress(b"".join(parts)) == b"".join(archive(False))


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_only_what_it_touches(compress):
    rng, parts = random.Random(4), archive(compress)
    starts = [sum(map(len, parts[:k])) for k in range(13)]
    for trial in range(60):
        data, hurt = bytearray(b"".join(parts)), rng.randrange(12)
        # Plain headers carry no check of their own: damage the blocks.
        head = 12 if compress else parts[hurt].find(b"\r\n\r\n") + 4
        at = rng.randrange(starts[hurt] + head, starts[hurt + 1] - 4)
        kind = trial % 3
        if kind == 0:
            data[at] ^= 0x55
        elif kind == 1:
            del data[at : at + 3]
        else:
            data[at:at] = b"junk " * 5
        ids, gaps = salvaged(bytes(data), "a.warc" + ".gz" * compress)
        others = [i for i, _, _ in PAGES if i != str(hurt)]
        assert [i for i in ids if i != str(hurt)] == others
        if str(hurt) not in ids:
            assert len(gaps) == 1 and gaps[0][1] == starts[hurt]
            assert gaps[0][3] == starts[hurt + 1] - starts[hurt] + len(data) - starts[-1]


def test_truncated_and_foreign():
    data = b"".join(archive(True))
    ids, gaps = salvaged(data[:-5], "a.warc.gz")
    assert ids == [i for i, _, _ in PAGES[:-1]] and len(gaps) == 1
    assert salvaged(b"no archive at all", "a.warc.gz") == ([], [("a.warc.gz", 0, None, 17, "no gzip member")])
    assert salvaged(b"", "a.warc") == ([], [])


def hundred(size=20):
    rng = random.Random(1)
    return [warc.record(str(i), f"https://x/{i}", rng.randbytes(size).hex().encode(), None) for i in range(100)]


@pytest.mark.parametrize("compress", [True, False])
def test_one_bad_record_of_a_hundred(compress):
    parts = hundred()
    parts[41] = parts[41].replace(b"HTTP/1.1 200 OK", b"HTTP/1.1 200 KO")
    at, whole = sum(map(len, parts[:41])), b"".join(parts)
    ids, gaps = salvaged(warc.member(whole) if compress else whole, "a.warc" + ".gz" * compress)
    assert ids == [str(i) for i in range(100) if i != 41]
    where = (0, at) if compress else (at, None)
    assert gaps == [("a.warc" + ".gz" * compress, *where, len(parts[41]), "block digest differs")]


def test_broken_member_keeps_what_came_before():
    parts, rng = hundred(2000), random.Random(2)
    first, last = warc.member(b"".join(parts[:60])), warc.member(b"".join(parts[60:]))
    short = first[: len(first) // 2]
    ids, gaps = salvaged(short + last, "a.warc.gz")
    assert ids[:20] == [str(i) for i in range(20)] and ids[-40:] == [str(i) for i in range(60, 100)]
    assert len(gaps) == 1 and gaps[0][1] == 0 and gaps[0][2] > 0 and gaps[0][3] == len(short)
    ids, gaps = salvaged(last + short, "a.warc.gz")
    assert ids[:60] == [str(i) for i in [*range(60, 100), *range(20)]] and gaps[0][1] == len(last)
    for _ in range(30):  # a flipped byte anywhere: no payload invented, the other member whole
        data = bytearray(first + last)
        data[rng.randrange(12, len(first) - 8)] ^= 0x21
        found = list(warc.Salvage("a.warc.gz", io.BytesIO(data), len(data)).items())
        records = [r for k, r in found if k == "record"]
        assert [r[7] for r in records if r[3]] == [str(i) for i in range(60, 100)] and records[-40:] == [r for r in records if r[3]]
        assert all(any(r[-1] in part for part in parts) for r in records) and len(records) < len(found)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("wrong", [3, 10**7, 10**30])
def test_wrong_length_fills_no_memory(compress, wrong):
    parts = hundred(60_000)
    parts[7] = re.sub(rb"Content-Length: [0-9]+\r\n\r\n", b"Content-Length: %d\r\n\r\n" % wrong, parts[7], count=1)
    whole = b"".join(parts)
    data = warc.member(whole) if compress else whole
    held, drop = [0], warc.Scan._drop

    def watch(self, n):
        held[0] = max(held[0], len(self.buffer))
        drop(self, n)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(warc.Scan, "_drop", watch)
        ids, gaps = salvaged(data, "a.warc" + ".gz" * compress)
    assert ids == [str(i) for i in range(100) if i != 7] and len(gaps) == 1
    assert held[0] < 3 * warc.PIECE < len(whole) / 3


@pytest.mark.parametrize("compress", [True, False])
def test_long_records_and_long_headers(compress):
    rng = random.Random(3)
    payload, url = rng.randbytes(5 * warc.PIECE), "https://x/" + "y" * 200_000
    parts = [warc.record("0", url, payload, None), warc.record("1", "u", b"", None), warc.record("2", url * 8, payload[::-1], None)]
    for data in (b"".join(warc.member(p) for p in parts), warc.member(b"".join(parts))) if compress else (b"".join(parts),):
        found = list(warc.Salvage("a.warc" + ".gz" * compress, io.BytesIO(data), len(data)).items())
        assert [(k, r[7], r[9], r[-1]) for k, r in found] == [("record", "0", len(payload), payload), ("record", "1", 0, b""), ("record", "2", len(payload), payload[::-1])]
        assert found[2][1][6] == url * 8


def test_folded_headers_and_junk_after_a_version_line():
    lines = b"WARC/1.0\r\nWARC-Type: resource\r\nPage-ID:\r\n  a\r\n\tb\r\nContent-Length: 002\r\n\r\nhi\r\n\r\n"
    junk = b"WARC/1.0\r\n" + bytes(range(256)) * 9
    ids, gaps = salvaged(junk + lines, "a.warc")
    assert ids == ["a b"] and gaps == [("a.warc", 0, None, len(junk), "bad header")]


def test_round_trip(spark):
    rows = [(1, "u1", "<p>a</p>", 0), (2, "u2", "<p>a</p>", 0), (3, None, None, 0), (4, "u4", "", 0), (5, "u5", "é", 0), (5, "u5", "é", 0), (None, "n", "z", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = shared_folder(spark, "archives")
    manifest = warc.write(pages, folder, rotate=300)
    found = warc.read_records(manifest, folder).collect()
    facts = [(str(r.page_id), r.target, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload).decode()) for r in found]
    assert len(facts) == 7
    assert {f[:5] for f in facts} == {
        ("1", "u1", "revisit", "2", 8), ("2", "u2", "response", None, 8), ("3", None, "revisit", "4", 0), ("4", "u4", "response", None, 0),
        ("5", "u5", "response", None, 2), ("None", "n", "response", None, 1),
    }
    assert all(r.payload_digest == warc.base32_sha1(bytes(r.payload)) for r in found if r.record_type == "response")
    assert manifest.count() > 1 and warc.read_gaps(manifest, folder).count() == 0
    none = warc.write(pages.limit(0), folder)
    assert none.count() == 0 and warc.read_records(none, folder).count() == 0
