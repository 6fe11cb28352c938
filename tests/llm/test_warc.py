import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from tieplane.llm import warc

from .cases import texts


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, sha string, bytes int")


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        data, keep = (h or "").encode(), max((x for x in groups[h or ""] if x is not None), default=None)
        again = len(data) >= least and i != keep
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    out = [(i, f"http://h/{i}", t) for i, (_, t) in enumerate(texts()) if t is None or len(t) < 10**6]
    out += [(500 + i, None, "same page") for i in range(40)] + [(600, "http://x/\r\nWARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (601, "ü", "é" * 40_000), (602, "", "\r\n\r\n")]
    out += [(700, "u", "twice"), (700, "u", "twice"), (699, "u", "twice"), (701, "u", "twice as long " * 5000), (701, "u", "twice as long " * 5000), (None, "n", "null id")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, least):
    r = rows()
    assert sorted(map(tuple, warc.warc_round_trip(frame(spark, r), min_bytes=least).collect()), key=str) == expected(r, least)


def test_payloads_come_back_whole(spark, tmp_path):
    r = rows()
    path = str(tmp_path / "archives")
    warc.write_archives(frame(spark, r), path, segment=1000)
    got = {bytes(x.payload) for x in warc.read_archives(spark, path).collect() if x.kind == "response"}
    assert got == {(h or "").encode() for _, _, h in r}


def test_empty_table(spark):
    assert warc.warc_round_trip(frame(spark, [])).collect() == []


def test_chunked_framing():
    assert warc.unchunked(b"4\r\nWiki\r\n5;x=y\r\npedia\r\n0\r\nTrailer: 1\r\n\r\n") == b"Wikipedia"
    for cut in (b"4\r\nWi", b"4\r\nWiki0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(cut)
    data = bytes(range(256)) * 100
    assert warc.unchunked(warc.chunked(data, 7)) == data and warc.unchunked(warc.chunked(b"")) == b""


def test_reassembly_finds_faults():
    body = b"x" * 5000
    records = [*warc.parse(iter([b"".join(warc.records_of("urn:a", "u", body, warc.digest_of(body), None, segment=1000))]))]
    parts = []
    for fields, block in records:
        total = fields.get("warc-segment-total-length")
        parts.append((int(fields["warc-segment-number"]), int(total) if total else None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), block))
    assert len(parts) > 5 and warc.reassemble("a", parts)[0] == body
    for bad in (parts[1:], parts[:-1], parts[:2] + parts[3:], parts[:1] + parts, [(*parts[0][:2], "A" * 32, parts[0][3]), *parts[1:]]):
        with pytest.raises(ValueError):
            warc.reassemble("a", bad)


def test_archives_of_others_are_read():
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (record * 3, gzip.compress(record) * 3, gzip.compress(record * 3)):
        assert [b for _, b in warc.parse(warc.inflate(data))] == [b"abc"] * 3
        pieces = iter([data[i : i + 5] for i in range(0, len(data), 5)]) if data[:4] == b"WARC" else warc.inflate(data)
        assert len([*warc.parse(pieces)]) == 3
    with pytest.raises(ValueError):
        [*warc.inflate(gzip.compress(record)[:-10])]
