import hashlib
import zlib

import pytest

from tieplane.llm import media

from .cases import frame, texts


def test_round_trip(spark):
    rows = texts()
    got = media.media_round_trip(frame(spark, rows)).collect()
    want = []
    for d, t in rows:
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        columns = [sum(payload[k::64]) for k in range(64)]
        bits = int("".join("1" if c * 64 > sum(columns) else "0" for c in columns), 2)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        want.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{bits:016x}"))
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)
    assert {(r.doc_id, r.position, r.caption) for r in got} == {(d, 1, f"Text of {len((t or '').encode())} bytes") for d, t in rows}
    assert media.media_round_trip(frame(spark, [])).collect() == []


def test_sequences_keep_order_and_captions():
    html = """<h1>A &amp; B</h1><p>one <b>two</b><img src="sha256:aa" alt="first"> three</p><script>var t="<p>no";</script>
    <figure><figcaption>Both <i>of</i> these</figcaption><img src="sha256:bb" data-bytes="7"><video src="cc"></video></figure>
    <figure><img src="dd" alt="own"></figure><img alt="no source"><p>end"""
    got = [(x["position"], x["kind"], x["text"], x["digest"], x["caption"], x["n_bytes"]) for x in media.sequence_of(html)]
    assert got == [
        (0, "text", "A & B", None, None, None), (1, "text", "one two", None, None, None), (2, "media", None, "aa", "first", None), (3, "text", "three", None, None, None),
        (4, "media", None, "bb", "Both of these", 7), (5, "media", None, "cc", "Both of these", None), (6, "media", None, "dd", "own", None), (7, "text", "end", None, None, None),
    ]
    assert media.sequence_of(None) == media.sequence_of("") == []


def told(html):
    return [x["text"] or (x["digest"], x["caption"]) for x in media.sequence_of(html)]


def test_malformed_html_loses_no_text_and_moves_no_caption():
    assert told('<figure><img src="a"><figcaption>cap</figure><p>later text</p>') == [("a", "cap"), "later text"]
    assert told('<figcaption>stray</figcaption><figure><img src="a" alt="x"></figure>') == ["stray", ("a", "x")]
    assert told('<figure><img src="a"><figure><img src="b"><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>') == [("a", "out"), ("b", "in")]
    assert told('<figure><figure><img src="b" alt="x"></figure><figcaption>out</figcaption></figure>') == [("b", "out")]
    assert told('<figure><figcaption>out <figure><img src="b"><figcaption>in</figure> more</figcaption><img src="a"></figure>') == [("b", "in"), ("a", "out more")]
    assert told("<p>one<figure><figcaption>alone</figcaption></figure>two") == ["one", "alone", "two"]
    assert told('<div><figure><img src="a"><figcaption>cap</div>after') == [("a", "cap"), "after"]
    assert told('<figure><img src="a"/><figcaption>one</figcaption>text<figcaption>two<p>three') == [("a", "one two three"), "text"]
    assert told('</figure></figcaption>x</p><img><img src=""><IMG SRC="a">') == ["x", ("a", None)]
    assert told("<b>x</b><script>lost()</script>y<style>z{}") == ["xy"]
    assert media.sequence_of('<img src="a" data-bytes="²">')[0]["n_bytes"] is None


def test_missing_payloads_and_shared_ones(spark):
    pages = spark.createDataFrame([(1, '<img src="x"><img src="y">'), (2, '<img src="x">'), (3, None)], "doc_id long, html string")
    from pyspark.sql import functions as F

    items = media.sequences(pages).select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.position", "i.digest")
    facts = spark.createDataFrame([("x", 64)], "digest string, payload_bytes long")
    assert sorted(map(tuple, media.resolve(items, facts, 3).select("doc_id", "position", "payload_bytes").collect())) == [(1, 0, 64), (1, 1, None), (2, 0, 64)]


def test_stored_bytes_are_checked():
    image = media.to_image(b"abc")
    assert media.from_image(image) == b"abc".ljust(64, b"\0")
    for bad in (image[:-1], b"P4" + image[2:], image.replace(b"255", b"127", 1)):
        with pytest.raises(ValueError):
            media.from_image(bad)
