"""Media columns: interleaved sequences of text and media references, payloads resolved by digest."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup

WIDTH = 64
ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string, n_bytes: long>"


def to_image(data: bytes) -> bytes:
    """A binary greymap of one 8-bit sample a byte, WIDTH to a row, zeros up to at least one full row."""
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + data.ljust(rows * WIDTH, b"\0")


def from_image(image: bytes) -> bytes:
    """The samples; anything but a whole greymap of 8-bit samples is an error."""
    magic, size, top, samples = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not a whole 8-bit greymap")
    return samples


def feature_of(samples: bytes) -> str:
    """An average hash: a bit for each column that is brighter than the mean, as hex digits."""
    columns = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH).sum(axis=0, dtype=np.int64)
    return np.packbits(columns * WIDTH > columns.sum()).tobytes().hex()


class _Figure:
    """An open figure: its media, the pieces of its caption, and whether text goes into the caption now."""

    def __init__(self):
        self.media: list[dict] = []
        self.caption: list[dict] = []
        self.telling = False


class _Sequence(HTMLParser):
    """Text runs and media references in document order, none of them lost.

    A figure's caption belongs to all media of that figure, wherever in it the caption stands; without one
    the alt text is the caption. A figcaption ends where its figure ends at the latest, and a figure where
    an element around it does. Media of a figure without caption, inside another one, take that one's. A
    caption without media, or outside figures, is text in its place. Scripts and styles are no text.
    """

    HOLDERS = {"html", "body", "main", "article", "section", "aside", "header", "footer", "nav", "div", "blockquote", "table", "tr", "td", "th", "ul", "ol", "li", "figure"}
    BREAKS = HOLDERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "pre", "dl", "dt", "dd"}
    MEDIA = {"img", "audio", "video", "source"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skip = 0
        self.open: list[tuple[str, _Figure | None]] = []

    def inner(self) -> _Figure | None:
        return next((f for _, f in reversed(self.open) if f), None)

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            item = {"kind": "text", "text": text}
            self.items.append(item)
            if (figure := self.inner()) and figure.telling:
                figure.caption.append(item)

    def tell(self, on: bool) -> None:
        self.flush()
        if figure := self.inner():
            figure.telling = on

    def leave(self) -> None:
        """Closes the innermost open element."""
        self.flush()
        _, figure = self.open.pop()
        if not figure or not figure.media:
            return
        if figure.caption:
            told = " ".join(x["text"] for x in figure.caption)
            for item in figure.media:
                item["caption"] = told
            gone = set(map(id, figure.caption))
            self.items = [x for x in self.items if id(x) not in gone]
        elif outer := self.inner():
            outer.media += figure.media

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "figcaption":
            self.tell(True)
        elif tag in self.MEDIA and (src := dict(attrs).get("src")):
            self.flush()
            a = dict(attrs)
            item = {"kind": "media", "digest": src.removeprefix("sha256:"), "caption": a.get("alt"), "n_bytes": int(a["data-bytes"]) if re.fullmatch("[0-9]{1,18}", a.get("data-bytes") or "") else None}
            self.items.append(item)
            if figure := self.inner():
                figure.media.append(item)
        elif tag in self.BREAKS:
            self.flush()
            if tag in self.HOLDERS:
                self.open.append((tag, _Figure() if tag == "figure" else None))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.tell(False)
        elif tag in self.BREAKS:
            self.flush()
            if tag in self.HOLDERS and any(t == tag for t, _ in self.open):
                while self.open[-1][0] != tag:
                    self.leave()
                self.leave()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as in html, where only void elements have no end

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.run.append(data)

    def finish(self) -> list[dict]:
        self.close()
        while self.open:
            self.leave()
        self.flush()
        return self.items


def sequence_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    return [{"position": i, "kind": x["kind"], "text": x.get("text"), "digest": x.get("digest"), "caption": x.get("caption"), "n_bytes": x.get("n_bytes")} for i, x in enumerate(parser.finish())]


def sequences(rows: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """doc_id and items, the ordered texts and media references of each html."""
    kind = rows.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence_of(h.as_py()) for h in batch.column(1)], item)], ["doc_id", "items"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"doc_id {kind}, items array<{ITEM}>")


def store_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes doc_id, html (a page that shows the text as an image), digest and media (the image, once a batch)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, rows, size = set(), [], 0

            def out(rows: list, lo: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                html, digest, media = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), pa.array(html, pa.string()), pa.array(digest, pa.string()), pa.array(media, pa.binary())], ["doc_id", "html", "digest", "media"])

            for i in range(batch.num_rows):
                name, data = escape(str(batch.column(0)[i].as_py())), (batch.column(1)[i].as_py() or "").encode()
                image = to_image(data)
                digest = hashlib.sha256(image).hexdigest()
                html = f'<article><p>Document {name}</p><figure><img src="sha256:{digest}" data-bytes="{len(data)}"><figcaption>Text of {len(data)} bytes</figcaption></figure></article>'
                rows.append((html, digest, None if digest in seen else image))
                seen.add(digest)
                size += len(image)
                if size > 4 << 20:
                    yield out(rows, i + 1 - len(rows))
                    rows, size = [], 0
            if rows:
                yield out(rows, batch.num_rows - len(rows))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, html string, digest string, media binary")
    rows.write.option("compression", "zstd").parquet(path)


def described(media: DataFrame) -> DataFrame:
    """digest and what the stored bytes say, once per digest; bytes that belie their digest are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column(0), batch.column(1), strict=True):
                image = image.as_buffer().to_pybytes()
                sha = hashlib.sha256(image).hexdigest()
                if sha != digest.as_py():
                    raise ValueError(f"stored bytes of {digest} differ from their digest")
                samples = from_image(image)
                rows.append((sha, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(image), sha, feature_of(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "media").filter("media IS NOT NULL").mapInArrow(
        run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    ).distinct()


def resolve(items: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """Joins the media items (columns doc_id, position, digest, ...) to the facts of their payloads by digest.

    Only digests and facts move, never payloads. A reference whose payload is not stored gets null facts.
    """
    used = items.filter("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("_copies"))
    return lookup(items, facts.join(used, "digest"), ["digest"], "_copies", total).drop("_copies")


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text as an image, shows it in an html page, and reads both back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    and the reference's position in its page and caption. Null counts as empty, which is one row of zeros; equal texts share one stored
    image and so all values; repeated rows and null ids give rows of their own; a very long text is one tall image; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "media")
    store_documents(docs, scratch.path("store"), id_col, text_col)
    store = spark.read.parquet(scratch.path("store"))
    items = sequences(store).select("doc_id", F.explode("items").alias("item")).filter("item.kind = 'media'").select("doc_id", "item.position", "item.digest", "item.caption", "item.n_bytes")
    items = scratch.keep(items, "items")
    facts = scratch.keep(described(store), "facts")
    scratch.drop("store")
    scratch.release()
    out = resolve(items, facts, items.count())
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
