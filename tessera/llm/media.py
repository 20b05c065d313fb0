"""Interleaved sequences of text and media, with payloads found by digest.

``sequences`` parses HTML into an ordered array of structs: a text run, or a media reference with its
caption (a figure's caption, else the alternative text) at the place where it stands. ``store`` keeps
payloads in a media format (grey PNG, one sample a byte) under the SHA-256 of the payload, once for each
digest and task. ``resolve`` joins references to stored media by digest; positions and captions stay
with their reference, and a digest that many references share is a skewed join, which adaptive
execution splits.

Defined cases: a null page or payload is empty; a reference without a stored payload keeps its place with
a null payload; equal payloads are equal media; repeated rows stay repeated; very long texts are one payload each, held
in memory a few at a time; empty tables give no rows; of the input only the named columns are used.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunks import utf8

WIDTH = 64
#: Digests that a task remembers.
SEEN = 1_000_000
#: Rows in one Arrow batch; each row's payload is in memory a few times.
MEDIA_ROWS = 500
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"
MEDIA_TAGS = {"img", "audio", "video", "source", "embed"}
HIDDEN = {"script", "style", "template", "noscript", "head"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "figure", "blockquote", "pre", "body", "html"}
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: A tag that the page ends in; it is dropped.
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.hidden = self.figure = 0
        self.caption: list[str] | None = None
        self.in_figure: list[int] = []

    def end_run(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.run)).strip()
        self.run = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.end_run()
            self.figure, self.in_figure = self.figure + 1, []
        elif tag == "figcaption" and self.figure:
            self.end_run()
            self.caption = []
        elif tag in MEDIA_TAGS:
            own = dict(attrs)
            if own.get("src") and not self.hidden:
                self.end_run()
                if self.figure:
                    self.in_figure.append(len(self.items))
                self.items.append(["media", None, own["src"], own.get("alt") or None])
        elif tag in BREAKS:
            self.end_run()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            self.caption = None
            for k in self.in_figure:
                self.items[k][3] = text or self.items[k][3]
        elif tag == "figure":
            self.end_run()
            self.figure = max(0, self.figure - 1)
        elif tag in BREAKS:
            self.end_run()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The ordered items of a page."""
    r = _Reader()
    r.feed(_UNFINISHED.sub("", html or ""))
    r.close()
    r.end_run()
    return [{"pos": k, "kind": a, "text": b, "ref": c, "caption": d} for k, (a, b, c, d) in enumerate(r.items)]


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items) of every page."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(x) for x in b.column(1).to_pylist()], kind)], ["key", "items"])

    common.tune(pages.sparkSession, MEDIA_ROWS)
    found = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return found.mapInArrow(run, f"key {found.schema['key'].dataType.simpleString()}, items {SEQUENCE}").withColumnRenamed("key", key)


def payload_of(text: bytes) -> bytes:
    """UTF-8 with bytes 0 appended, to a positive multiple of the width."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def to_png(payload: bytes) -> bytes:
    """8-bit grey PNG of ``WIDTH`` columns; without loss."""
    import numpy as np

    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)  # each row's filter byte is 0
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made; checks its chunks."""
    import numpy as np

    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey PNG without interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("only rows without a filter")
    return raw[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, entropy of the samples in bits, and a 64-bit hash of the brightness of 64 column means."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    some = share[share > 0]
    columns = x.reshape(-1, WIDTH).mean(0)
    bits = int.from_bytes(np.packbits(columns > columns.mean()).tobytes(), "big")
    return f"mean={x.mean():.4f};entropy={-(some * np.log2(some)).sum() + 0.0:.4f};columns={bits:016x}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest, stored, html): the text of each document as media, and a page of text with three references:
    a small one to it, one to what isn't stored, and a figure of it, whose caption has the size.

    ``stored`` is null where the same task has stored the digest before; beyond ``SEEN`` digests of a task, payloads are
    stored again, which costs space alone.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[bytes] = set()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                payload = payload_of(text)
                digest = hashlib.sha256(payload)
                new = digest.digest() not in seen
                if new and len(seen) < SEEN:
                    seen.add(digest.digest())
                name = digest.hexdigest()
                html = (
                    f'<html><body><h1>Document {doc}</h1><p>In small: <img src="media:{name}" alt="small"> beside <img src="logo.png" alt="logo">, then in full.</p>'
                    f'<figure><img src="media:{name}" alt="text"><figcaption>{escape(str(doc))}: {len(text)} bytes</figcaption></figure><p>End of {doc}</p></body></html>'
                )
                out.append((doc, len(text), name, to_png(payload) if new else None, html))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()))], ["doc_id", "n_bytes", "digest", "stored", "html"])

    common.tune(docs.sparkSession, MEDIA_ROWS)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, stored binary, html string")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes (columns ``digest``, ``stored``) hold, one row for each digest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for digest, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                payload = from_png(stored)
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            columns = list(zip(*out)) if out else [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in FEATURES.split(", ")])

    found = media.select("digest", "stored").where("stored is not null").mapInArrow(run, FEATURES)
    return found.groupBy("digest").agg(*(F.first(c).alias(c) for c in found.columns[1:]))


def resolve(of: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """References of sequences (``items``), one row each, with the columns of ``media`` by ``digest``.

    Left join: a reference to nothing that is stored keeps its place.
    """
    refs = of.select(key, F.explode("items").alias("i")).where("i.kind = 'media'")
    refs = refs.select(key, F.col("i.pos").alias("pos"), F.col("i.caption").alias("caption"), F.regexp_extract("i.ref", "^media:([0-9a-f]{64})$", 1).alias("digest"))
    return refs.join(media, "digest", "left")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored payload, read back through the page that refers to it.

    Payloads are written once and never shuffled: the join carries what was read from them.
    """
    kept = common.materialised(store(common.documents(spark, sf_dir)), "media")
    found = common.materialised(features(kept), "features")
    joined = resolve(sequences(kept, "doc_id"), found, "doc_id")
    size = r": ([0-9]+) bytes$"
    joined = joined.where(F.col("caption").rlike(size))  # of a page's references the figure
    n_bytes = F.regexp_extract("caption", size, 1).cast("long")
    out = joined.select("doc_id", n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return common.reads(out, kept, found)


QUERIES = {"op2_media_columns": op2_media_columns}
ORACLE: dict[str, str] = {}
