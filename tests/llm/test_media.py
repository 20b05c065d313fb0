"""Media columns: parsing, lossless storage, joins."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media as M

from .test_tokens import TEXTS, table, texts


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=500))
def test_png_round_trip(data):
    p = M.payload_of(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(data) and not any(p[len(data) :])
    stored = M.to_png(p)
    assert M.from_png(stored) == p and M.to_png(p) == stored and M.feature_of(p) == M.feature_of(p)


def test_payload_sizes_and_damage():
    assert [len(M.payload_of(b"x" * n)) for n in (0, 1, 63, 64, 65, 128)] == [64, 64, 64, 64, 128, 128]
    png = bytearray(M.to_png(b"x" * 64))
    png[45] ^= 1
    with pytest.raises(ValueError):
        M.from_png(bytes(png))
    with pytest.raises(ValueError):
        M.from_png(b"GIF89a")


def test_png_is_read_elsewhere(tmp_path):
    image = pytest.importorskip("PIL.Image")
    (tmp_path / "x.png").write_bytes(M.to_png(M.payload_of(b"hello" * 40)))
    assert image.open(tmp_path / "x.png").tobytes() == M.payload_of(b"hello" * 40)


def test_parse_keeps_order_and_captions():
    html = """<html><head><title>no</title><style>p{}</style></head><body><h1>T &amp; U</h1> intro <b>bold</b>
      <figure><img src="a.png" alt="alt a"><figcaption>Cap <i>one</i></figcaption></figure>after
      <p>x<img src='b.png' alt='b'>y</p><script>var z = "<img src='no'>"</script><figure><audio src=c></audio><video src=d></video><figcaption>two</figcaption></figure>
      <figure><img src="e"><figcaption></figcaption></figure><img alt="no source"><img src="f" """
    got = [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in M.parse(html)]
    assert got == [("text", "T & U", None), ("text", "intro bold", None), ("media", "a.png", "Cap one"), ("text", "after", None), ("text", "x", None), ("media", "b.png", "b"), ("text", "y", None), ("media", "c", "two"), ("media", "d", "two"), ("media", "e", None)]
    assert [i["pos"] for i in M.parse(html)] == list(range(len(got)))
    assert M.parse(None) == [] and M.parse("") == [] and M.parse("<<>&")[0]["kind"] == "text"


def test_sequences_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r["items"] for r in M.sequences(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        assert [x.asDict() for x in got[r.page_id]] == M.parse(r.html)


def test_resolve_keeps_places(spark):
    digest = "0" * 64
    df = spark.createDataFrame([(1, f'<p>a</p><img src="media:{digest}" alt="one"><img src="media:{"f" * 64}"><img src="http://x/y.png">'), (2, None)], "page_id long, html string")
    media = spark.createDataFrame([(digest, 5)], "digest string, size int")
    got = sorted((r.page_id, r.pos, r.caption, r.size) for r in M.resolve(M.sequences(df), media, "page_id").collect())
    assert got == [(1, 1, "one", 5), (1, 2, None, None), (1, 3, None, None)]


def test_op2(spark, tmp_path):
    rows = [*enumerate(TEXTS + texts(120, 9)), (4, "again"), (None, "null id"), (900, "x"), (901, "x"), (902, "x\x00")]
    got = M.op2_media_columns(spark, table(spark, tmp_path, rows)).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        p = M.payload_of(raw)
        s = M.to_png(p)
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(s), hashlib.sha256(s).hexdigest(), M.feature_of(p)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_op2_empty(spark, tmp_path):
    assert M.op2_media_columns(spark, table(spark, tmp_path, [])).count() == 0
