import http.server
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.sources import ranged
from tessera.sources.locators import FileAccess, FileLocator, HttpAccess, HttpLocator, MemoryAccess, MemoryLocator, locate, split_path, split_path_column
from tessera.sources.parquet import ParquetOptions

DATA = bytes(range(256)) * 8


def serve(kind):
    class Handler(http.server.BaseHTTPRequestHandler):
        seen = 0

        def log_message(self, *a):
            pass

        def do_HEAD(self):
            self.send_response(200)
            if kind == "no ranges":
                self.send_header("Accept-Ranges", "none")
            if kind != "no length":
                self.send_header("Content-Length", str(len(DATA)))
            self.end_headers()

        def do_GET(self):
            Handler.seen += 1
            if kind == "flaky" and Handler.seen < 3:
                self.send_error(503)
                return
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            self.send_response(200 if kind == "whole" else 206)
            self.send_header("Content-Range", f"bytes {a + (kind == 'shifted')}-{b}/{len(DATA)}")
            self.end_headers()
            self.wfile.write(DATA[a : b + 1])

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}/x"


@pytest.mark.parametrize("kind", ["good", "flaky"])
def test_http(kind):
    server, uri = serve(kind)
    a = HttpAccess(uri, retries=3, wait=0.01)
    assert a.length() == len(DATA) and a.read(3, 300) == DATA[3:303] and a.read(len(DATA) - 2, 10) == DATA[-2:] and a.read(10**6, 5) == b""
    server.shutdown()


@pytest.mark.parametrize("kind", ["no ranges", "no length", "whole", "shifted"])
def test_http_refuses(kind):
    server, uri = serve(kind)
    with pytest.raises(ValueError):
        HttpAccess(uri, wait=0.01).read(0, 5)
    server.shutdown()


def test_paths(spark, tmp_path):
    cases = {"foo/bar": ("foo", "bar"), "/foo": ("", "foo"), "/foo/bar": ("/foo", "bar"), "foo": None, "a/b/": ("a", "b/")}
    assert {p: split_path(p) for p in cases} == cases
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", split_path_column(F.col("p")).alias("x")).collect()
    assert {r.p: r.x and tuple(r.x) for r in got} == cases
    f = tmp_path / "f"
    f.write_bytes(b"abcdefghij\n")
    assert FileAccess(f).read(3, 3) == b"def" and FileAccess(f).read(9, 10) == b"j\n"
    assert FileLocator(tmp_path).relative("f") == FileLocator(f) and FileLocator(f).parent() == FileLocator(tmp_path) and len({FileLocator(f), FileLocator(f)}) == 1
    assert MemoryAccess(bytes([1, 2, 3, 4, 5])).read(2, 3) == bytes([3, 4, 5])
    m = MemoryLocator(b"x")
    assert m.parent() is None and m.relative("y") is m and m.access().length() == 1
    assert HttpLocator("http://a/b/c").parent().uri == "http://a/b" and HttpLocator("http://a/b").relative("c").uri == "http://a/b/c" and HttpLocator("http://a").parent() is None
    assert isinstance(locate("http://a/b"), HttpLocator) and isinstance(locate("file:///x"), FileLocator)
    with pytest.raises(ValueError):
        MemoryAccess(b"x").read(-1, 1)
    with pytest.raises(FileNotFoundError):
        FileAccess(tmp_path / "none")


def test_ranged_source(spark, tmp_path):
    ranged.register(spark)
    (tmp_path / "f").write_bytes(DATA)
    server, uri = serve("good")
    for path in (str(tmp_path / "f"), uri):
        rows = spark.read.format("byte_ranges").option("path", path).option("range_bytes", 700).load().orderBy("offset").collect()
        assert b"".join(bytes(r.data) for r in rows) == DATA and len(rows) == 3
    server.shutdown()
    (tmp_path / "empty").write_bytes(b"")
    assert spark.read.format("byte_ranges").option("path", str(tmp_path / "empty")).load().count() == 0


def test_ranged_query(spark):
    from tessera.plans import catalogue

    sf = "/root/testdata/sf0.001"
    raw = open(f"{sf}/customer.parquet", "rb").read()
    got = sorted(tuple(r) for r in catalogue.QUERIES["io_ranged_source"](spark, sf).collect())
    assert got == [(o, len(raw[o : o + 65536]), zlib.crc32(raw[o : o + 65536])) for o in range(0, len(raw), 65536)]


def test_parquet_options_and_cli(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(k, k + 3, float(k)) for k in range(50)], "start long, end long, x double")
    ParquetOptions(dictionary=False).write(df.coalesce(1), str(tmp_path / "in"))
    meta = pq.ParquetFile(next((tmp_path / "in").glob("*.parquet"))).metadata.row_group(0).column(0)
    assert meta.compression == "GZIP" and not any("DICT" in e for e in meta.encodings)
    with pytest.raises(ValueError):
        ParquetOptions(compression="rar")
    assert cli.main(["overlap", str(tmp_path / "in"), str(tmp_path / "out"), "10", "12", "--compression", "zstd"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert cli.main(["zscore", str(tmp_path / "in"), str(tmp_path / "z"), "x"], spark) == 0
    assert cli.main(["-h"], spark) == 0 and cli.main(["overlap"], spark) == 2 and cli.main(["overlap", "/none", str(tmp_path / "o"), "1", "2"], spark) == 1


def test_ranged_query_reads_folders_and_other_file_systems(spark, tmp_path):
    from tessera.plans import catalogue

    query = catalogue.QUERIES["io_ranged_source"]
    table = tmp_path / "customer.parquet"
    (table / "k=1").mkdir(parents=True)
    files = {"part-0": DATA * 70, "part-1": DATA, "k=1/part-2": b"x", "part-3": b""}
    for name, raw in files.items():
        (table / name).write_bytes(raw)
    (table / "_SUCCESS").write_bytes(b"hidden")
    want = sorted((o, len(raw[o : o + 65536]), zlib.crc32(raw[o : o + 65536])) for raw in files.values() for o in range(0, len(raw), 65536))
    assert sorted(tuple(r) for r in query(spark, str(tmp_path)).collect()) == want
    assert sorted(tuple(r) for r in query(spark, f"file://{tmp_path}").collect()) == want
    got = catalogue._hadoop_ranges(spark, catalogue._files(spark, str(table)), 65536)
    assert sorted(tuple(r) for r in got.collect()) == want
    server, uri = serve("good")
    assert [tuple(r) for r in query(spark, uri.removesuffix("/x")).collect()] == [(0, len(DATA), zlib.crc32(DATA))]
    server.shutdown()
    with pytest.raises(Exception):
        query(spark, str(tmp_path / "none")).collect()


def test_commands_can_be_registered_and_logged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "COMMANDS", dict(cli.COMMANDS))
    cli.register(cli.Command("count", "Write the number of rows.", lambda s, a: s.read.parquet(a.input).groupBy().count().write.parquet(a.output), lambda c: c.add_argument("--twice", action="store_true")))
    spark.range(7).write.parquet(str(tmp_path / "in"))
    log = tmp_path / "log"
    assert cli.main(["count", str(tmp_path / "in"), str(tmp_path / "out"), "--twice", "--log-file", str(log)], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).first()[0] == 7
    assert cli.main(["count", "/none", str(tmp_path / "o"), "--log-file", str(log)], spark) == 1
    text = log.read_text()
    assert " INFO " in text and "count done" in text and " ERROR " in text and not cli.LOG.handlers


def test_ranged_source_reads_paths_with_commas(spark, tmp_path):
    import json

    files = [tmp_path / "a,b", tmp_path / "c"]
    for f in files:
        f.write_bytes(DATA)
    ranged.register(spark)
    rows = spark.read.format("byte_ranges").option("paths", json.dumps([str(f) for f in files])).option("range_bytes", 1000).load().collect()
    assert {r.path: b"".join(x.data for x in sorted(rows, key=lambda x: x.offset) if x.path == r.path) for r in rows} == {str(f): DATA for f in files}
