import base64
import gzip
import hashlib
import zlib

from pyspark.sql import functions as F

from paneltide.llm import warc as W

PAGE = "<html><body><nav>menu</nav><article><p>Über text, with commas, and <a href='/x'>a link</a>.</p></article></body></html>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_records_are_linked_and_keep_the_source(spark):
    pages = frame(spark, [(1, "http://a/", PAGE), (2, None, None), (1, "http://a/", PAGE)])
    source = W.responses(pages, "2024-05-06T07:08:09Z")
    made = W.derive(source.withColumn("record", F.lit("clash")), ("page_id", "record")).collect()
    assert len(made) == 6
    ids = {r.page_id: dict(map(tuple, r.fields))["WARC-Record-ID"] for r in source.collect()}
    for r in made:
        named = dict(map(tuple, r.fields))
        assert r.refers_to == named["WARC-Refers-To"] == ids[r.page_id]
        assert named["WARC-Date"] == "2024-05-06T07:08:09Z"
        sha = "sha1:" + base64.b32encode(hashlib.sha1(r.block).digest()).decode()
        assert named["WARC-Block-Digest"] == sha
    one = {r.warc_type: r for r in made if r.page_id == 1}
    assert one["conversion"].block.decode() == "Über text, with commas, and a link."
    facts = one["metadata"].block.decode()
    assert "http-status: 200\r\n" in facts and "outlink: /x\r\n" in facts
    assert "http-header-content-type: text/html; charset=utf-8\r\n" in facts
    assert dict(map(tuple, one["metadata"].fields))["WARC-Concurrent-To"] == one["conversion"].record_id
    assert W.derive(source.limit(0)).count() == 0


def test_odd_blocks():
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")]
    for block in (b"", b"no head", b"HTTP/1.1 404 Not Found\nX: 1\n\n<p>caf\xe9", b"HTTP/1.0", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nope\r\n\r\n<p>x"):
        got = W.derivatives(fields, block)
        assert [g[0] for g in got] == ["metadata", "conversion"]
    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-A: one\r\n two\r\n\r\n<p>caf\xe9</p>"
    meta, text = W.derivatives(fields, latin)
    assert text[3].decode() == "café" and b"http-header-x-a: one two" in meta[3]


def test_files_come_back(spark, tmp_path):
    source = W.responses(frame(spark, [(k, f"http://a/{k}", PAGE * (k + 1)) for k in range(9)] + [(9, "u", None)]), "2024-01-01T00:00:00Z")
    made = W.derive(source)
    W.write_warc(made, str(tmp_path / "out"))
    back = W.read_warc(spark, str(tmp_path / "out"))

    def key(rows):
        return sorted((dict(map(tuple, r.fields))["WARC-Record-ID"], bytes(r.block)) for r in rows)

    assert key(back.collect()) == key(made.collect())
    assert W.derive(back).count() == 0  # no responses among them


def made(head, body):
    block = ("HTTP/1.1 200 OK\r\n" + head + "\r\n").encode() + body
    out = W.derivatives([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "u")], block)
    return {kind: data for kind, _, _, data in out}


def test_odd_charsets_compressed_and_chunked_bodies():
    page, wanted = PAGE.encode(), "Über text, with commas, and a link.".encode()
    for name in ("idna", "undefined", "punycode", "hex", "rot13", "no-such", "utf-8"):
        assert set(made(f"Content-Type: text/html; charset={name}\r\n", page)) == {"conversion", "metadata"}
    for name in ("idna", "undefined", "no-such", "utf-8"):
        assert made(f"Content-Type: text/html; charset={name}\r\n", page)["conversion"] == wanted, name
    packed = gzip.compress(page)
    bare = zlib.compressobj(wbits=-15)
    bare = bare.compress(page) + bare.flush()
    for kind, body in (("gzip", packed), ("deflate", zlib.compress(page)), ("deflate", bare)):
        got = made(f"Content-Encoding: {kind}\r\n", body)
        assert got["conversion"] == wanted and b"outlink: /x\r\n" in got["metadata"]
        assert ("source-payload-digest: " + W.digest(body)).encode() in got["metadata"]  # of the bytes as they came
    chunks = b"".join(b"%x;n=1\r\n%s\r\n" % (len(c), c) for c in (packed[:20], packed[20:])) + b"0\r\n\r\n"
    assert made("Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n", chunks)["conversion"] == wanted
    for head in ("Transfer-Encoding: chunked\r\n", "Content-Encoding: gzip\r\n"):  # not as the header says
        assert made(head, page)["conversion"] == wanted
    assert set(made("Content-Encoding: gzip\r\n", packed[:30])) == {"conversion", "metadata"}
