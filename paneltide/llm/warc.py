"""WARC derivatives: linked metadata and plain-text conversion records from responses.

Every response gives one conversion record with the page's main text and one metadata record
with what is known of the source: its HTTP status and headers, charset, digests and links.
Both name the response in WARC-Refers-To and keep its target, date and warcinfo; the
metadata record names the conversion in WARC-Concurrent-To. Record ids follow from the
response's id and the kind, so a task that runs again makes the same records.

Defined cases: a null block is an empty one; a block without an HTTP head is all body, with
status unknown; an undecodable byte becomes the replacement character; a missing
digest is computed; equal responses give equal records; other record types are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paneltide.llm.batches import slices
from paneltide.llm.page_text import main_text

HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
#: A WARC record: its named fields in order, and its block.
RECORD = [T.StructField("fields", T.ArrayType(HEADER)), T.StructField("block", T.BinaryType())]
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_LINK = re.compile(rb"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(
    pages: DataFrame,
    date: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    source: str = "html",
) -> DataFrame:
    """Pages as response records captured at ``date``: page_id, fields, block."""
    body = F.coalesce(F.col(f"`{source}`"), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    named = {
        "WARC-Type": F.lit("response"),
        "WARC-Record-ID": _urn(F.lit("response"), F.col(f"`{page_id}`"), F.col(f"`{url}`")),
        "WARC-Date": F.lit(date),
        "WARC-Target-URI": F.coalesce(F.col(f"`{url}`"), F.lit("")),
        "Content-Type": F.lit("application/http; msgtype=response"),
    }
    fields = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in named.items()])
    return pages.select(F.col(f"`{page_id}`").alias("page_id"), fields.alias("fields"), F.encode(F.concat(head, body), "UTF-8").alias("block"))


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status, headers and body of an HTTP response; the status is empty where there is no head."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        head, mark, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    status = (lines[0].split(None, 2) + [""])[1] if lines else ""
    named: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and named:  # a folded header
            named[-1] = (named[-1][0], f"{named[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            named.append((name.strip(), value.strip()))
    return status, named, body


def serialized(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record with its closing lines."""
    head = "WARC/1.1\r\n" + "".join(f"{n}: {_line(v)}\r\n" for n, v in fields)
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _dechunked(body: bytes) -> bytes | None:
    """The data of a chunked body; nothing if it is not made of chunks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"([0-9A-Fa-f]+)[ \t]*(;.*)?", body[at:end], re.S) if end >= 0 else None
        if size is None:
            return None
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        if end + 2 + n > len(body):
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def decoded_body(named: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without chunks and compression; a body that is not as its headers say stays as it is."""
    coded = {n.lower(): v.lower() for n, v in named if n.lower() in ("transfer-encoding", "content-encoding")}
    if "chunked" in coded.get("transfer-encoding", ""):
        whole = _dechunked(body)
        body = body if whole is None else whole
    if re.search("gzip|deflate", coded.get("content-encoding", "") + coded.get("transfer-encoding", "")):
        for window in (47, -15):  # with a header of gzip or zlib, and bare
            try:
                return zlib.decompressobj(window).decompress(body)
            except zlib.error:
                continue
    return body


def derivatives(fields: list[tuple[str, str]], block: bytes) -> list[tuple[str, str, list[tuple[str, str]], bytes]]:
    """(type, record id, fields, block) of the two records made from one response."""
    by_name = {}
    for n, v in fields:
        by_name.setdefault(n.lower(), v or "")
    source = by_name.get("warc-record-id", "")
    status, named, body = http_parts(block)
    declared = next((v for n, v in named if n.lower() == "content-type"), "")
    plain = decoded_body(named, body)
    found = _CHARSET.search(declared) or _CHARSET.search(plain[:2048].decode("latin-1"))
    charset = found[1] if found else "utf-8"
    try:
        page = plain.decode(charset, "replace")
    except (LookupError, UnicodeError):  # unknown, or a codec that cannot replace what it cannot read
        charset, page = "utf-8", plain.decode("utf-8", "replace")
    text = main_text(page).encode("utf-8", "replace")
    ids = {kind: record_id(source, by_name.get("warc-target-uri", ""), kind) for kind in ("conversion", "metadata")}
    kept = [(n, by_name[n.lower()]) for n in ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID") if n.lower() in by_name]
    facts = [("source-record-id", source), ("source-content-type", by_name.get("content-type", ""))]
    facts += [("source-block-digest", by_name.get("warc-block-digest") or digest(block))]
    facts += [("source-payload-digest", by_name.get("warc-payload-digest") or digest(body))]
    facts += [("http-status", status or "unknown"), ("charset", charset)]
    facts += [(f"http-header-{n.lower()}", v) for n, v in named]
    facts += [("text-characters", str(len(text.decode("utf-8")))), ("text-digest", digest(text))]
    facts += [("outlink", next(x for x in m.groups() if x is not None).decode("utf-8", "replace")) for m in _LINK.finditer(plain)]
    about = "".join(f"{n}: {_line(v)}\r\n" for n, v in facts).encode()
    out = []
    for kind, content, data, more in (
        ("metadata", "application/warc-fields", about, [("WARC-Concurrent-To", ids["conversion"])]),
        ("conversion", "text/plain; charset=utf-8", text, []),
    ):
        own = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), *kept, ("WARC-Refers-To", source), *more]
        own += [("WARC-Block-Digest", digest(data)), ("Content-Type", content)]
        out.append((kind, ids[kind], own, data))
    return out


def derive(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records for every response among ``records`` (fields, block).

    The columns ``carry`` go along. Results: warc_type, record_id, refers_to, fields, block, record.
    """
    out_fields = [
        T.StructField("warc_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        *RECORD,
        T.StructField("record", T.BinaryType()),
    ]
    taken = {f.name for f in out_fields}
    carried = [records.schema[c] for c in carry if c not in taken]
    schema = T.StructType(carried + out_fields)
    arrow = [to_arrow_type(f.dataType) for f in out_fields]
    source = records.select(*[F.col(f"`{f.name}`") for f in carried], F.col("fields").alias("_fields"), F.coalesce("block", F.encode(F.lit(""), "UTF-8")).alias("_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("_block"))
            for start, end in slices(blocks):
                part = batch.slice(start, end - start)
                at, rows = [], []
                heads = part.column(part.schema.get_field_index("_fields")).to_pylist()
                for k, (head, block) in enumerate(zip(heads, blocks.slice(start, end - start).to_pylist())):
                    fields = [(h["name"] or "", h["value"] or "") for h in head or []]
                    if not any(n.lower() == "warc-type" and v == "response" for n, v in fields):
                        continue
                    for kind, name, own, data in derivatives(fields, block):
                        at.append(k)
                        refers = next(v for n, v in own if n == "WARC-Refers-To")
                        listed = [{"name": n, "value": v} for n, v in own]
                        rows.append((kind, name, refers, listed, data, serialized(own, data)))
                if rows:
                    columns = [part.column(i).take(pa.array(at)) for i in range(len(carried))]
                    columns += [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(arrow)]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def write_warc(records: DataFrame, path: str) -> None:
    """Write the records (column ``record``, text blocks in UTF-8) as compressed WARC files."""
    whole = F.decode("record", "UTF-8")
    body = records.select(F.substr(whole, F.lit(1), F.length(whole) - 4).alias("value"))
    body.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(fields, block) of all records in the WARC files below ``path``; one task reads one file."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = T.StructType(RECORD)
    arrow = [to_arrow_type(f.dataType) for f in RECORD]

    def parsed(data: bytes) -> Iterator[tuple[list[dict], bytes]]:
        at = 0
        while (end := data.find(b"\r\n\r\n", at)) >= 0:
            lines = data[at:end].decode("utf-8", "replace").lstrip().split("\r\n")[1:]
            pairs = [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line]
            size = int(next((v for n, v in pairs if n.lower() == "content-length"), 0))
            block = data[end + 4 : end + 4 + size]
            yield [{"name": n, "value": v} for n, v in pairs if n.lower() != "content-length"], block
            at = end + 8 + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                raw = value.as_py()
                rows: list = []
                size = 0
                for row in parsed(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    rows.append(row)
                    size += len(row[1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=arrow[i]) for i in (0, 1)], schema.names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=arrow[i]) for i in (0, 1)], schema.names)

    return files.mapInArrow(run, schema)
