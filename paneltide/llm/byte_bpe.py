"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens, block by block. A block keeps, for each
   text, the positions of its pre-tokens as numbers of the block's word list (packed:
   one row per pre-token would take several times the input on disk), and the words
   leave it as rows keyed by a hash bucket.
2. The words meet by bucket; each distinct word is merged into token ids once, and the
   ids go back to the blocks that asked.
3. Ids and positions of a block are joined and every text is put together by position.

One exchange carries both kinds of rows of step 1, by bucket or by block, and is read twice:
by step 2, and by step 3, whose documents are then where their ids arrive. A block is named
by its task, its place in the task and its content, so a task that runs again after the
loss of an executor makes the same rows, provided that its input comes in the same
order, as from a table; ``encode`` says how to treat other inputs. A word occurs once per
block, however frequent it is, so no bucket grows with a frequent word; the number of
buckets follows the session's shuffle partitions. Memory: one block's word list and
positions, or one bucket's distinct words.

Decoding looks each id up in the token-byte table, which is a vocabulary file of at most
``MAX_TOKENS`` entries and is therefore sent to every task.

Defined cases: a null or empty text has no ids and decodes to nothing; an id outside the
table is an error; rows with equal keys stay separate rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.batches import slices
from paneltide.session import materialized

#: Bytes of text in one block, unless one text alone is longer.
BLOCK_BYTES = 16 << 20
#: Largest vocabulary that is sent to every task.
MAX_TOKENS = 1 << 20
#: Buckets of words per shuffle partition.
BUCKETS = 4


class Vocabulary:
    """Token bytes by rank and the pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if len(ranks) > MAX_TOKENS or max(ranks.values()) >= MAX_TOKENS:
            raise ValueError(f"more than {MAX_TOKENS} tokens")
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a rank file: a token in base64 and its rank on each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def encoding(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def table(self, spark: SparkSession) -> DataFrame:
        """The token-byte table: (id, token)."""
        rows = [(i, bytearray(t)) for t, i in self.ranks.items()]
        return spark.createDataFrame(rows, "id long, token binary")


def _plane_pack(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return struct.pack("<I", len(values)) + zstandard.compress(planes.tobytes(), 3)


def _plane_open(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", data)[0]
    raw = np.frombuffer(zstandard.decompress(data[4:]), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _words_pack(words: list[bytes]) -> bytes:
    sizes = np.array([len(w) for w in words], dtype="<u4").tobytes()
    return zstandard.compress(struct.pack("<I", len(words)) + sizes + b"".join(words), 3)


def _words_open(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    ends = np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4).astype(np.int64)) + 4 + 4 * n
    ends = ends.tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends)]


_META = T.StructType([
    T.StructField("_key", T.BinaryType()),  # the block of a document, the bucket of words
    T.StructField("_block", T.BinaryType()),  # of words; null for a document
    T.StructField("_payload", T.BinaryType()),
])


def _pre_tokenized(docs: DataFrame, text: str, pattern: str, buckets: int, block_bytes: int) -> DataFrame:
    """Rows of both kinds: words of a block by bucket, and documents with their positions."""
    carried = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType(_META.fields + [T.StructField("_doc", T.StructType(carried))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        arrow_kind = None
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            if arrow_kind is None:
                fields = [batch.schema.field(f.name) for f in carried]
                arrow_kind = pa.struct(fields)
            for start, end in slices(texts, block_bytes):
                content = xxhash.xxh3_128()
                number: dict[str, int] = {}
                payloads = []
                for value in texts.slice(start, end - start):
                    one = value.as_py() or ""
                    content.update(one)
                    cut = find(one)
                    known = len(number)
                    local = np.fromiter((number.setdefault(w, len(number)) for w in cut), dtype=np.int64, count=len(cut))
                    # a word's first place in the block is 0: the next number; others are one more
                    first = np.zeros(len(cut), dtype=bool)
                    fresh = np.flatnonzero(local >= known)
                    first[fresh[np.unique(local[fresh], return_index=True)[1]]] = True
                    payloads.append(struct.pack("<I", known) + _plane_pack(np.where(first, 0, local + 1)))
                block = struct.pack("<cQQ", b"d", task, made) + content.digest()
                made += 1
                part = batch.slice(start, end - start)
                docs_of = pa.StructArray.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in carried], fields=list(arrow_kind)) if carried else pa.nulls(end - start, arrow_kind)
                n = end - start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(payloads, pa.binary()), docs_of], schema.names
                )
                words = [w.encode() for w in number]
                by = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), dtype=np.int64, count=len(words))
                order = np.argsort(by, kind="stable")
                cuts = np.flatnonzero(np.diff(by[order])) + 1
                groups = np.split(order, cuts) if len(words) else []
                rows_key, rows_payload = [], []
                for g in groups:
                    rows_key.append(struct.pack("<cQ", b"w", int(by[g[0]])))
                    mine = _words_pack([words[k] for k in g.tolist()])
                    rows_payload.append(struct.pack("<I", len(mine)) + mine + _plane_pack(np.diff(g, prepend=0)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows_key, pa.binary()), pa.array([block] * len(groups), pa.binary()), pa.array(rows_payload, pa.binary()), pa.nulls(len(groups), arrow_kind)], schema.names
                )

    return docs.mapInArrow(run, schema)


def _encoded_words(rows: DataFrame, vocabulary) -> DataFrame:
    """Each distinct word of a bucket encoded once; the ids go back by block: (_key, _payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = vocabulary.value.encoding()._core_bpe.encode_single_piece
        bucket, known = None, {}
        for batch in batches:
            keys, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names, payloads = [], []
            for k, (key, block) in enumerate(zip(keys, blocks)):
                if block is None:
                    continue
                if key != bucket:
                    bucket, known = key, {}
                raw = batch.column(2)[k].as_py()
                size = struct.unpack_from("<I", raw)[0]
                ids = []
                for w in _words_open(raw[4 : 4 + size]):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = piece(w)
                    ids.append(got)
                flat = _plane_pack(np.array([x for y in ids for x in y], dtype=np.int64))
                counts = _plane_pack(np.array([len(y) for y in ids], dtype=np.int64))
                names.append(block)
                payloads.append(struct.pack("<II", len(counts), len(flat)) + counts + flat + raw[4 + size :])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(payloads, pa.binary())], ["_key", "_payload"])

    return rows.mapInArrow(run, "_key binary, _payload binary")


def _word_ids(replies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids one after another, and by word number where its ids start and how many they are."""
    parts = []
    for payload in replies:
        n, m = struct.unpack_from("<II", payload)
        where = np.cumsum(_plane_open(payload[8 + n + m :]).astype(np.int64))
        parts.append((_plane_open(payload[8 : 8 + n]).astype(np.int64), _plane_open(payload[8 + n : 8 + n + m]), where))
    many = sum(len(p[2]) for p in parts)
    counts, starts, base = np.zeros(many, np.int64), np.zeros(many, np.int64), 0
    for size, own, where in parts:
        counts[where] = size
        starts[where] = base + np.cumsum(size) - size
        base += len(own)
    flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, "<u4")
    return flat, starts, counts


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    *,
    text: str = "text",
    ids: str = "ids",
    block_bytes: int = BLOCK_BYTES,
    settle: bool = False,
) -> DataFrame:
    """``docs`` with its text replaced by token ids: ``ids``, little-endian unsigned 32-bit numbers.

    Where ``docs`` is not a table but the result of a shuffle, whose rows may come in another
    order when a task is run again, ``settle`` writes it to the shared folder first.
    """
    spark = docs.sparkSession
    docs = docs.drop(ids) if ids in docs.columns and ids != text else docs
    docs = materialized(docs) if settle else docs
    shared = spark.sparkContext.broadcast(vocabulary)  # at most MAX_TOKENS tokens
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = _pre_tokenized(docs, text, vocabulary.pattern, BUCKETS * partitions, block_bytes)
    # both readers take all rows and columns, so that Spark runs and keeps this exchange once
    rows = cut.repartition(partitions, "_key").sortWithinPartitions("_key")
    replies = _encoded_words(rows, shared)
    carried = cut.schema["_doc"].dataType.fields
    schema = T.StructType([T.StructField("_doc", T.StructType(carried)), T.StructField(ids, T.BinaryType())])

    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        at, out = [], []
        kept = np.flatnonzero([b is None for b in left.column("_block").to_pylist()]).tolist()
        if kept:
            flat, starts, counts = _word_ids(right.column("_payload").to_pylist())
        for k in kept:
            payload = left.column("_payload")[k].as_py()
            known = struct.unpack_from("<I", payload)[0]
            place = _plane_open(payload[4:]).astype(np.int64) - 1
            new = np.flatnonzero(place < 0)
            place[new] = known + np.arange(len(new))
            size = counts[place]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            step = np.arange(total) - np.repeat(ends - size, size) + np.repeat(starts[place], size)
            at.append(k)
            out.append(flat[step].astype("<u4").tobytes())
        return pa.table({"_doc": left.column("_doc").take(pa.array(at, pa.int64())), ids: pa.array(out, pa.binary())})

    both = rows.groupBy("_key").cogroup(replies.groupBy("_key"))
    return both.applyInArrow(assembled, schema).select("_doc.*", ids)


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes its ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f for f in encoded.schema.fields if f.name != name]
    schema = T.StructType(kept + [T.StructField(name, T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value.ranks
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for start, end in slices(column, 8 << 20):
                out = []
                for raw in column.slice(start, end - start):
                    found = [table[k] for k in np.frombuffer(raw.as_py() or b"", dtype="<u4").tolist()]
                    out.append(b"".join(found))
                part = batch.slice(start, end - start)
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out, pa.binary())], names + [name])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: token count, digest of the ids, digest of the decoded bytes."""
    encoded = encode(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), vocabulary)
    decoded = decode(encoded, vocabulary)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
