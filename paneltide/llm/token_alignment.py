"""Alignment of the tokens of two tokenizers, text by text, and how often token ids meet.

Both tokenizers encode a text, and the bytes of their tokens are added up. The ends where tokens
of both stop are the hash-set intersection of two end-to-index dictionaries; taken in order, they
slice both id lists into groups, the smallest stretches that both tokenizers cut out. Within a
slice each end of either side closes one overlap of a token with a token, which is a link.

How often a pair of ids is linked is a matter of the whole corpus. Each task numbers the
distinct pairs of a block of texts, by frequency, and writes one row per text (packed numbers
and multiplicities) and one row per pair and block. Pair rows are summed by pair and the most
frequent partner of each id of the second vocabulary is found; sums go back to the blocks that
have the pair, and meet their texts there. A pair is one row in each block, however frequent it is, so no
key grows with a frequent pair but by one row a block; no text moves. Memory: one block, or one text
if it is longer; the dictionaries hold ``STRETCH`` bytes of a text at a time.

Defined cases: a text that is null or empty, or whose tokens of either side do not spell a space
and the text, has no tokens: counts are zero and its groups an empty string. Equal rows are
separate rows and count each. Columns that have the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.batches import append_columns, slices
from paneltide.session import materialized

#: Bytes of text in a block, unless one text alone is longer; bytes whose ends are in the dictionaries at a time.
BLOCK_BYTES, STRETCH = 8 << 20, 1 << 20

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class RankedBytes:
    """Byte-level BPE of a vocabulary file in JSON whose merges are in order of their ids; gives a space first."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if made != list(range(256, 256 + len(merges))):
            raise ValueError("merges are not in order of their ids")
        special = [t for t, i in model["vocab"].items() if i >= 256 + len(merges)]
        self.ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.pattern = pattern

    def table(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    def encoder(self):
        encode = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        return lambda texts: [encode(" " + t) for t in texts]


class Pieces:
    """Sentence pieces with byte fallback; the model adds the space itself."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.model = file.read()

    def _processor(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def table(self) -> list[bytes]:
        model = self._processor()
        return [
            bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()
            for k in range(model.get_piece_size())
            for p in [model.id_to_piece(k)]
        ]

    def encoder(self):
        model = self._processor()
        return lambda texts: model.encode(texts, num_threads=1)


class _Aligner:
    """Groups and links of texts by the tokens of two tokenizers."""

    def __init__(self, first, second) -> None:
        self.encode = first.encoder(), second.encoder()
        self.tokens = first.table(), second.table()
        self.sizes = [np.array([len(t) for t in table], dtype=np.int64) for table in self.tokens]
        self.base = len(self.tokens[1])
        ids = [[b"%d" % k for k in range(len(table))] for table in self.tokens]
        self.names = [np.array([x + b"," for x in own] + [x + last for x in own], dtype=object) for own, last in zip(ids, (b"|", b";"))]

    def spelled(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides; nothing for a text that they do not spell."""
        given = [t or "" for t in texts]
        out = []
        for t, a, b in zip(given, *(encode(given) for encode in self.encode)):
            whole = b" " + t.encode()
            ok = t and all(b"".join([table[k] for k in ids]) == whole for table, ids in zip(self.tokens, (a, b)))
            out.append((np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) if ok else None)
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ends of both sides, and the numbers of the tokens of both sides that end a group."""
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        last_a: list[int] = []
        last_b: list[int] = []
        for low in range(0, int(ends_a[-1]), STRETCH):
            known = []
            for ends in (ends_a, ends_b):
                i, j = np.searchsorted(ends, (low, low + STRETCH), side="right").tolist()
                known.append(dict(zip(ends[i:j].tolist(), range(i, j))))
            common = sorted(known[0].keys() & known[1].keys())
            last_a += [known[0][e] for e in common]
            last_b += [known[1][e] for e in common]
        return ends_a, ends_b, np.array(last_a), np.array(last_b)

    def named(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of the groups."""
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        out = np.empty(len(a) + len(b), dtype=object)
        before = np.concatenate(([0], last_b[:-1] + 1))  # tokens of the other side in earlier groups
        out[np.arange(len(a)) + before[group_a]] = self.names[0][a + len(self.tokens[0]) * closes_a]
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = self.names[1][b + len(self.tokens[1]) * closes_b]
        return b"".join(out.tolist())[:-1]

    def links(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
        """The pairs of ids that are linked, in order, as one number each."""
        closed_a, closed_b = np.zeros(ends_a[-1] + 1, np.int32), np.zeros(ends_a[-1] + 1, np.int32)
        closed_a[ends_a], closed_b[ends_b] = 1, 1
        ends = np.flatnonzero(closed_a | closed_b)
        at_a, at_b = np.cumsum(closed_a)[ends - 1], np.cumsum(closed_b)[ends - 1]
        return a[at_a] * self.base + b[at_b]


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return planes.tobytes()


def _open(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def with_groups(docs: DataFrame, first, second, *, text: str = "text", name: str = "groups") -> DataFrame:
    """``docs`` with the ids of its groups, ``a1,a2|b1;a3|b2,b3``."""
    shared = docs.sparkSession.sparkContext.broadcast((first, second))  # two vocabulary files

    def compute():
        aligner = _Aligner(*shared.value)

        def apply(texts):
            both = aligner.spelled(texts)
            return {name: [aligner.named(*x, *aligner.groups(*x)[2:]).decode() if x else "" for x in both]}

        return apply

    return append_columns(docs, text, [T.StructField(name, T.StringType())], compute)


def _blocks(docs: DataFrame, first, second, text: str) -> DataFrame:
    """One row per text, with its result so far and the packed numbers of its pairs, and one per pair and block."""
    shared = docs.sparkSession.sparkContext.broadcast((first, second))  # two vocabulary files
    results = {*COUNTS, "groups_sha256", "n_best", "count_sum"}
    carried = [f for f in docs.schema.fields if f.name != text and f.name not in results]
    found = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("groups_sha256", T.StringType())]
    pair = [T.StructField(c, T.LongType()) for c in ("no", "a", "b", "n")]
    schema = T.StructType([
        T.StructField("block", T.BinaryType()), T.StructField("pairs", T.BinaryType()), T.StructField("doc", T.StructType(carried + found)), *pair
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(*shared.value)
        pack = zstandard.ZstdCompressor(level=3).compress
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            own = [batch.schema.field(f.name) for f in carried]
            kind = pa.struct(own + [(c, pa.int64()) for c in COUNTS] + [("groups_sha256", pa.string())])
            for start, end in slices(texts, BLOCK_BYTES):
                rows, links = [], []
                content = xxhash.xxh3_128()
                for low, high in slices(texts.slice(start, end - start), 1 << 18):
                    part = texts.slice(start + low, high - low).to_pylist()
                    for x in aligner.spelled(part):
                        if x is None:
                            rows.append((0, 0, 0, 0, ""))
                            links.append(np.zeros(0, np.int64))
                            continue
                        ends_a, ends_b, last_a, last_b = aligner.groups(*x)
                        links.append(aligner.links(*x, ends_a, ends_b))
                        digest = hashlib.sha256(aligner.named(*x, last_a, last_b)).hexdigest()
                        content.update(digest)
                        rows.append((len(x[0]), len(x[1]), len(last_a), len(links[-1]), digest))
                number, pairs = pd.factorize(np.concatenate(links))
                count = np.bincount(number, minlength=len(pairs))
                order = np.argsort(-count, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                packed, at = [], 0
                for own_links in links:
                    mine, times = np.unique(rank[number[at : at + len(own_links)]], return_counts=True)
                    at += len(own_links)
                    packed.append(pack(_pack(np.diff(mine, prepend=0)) + _pack(times)))
                block = struct.pack("<QQ", task, made) + content.digest()
                made += 1
                n = end - start
                part = batch.slice(start, n)
                done = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 4 + [pa.string()])]
                doc = pa.StructArray.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in carried] + done, fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.binary()), pa.array(packed, pa.binary()), doc, *[pa.nulls(n, pa.int64())] * 4], schema.names
                )
                m = len(pairs)
                pairs = pairs[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, kind)]
                    + [pa.array(v) for v in (np.arange(m), pairs // aligner.base, pairs % aligner.base, count[order])],
                    schema.names,
                )

    return docs.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """How often each pair of ids is linked, and whether no other first id has more links with the second."""
    counts = blocks.where("pairs is null").groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, first, second, *, text: str = "text") -> DataFrame:
    """(a, b, count, best) of all texts of ``docs``."""
    return pair_counts(_blocks(docs.select(F.col(f"`{text}`").alias("text")), first, second, "text"))


def align(docs: DataFrame, first, second, *, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the numbers of tokens, groups and links, the digest of the groups,
    n_best (links whose pair is a most frequent one of its second id) and count_sum (the links' counts).
    """
    blocks = materialized(_blocks(docs, first, second, text))  # read by the sums, the replies and the texts
    counts = pair_counts(blocks)
    replies = blocks.where("pairs is null").join(counts, ["a", "b"]).select(F.col("block").alias("asked"), "no", "count", "best")
    rows = blocks.where("pairs is not null").select("block", "pairs", "doc")
    made = blocks.schema["doc"].dataType.fields
    schema = T.StructType([T.StructField("doc", T.StructType(made)), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        unpack = zstandard.ZstdDecompressor().decompress
        count = np.zeros(len(right), np.int64)
        best = np.zeros(len(right), np.int64)
        place = right.column("no").to_numpy()
        count[place] = right.column("count").to_numpy()
        best[place] = right.column("best").to_numpy()
        sums = []
        for value in left.column("pairs"):
            both = unpack(value.as_py())
            mine, times = np.cumsum(_open(both[: len(both) // 2])), _open(both[len(both) // 2 :])
            sums.append((int((times * best[mine]).sum()), int((times * count[mine]).sum())))
        return pa.table({
            "doc": left.column("doc"),
            "n_best": pa.array([s[0] for s in sums], pa.int64()),
            "count_sum": pa.array([s[1] for s in sums], pa.int64()),
        })

    both = rows.groupBy("block").cogroup(replies.groupBy("asked"))
    return both.applyInArrow(summed, schema).select("doc.*", "n_best", "count_sum")
