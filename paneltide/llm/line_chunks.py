"""Removal of repeated passages of whole lines.

A line goes if it lies in a run of whole lines of more than ``LONG`` words that also begins at
an earlier place, by id and line. Such a run is covered by its shortest stretches: from each
line down to the first line, and from each line up to the last line, at which more than
``LONG`` words are reached. Each line has a hash, and a rolling hash runs over the hashes of
two lines. The least rolling hash inside a stretch is its anchor, so equal stretches have equal
anchors wherever they stand, and an inserted line moves anchors only near itself. First only
anchors are counted over the whole corpus. Around those that are found more than once the
stretches are told apart by a hash over their line hashes, taken from running sums. Repeated
ones are compared by bytes, different stretches that share a hash are parted, and the lines of
every occurrence but the first, by id and place, are removed.

The rule ``content_chunks`` is the coarser one that the SQL of ``op3_line_chunks`` states: each
line has a hash; a rolling hash over the hashes of a line and the one before it decides
whether a chunk ends after the line, so an inserted line moves boundaries only near itself. A
line of more than ``LONG`` words is a chunk of its own. Chunks of at least two lines with words
and ``LEAST`` words in all, and the long lines, are counted.

Counting moves only hashes, and its work grows with the lines. The texts are shuffled once, to meet the list of their repeated
stretches; of the bytes only those of repeated hashes move, and equal ones are combined
before the shuffle.

Defined cases: a null text stays null; rows that share an id and a text are the same
document and get the same result; a null id comes last in the order of occurrences; a
document whose lines are all removed keeps its row with an empty text.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paneltide.llm.batches import slices
from paneltide.session import materialized

#: The rolling hash is taken modulo PRIME over two lines; one line in EVERY ends a chunk.
PRIME, BASE, EVERY = (1 << 31) - 1, 1_000_003, 3
#: Modulus and bases of the rolling hash of anchors and of the hashes of stretches.
WIDE, BASES = (1 << 61) - 1, (1_000_000_007, 998_244_353)
#: Words of a chunk at least; words above which a line is a chunk of its own.
LEAST, LONG = 10, 50


def chunks(text: str) -> list[tuple[int, int, int, int]]:
    """Line ranges of the chunks with their words and lines with words: (start, end, words, lines)."""
    out: list[tuple[int, int, int, int]] = []
    start = words = filled = before = 0
    lines = text.encode().split(b"\n")
    for i, line in enumerate(lines):
        n = len(line.split())
        value = line_hash(line) % PRIME
        if n > LONG and i > start:
            out.append((start, i, words, filled))
            start, words, filled = i, 0, 0
        words, filled = words + n, filled + (n > 0)
        if n > LONG or (before * BASE + value) % PRIME % EVERY == 0:
            out.append((start, i + 1, words, filled))
            start, words, filled = i + 1, 0, 0
        before = value
    if start < len(lines):
        out.append((start, len(lines), words, filled))
    return out


def content_chunks(text: str) -> list[tuple[int, int]]:
    """Line ranges of the chunks that count."""
    return [(a, b) for a, b, words, filled in chunks(text) if words > LONG or filled >= 2 and words >= LEAST]


def stretches(sizes: Sequence[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The shortest ranges of more than ``LONG`` words down and up from each line, in order of their ends."""
    down: list[tuple[int, int]] = []
    end = words = 0
    for start, n in enumerate(sizes):
        while end < len(sizes) and words <= LONG:
            words, end = words + sizes[end], end + 1
        if words <= LONG:
            break
        down.append((start, end))
        words -= n
    up: list[tuple[int, int]] = []
    start, words = len(sizes), 0
    for end in range(len(sizes), 0, -1):
        while start and words <= LONG:
            start -= 1
            words += sizes[start]
        if words <= LONG:
            break
        up.append((start, end))
        words -= sizes[end - 1]
    return down, up[::-1]


def passages(text: str) -> list[tuple[int, int]]:
    """Line ranges of the shortest stretches of more than ``LONG`` words, down and up from each line."""
    down, up = stretches([len(line.split()) for line in text.encode().split(b"\n")])
    return sorted({*down, *up})


def anchors(lines: Sequence[int], sizes: Sequence[int]) -> dict[tuple[int, int], tuple[int, int]]:
    """For each stretch the line of its anchor and the anchor: the least rolling hash of two of its lines, or its only line's hash."""
    rolled = [(a * BASES[0] + b) % WIDE for a, b in zip(lines, lines[1:])]
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for family in stretches(sizes):
        least: deque[int] = deque()  # places of rolling hashes that may become the least, smallest first
        seen = 0
        for start, end in family:
            while seen < end - 1:
                while least and rolled[least[-1]] > rolled[seen]:
                    least.pop()
                least.append(seen)
                seen += 1
            while least and least[0] < start:
                least.popleft()
            out[start, end] = (least[0], rolled[least[0]]) if end - start > 1 else (start, lines[start])
    return out


def stretch_keys(lines: Sequence[int], ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two hashes of each range of line hashes, from running sums: the same work whatever its length."""
    columns = []
    for base in BASES:
        sums, powers = [0], [1]
        for value in lines:
            sums.append((sums[-1] * base + value + 1) % WIDE)
            powers.append(powers[-1] * base % WIDE)
        columns.append([(sums[b] - sums[a] * powers[b - a]) % WIDE for a, b in ranges])
    return list(zip(*columns))


def line_hash(line: bytes) -> int:
    return int(hashlib.md5(line).hexdigest()[:15], 16)


#: Maps a text to the line ranges that are counted; ranges may overlap.
Rule = Callable[[str], list[tuple[int, int]]]


def candidates(text: str | None, rule: Rule = passages) -> Iterator[tuple[int, bytes]]:
    """The ranges that are counted: number and bytes."""
    if text is None:
        return
    lines = text.split("\n")
    for k, (start, end) in enumerate(rule(text)):
        yield k, "\n".join(lines[start:end]).encode()


def without(text: str | None, numbers: set[int], rule: Rule = passages) -> tuple[str | None, int]:
    """The text without the lines of the numbered ranges, and how many lines went."""
    if not numbers or text is None:
        return text, 0
    ranges = rule(text)
    gone = {i for k in numbers for i in range(*ranges[k])}
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone), len(gone)


def _key(chunk: bytes) -> tuple[int, int]:
    digest = hashlib.md5(chunk).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _listed(docs: DataFrame, schema: T.StructType, rows, sized: str = "_text") -> DataFrame:
    """Rows that ``rows(batch row as dict)`` yields for each row of ``docs``, by slices of the bytes of column ``sized``."""
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(sized))
            for start, end in slices(texts):
                out = [r for row in batch.slice(start, end - start).to_pylist() for r in rows(row)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], type=kind) for i, (_, kind) in enumerate(arrow)], [n for n, _ in arrow]
                )

    return docs.mapInArrow(run, schema)


def _anchored(narrow: DataFrame, own: list[T.StructField]) -> DataFrame:
    """The stretches whose anchor is found more than once: _id, _hash, _no, k1, k2."""

    def lined(row):
        if row["_text"] is not None:
            lines = row["_text"].encode().split(b"\n")
            hashes, sizes = [line_hash(line) for line in lines], [len(line.split()) for line in lines]
            found = sorted(set(anchors(hashes, sizes).values()))
            if found:
                yield row["_id"], row["_hash"], np.array(hashes, "<i8").tobytes(), np.array(sizes, "<i4").tobytes(), [a for _, a in found]

    fields = [T.StructField("_lines", T.BinaryType()), T.StructField("_sizes", T.BinaryType())]
    fields.append(T.StructField("_anchors", T.ArrayType(T.LongType())))
    table = materialized(_listed(narrow, T.StructType(own + fields), lined))
    each = table.select("_id", "_hash", F.explode("_anchors").alias("anchor"))
    counts = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    wanted = each.join(counts, "anchor", "left_semi").groupBy("_id", "_hash").agg(F.collect_set("anchor").alias("_wanted"))
    wanted = wanted.select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_wanted")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))
    met = table.drop("_anchors").join(wanted.hint("shuffle_hash"), same).drop("_id2", "_hash2")

    def extended(row):
        lines, sizes = np.frombuffer(row["_lines"], "<i8").tolist(), np.frombuffer(row["_sizes"], "<i4").tolist()
        again, held = set(row["_wanted"]), anchors(lines, sizes)
        ranges = sorted(held)
        keep = [k for k, at in enumerate(ranges) if held[at][1] in again]
        return ((row["_id"], row["_hash"], k, *key) for k, key in zip(keep, stretch_keys(lines, [ranges[k] for k in keep])))

    keys = [T.StructField(n, T.LongType()) for n in ("_no", "k1", "k2")]
    return _listed(met, T.StructType(own + keys), extended, "_lines")


def dedup_chunks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rule: Rule = passages) -> DataFrame:
    """``docs`` with later occurrences of repeated ranges of lines cut out of its text.

    Adds n_chunks_removed, the ranges by ``rule`` that are repeats, and n_lines_removed.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(
        F.struct(*own).alias("_row"),
        F.col(f"`{doc_id}`").alias("_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("_hash"),
        F.col(f"`{text}`").alias("_text"),
    )
    id_field = T.StructField("_id", whole.schema["_id"].dataType)
    place = [id_field, T.StructField("_hash", T.LongType()), T.StructField("_no", T.LongType())]
    keys = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
    narrow = whole.select("_id", "_hash", "_text")
    if rule is passages:
        found = materialized(_anchored(narrow, place[:2]))
    else:
        found = materialized(
            _listed(narrow, T.StructType(place + keys), lambda r: ((r["_id"], r["_hash"], k, *_key(c)) for k, c in candidates(r["_text"], rule)))
        )
    at = F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "_no")
    repeated = found.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = found.join(repeated, ["k1", "k2"])
    lists = marked.groupBy("_id", "_hash").agg(  # the repeated ranges of one document
        F.collect_set(F.struct("_no", "k1", "k2", (at == F.col("first")).alias("first"))).alias("_marks")
    )
    lists = lists.select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_marks")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))
    # the lists of a partition are short next to its texts, so they are hashed and the texts stay unsorted
    joined = materialized(whole.drop("_text").join(lists.hint("shuffle_hash"), same, "left").drop("_id2", "_hash2"))

    # the bytes of all occurrences of a repeated hash, equal ones combined
    def texts(row):
        wanted = {m["_no"]: (m["k1"], m["k2"]) for m in row["_marks"]}
        return ((row["_id"], row["_hash"], k, *wanted[k], c) for k, c in candidates(row["_text"], rule) if k in wanted)

    chunk_rows = _listed(
        joined.where("_marks is not null").select("_id", "_hash", "_marks", F.col(f"_row.`{text}`").alias("_text")),
        T.StructType(place + keys + [T.StructField("chunk", T.BinaryType())]),
        texts,
    )
    kinds = chunk_rows.groupBy("k1", "k2", "chunk").agg(F.count("*").alias("n"))
    shared = materialized(kinds.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if not shared.isEmpty():  # different chunks with one hash: decide by the bytes
        clash = chunk_rows.join(shared, ["k1", "k2"])
        firsts = clash.groupBy("k1", "k2", "chunk").agg(F.min(at).alias("first"))
        decided = clash.join(firsts, ["k1", "k2", "chunk"]).groupBy("_id", "_hash").agg(
            F.collect_set(F.struct("_no", (at == F.col("first")).alias("first"))).alias("_own")
        ).select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_own")
        joined = joined.join(decided.hint("shuffle_hash"), same, "left").drop("_id2", "_hash2").withColumn(
            "_marks",
            F.transform(
                "_marks",
                lambda m: F.struct(
                    m["_no"].alias("_no"),
                    m["k1"].alias("k1"),
                    m["k2"].alias("k2"),
                    F.coalesce(
                        F.get(F.filter("_own", lambda o: o["_no"] == m["_no"]), F.lit(0))["first"], m["first"]
                    ).alias("first"),
                ),
            ),
        ).drop("_own")
    gone = F.coalesce(
        F.transform(F.filter("_marks", lambda m: ~m["first"]), lambda m: m["_no"]), F.array().cast("array<bigint>")
    )
    results = {"n_chunks_removed", "n_lines_removed"}
    cut = _cut(joined.select("_row", F.col(f"_row.`{text}`").alias("_text"), gone.alias("_gone")), rule)
    kept = [
        F.col("_kept").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in results
    ]
    return cut.select(*kept, F.size("_gone").cast("long").alias("n_chunks_removed"), "n_lines_removed")


def _cut(joined: DataFrame, rule: Rule) -> DataFrame:
    schema = T.StructType(joined.schema.fields + [T.StructField("_kept", T.StringType()), T.StructField("n_lines_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for start, end in slices(texts):
                part = batch.slice(start, end - start)
                pairs = [without(t, set(g or ()), rule) for t, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())],
                    schema.names,
                )

    return joined.mapInArrow(run, schema)
