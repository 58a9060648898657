"""Removal of repeated stretches of words by seeds that are extended both ways.

A window is ``LENGTH`` consecutive words of a text. It is a repeat if its words also start
earlier: in a text of smaller id, or further up in the same text. Words of repeats go.

* Seeds: winnowing keeps, of every window, the stretch of ``SEED`` words with the least hash, the
  last of equal ones. Equal windows keep the same place, so a repeat always shares a seed. Neighbouring
  windows mostly keep the same one: a text has a seed for about ``(LENGTH - SEED + 2) / 2`` words.
* The seeds of all texts are joined with the seeds that occur in several texts. Each occurrence carries a
  hash of the seed extended both ways over all windows that keep it. If the first text with an
  equal extension is an earlier one, all these windows are repeats.
* Where the extension is new, but other texts hold the seed with other surroundings, the occurrence
  is extended word by word: the windows around the seed are looked up one by one. Of many texts
  with one extension only the first does this.
* Repeats inside one text are found in its own task. Adjoining repeats fuse to maximal ones.

No pair of occurrences is ever formed: a seed, extension or window meets its least id, which is
combined before the shuffle, so a passage in a third of all texts costs each of them one row for each seed.
Joins back to those rows are sort-merge joins, whose skewed keys adaptive execution splits.
Texts are shuffled once, by id, and not sorted; lists of what is repeated in a text are as long as
the text at most. Hashes have 128 bits where texts meet and 64 bits within a text.

Defined cases: a null text has no words and stays null; rows that share an id are not earlier
than each other; rows without id come last, in the order of a hash of their texts; a text
whose words are all repeats becomes empty; columns that have the names of results are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.batches import slices
from paneltide.session import materialized

#: Words of a window and of a seed.
LENGTH, SEED = 20, 6

_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Slice:
    """The words of some texts, one after another, their windows and seeds."""

    def __init__(self, texts: list[str | None]) -> None:
        self.cut = [(t or "").encode().split() for t in texts]
        size = np.array([len(w) for w in self.cut], dtype=np.int64)
        self.starts = np.cumsum(size) - size
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids = np.fromiter((number[w] for words in self.cut for w in words), np.int64, int(size.sum()))
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in number), dtype=">u8").reshape(-1, 2).astype(np.uint64)
        self.doc = np.repeat(np.arange(len(size)), size)
        room = np.repeat(self.starts + size, size) - np.arange(len(ids))
        self.windows = np.flatnonzero(room >= LENGTH)
        # sums over the words times powers of an odd base; a range is moved to power zero by the inverse
        self.sums, self.back = [], []
        for k, base in enumerate(_BASES):
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            power = np.cumprod(np.full(len(ids), base, np.uint64))
            self.back.append(np.cumprod(np.full(len(ids), inverse, np.uint64)))
            values = digests[ids, k] * power if len(ids) else np.zeros(0, np.uint64)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))))

    def hashes(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """A hash of each range of words."""
        size = (end - start).astype(np.uint64)
        return _mix((self.sums[k][end] - self.sums[k][start]) * self.back[k][start] + size * np.uint64(0xA24BAED4963EE407))

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By seed: the first and last window that keep it, its hash and that of its extension."""
        if not len(self.windows):
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
        at = np.arange(len(self.doc) - SEED + 1)
        seed = self.hashes(at, at + SEED, 0)
        value, place, width = seed, at, 1
        while width < LENGTH - SEED + 1:
            step = min(width, LENGTH - SEED + 1 - width)
            right = value[step:] <= value[:-step]
            place = np.where(right, place[step:], place[:-step])
            value = np.where(right, value[step:], value[:-step])
            width += step
        kept = place[self.windows]
        first = np.flatnonzero(np.diff(kept, prepend=-1))
        last = np.append(first[1:], len(kept)) - 1
        a, b = self.windows[first], self.windows[last]
        return a, b, seed[kept[first]], self.hashes(a, b + LENGTH, 1)

    def repeated_here(self) -> np.ndarray:
        """The windows whose words also start further up in the same text."""
        low, high = (self.hashes(self.windows, self.windows + LENGTH, k) for k in (0, 1))
        doc = self.doc[self.windows]
        again = np.flatnonzero(pd.Series(low + doc.astype(np.uint64) * _BASES[0]).duplicated(keep=False).to_numpy())
        same = pd.DataFrame({"d": doc[again], "x": low[again], "y": high[again]}).duplicated().to_numpy()
        return self.windows[again[same]]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchors(docs: DataFrame) -> DataFrame:
    """(seed, extension, id): the distinct seeds of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, high in slices(batch.column(1)):
                part = _Slice(batch.column(1).slice(low, high - low).to_pylist())
                a, _, seed, whole = part.seeds()
                doc = part.doc[a]
                order = np.lexsort((whole, seed, doc))
                doc, seed, whole = doc[order], seed[order], whole[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1]) | (whole[1:] != whole[:-1])
                yield pa.RecordBatch.from_arrays(
                    [_signed(seed[new]), _signed(whole[new]), pa.array(ids[low:high][doc[new]])], ["seed", "whole", "id"]
                )

    return docs.select("id", "text").mapInArrow(run, "seed long, whole long, id long")


def _marked(windows: np.ndarray, part: _Slice, wanted: list[np.ndarray | None], values: np.ndarray) -> np.ndarray:
    """Which of the ``values``, one for each window or seed that starts at ``windows``, their text wants."""
    doc = part.doc[windows]
    cuts = np.searchsorted(doc, np.arange(len(wanted) + 1))
    out = np.zeros(len(windows), bool)
    for k, some in enumerate(wanted):
        if some is not None and len(some):
            out[cuts[k] : cuts[k + 1]] = np.isin(values[cuts[k] : cuts[k + 1]].view(np.int64), some)
    return out


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All windows from ``a`` to ``b``."""
    size = b - a + 1
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    return [None if x.values is None else x.values.to_numpy() for x in column]


def _open_windows(placed: DataFrame) -> DataFrame:
    """(low, high, id): the windows of the seeds whose extensions are listed as ``open``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("id")).to_numpy(), batch.column(batch.schema.get_field_index("text"))
            wanted = batch.column(batch.schema.get_field_index("open"))
            for low, high in slices(texts):
                part = _Slice(texts.slice(low, high - low).to_pylist())
                a, b, _, whole = part.seeds()
                keep = _marked(a, part, _lists(wanted.slice(low, high - low)), whole)
                at = _spread(a[keep], b[keep])
                own = ids[low:high][part.doc[at]]
                yield pa.RecordBatch.from_arrays(
                    [*(_signed(part.hashes(at, at + LENGTH, k)) for k in (0, 1)), pa.array(own)], ["low", "high", "id"]
                )

    return placed.mapInArrow(run, "low long, high long, id long")


def _cut(marked: DataFrame, carried: list[T.StructField]) -> DataFrame:
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([
        T.StructField("row", T.StructType(carried)), T.StructField("kept", T.StringType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("repeats", spans),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for low, high in slices(column["text"]):
                texts = column["text"].slice(low, high - low).to_pylist()
                part = _Slice(texts)
                a, b, _, whole = part.seeds()
                seeds = _marked(a, part, _lists(column["whole"].slice(low, high - low)), whole)
                single = _marked(part.windows, part, _lists(column["single"].slice(low, high - low)), part.hashes(part.windows, part.windows + LENGTH, 0))
                edge = np.zeros(len(part.doc) + 1, np.int64)
                np.add.at(edge, a[seeds], 1)
                np.add.at(edge, b[seeds] + LENGTH, -1)
                for start in (part.repeated_here(), part.windows[single]):
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept, sizes, removed, lists = [], [], [], []
                for text, words, start in zip(texts, part.cut, part.starts.tolist()):
                    own = gone[start : start + len(words)]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist()
                    rest = words if not edges else [words[k] for k in np.flatnonzero(~own).tolist()]
                    kept.append(None if text is None else b" ".join(rest).decode())
                    sizes.append(len(words))
                    removed.append(len(words) - len(rest))
                    lists.append([{"start": s, "length": e - s} for s, e in zip(edges[::2], edges[1::2])])
                yield pa.RecordBatch.from_arrays(
                    [column["row"].slice(low, high - low), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(lists, pa.list_(_SPAN))],
                    schema.names,
                )

    return marked.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by the words that are left, joined by one space.

    Adds n_words, n_removed and ``repeats``, the maximal repeated stretches as (start, length) in words.
    """
    spark = docs.sparkSession
    own = [f for f in docs.schema.fields if f.name not in (text, "n_words", "n_removed", "repeats")]
    last = F.lit(2**63 - 1) - F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(2**32))
    whole = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), last).alias("id"),
        F.col(f"`{text}`").alias("text"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{f.name}`") for f in own]).alias("row"),
    )
    seeds = _anchors(whole)
    several = seeds.groupBy("seed").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.min("whole").alias("one"), F.max("whole").alias("other")
    ).where("first < last")
    shared = materialized(
        seeds.join(several, "seed").select("seed", "whole", "id", F.when(F.col("one") == F.col("other"), F.col("first")).alias("first"))
    )
    alone = shared.where("first is not null")  # every text extends the seed alike
    mixed = shared.where("first is null").drop("first")
    mixed = mixed.join(mixed.groupBy("seed", "whole").agg(F.min("id").alias("first")), ["seed", "whole"])
    covered = alone.where("first < id").select("id", "whole").union(mixed.where("first < id").select("id", "whole"))
    fresh = mixed.where("first = id").groupBy("id").agg(F.collect_set("whole").alias("open"))

    # one exchange of the texts; all its readers take all its columns, so that Spark keeps it once
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = whole.repartition(partitions, "id")
    windows = _open_windows(placed.join(fresh.hint("shuffle_hash"), "id"))
    first = windows.groupBy("low", "high").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    single = windows.join(first.drop("last"), ["low", "high"]).where("first < id").select("id", "low")
    marks = (
        covered.select("id", "whole", F.lit(None).cast("long").alias("low"))
        .union(single.select("id", F.lit(None).cast("long"), "low"))
        .groupBy("id")
        .agg(F.collect_set("whole").alias("whole"), F.collect_set("low").alias("single"))
    )
    cut = _cut(placed.join(marks.hint("shuffle_hash"), "id", "left"), whole.schema["row"].dataType.fields)
    columns = [
        F.col("kept").alias(text) if c == text else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
        if c == text or c in {f.name for f in own}
    ]
    return cut.select(*columns, "n_words", "n_removed", "repeats")
