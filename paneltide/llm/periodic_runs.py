"""Periodic runs of the words of a text, found with string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and
``COPIES`` periods long, that no neighbouring word extends. Many texts are searched at once,
one after another in one array with a distinct separator after each.

* Periods below ``BASE * 3 / 2``: the array is compared with itself moved by the period. This is
  also how the highly periodic regions come to be known that the smallest scales leave out.
* At scale t = 8, 16, 32, … every stretch of t words has a hash. A stretch inside a region of
  period t/3 or less does not count. Position i belongs to the synchronising set if the least hash
  that counts among the stretches at i, …, i + t is that of i or of i + t. This is a matter of the
  2t words from i on alone, so a run of period q from 3t/2 up to 3t holds some i of the set such that
  i + q belongs to it too, with the same 2t words. Pairs of the set at such distances whose
  2t words have one hash propose periods; each is extended word by word both ways.
* A stretch whose period is not its smallest has the ends of a run of smaller period, which an
  earlier scale or comparison has found, and is left out.

Hashes only propose; periods and ends come from comparing words. Each text is a unit of one
task and no text moves. A set has at most a bounded number of positions per t words (stretches
of equal hash closer than t/3 lie in regions that do not count), so time grows by the length
times its logarithm. Memory: one slice of texts, or one text if it is longer.

Defined cases: a null or empty text has no runs and collapses to an empty text; equal rows
are separate rows; columns that have the names of results are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.batches import free_name, slices

#: Words and periods of a run at least; the smallest scale.
LEAST, COPIES, BASE = 24, 3, 8

_FAR = np.uint64(2**64 - 1)
_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ahead(values: np.ndarray, by: int, fill=0) -> np.ndarray:
    """``values`` as seen ``by`` places further on."""
    out = np.full_like(values, fill)
    if by < len(values):
        out[: len(values) - by] = values[by:]
    return out


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of stretches twice as long."""
    return _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + _ahead(hashes, size))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of true values start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _first_difference(words: np.ndarray, at: int, period: int) -> int:
    size = 64
    while True:
        later = words[at + period : at + period + size]
        differ = np.flatnonzero(words[at : at + len(later)] != later)
        if len(differ):
            return at + int(differ[0])
        at += len(later)
        if len(later) < size:
            return at
        size *= 2


def _last_difference(words: np.ndarray, at: int, period: int) -> int:
    """The least start from which on the words up to ``at`` equal those a period later."""
    size = 64
    while at:
        low = max(at - size, 0)
        differ = np.flatnonzero(words[low:at] != words[low + period : at + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, size = low, size * 2
    return 0


class _Found:
    """Stretches by text; the first period of a stretch is its smallest, as they come by period."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int, int], int] = {}

    def add(self, doc: int, start: int, end: int, period: int) -> None:
        self.period.setdefault((doc, start, end), period)

    def periodic(self, size: int) -> Iterator[tuple[int, int, int]]:
        """Regions with stretches of ``size`` words whose period is at most a third of them."""
        return (k for k, p in self.period.items() if 3 * p <= size <= k[2] - k[1])

    def runs(self, docs: int) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(docs)]
        for (doc, start, end), period in self.period.items():
            if end - start >= max(LEAST, COPIES * period):
                out[doc].append((start, end - start, period))
        return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each array of word numbers its runs: (start, length, period) by start, then period."""
    found = _Found()
    size = np.array([len(t) for t in texts], dtype=np.int64)
    live = np.flatnonzero(size >= min(LEAST, BASE))
    words, starts, docs = _joined(texts, live)
    if not len(live):
        return found.runs(len(texts))
    for q in range(1, BASE * 3 // 2):
        for a, b in zip(*_stretches(words[:-q] == words[q:])):
            if b - a + q >= max(BASE, COPIES * q):
                k = docs[a]
                found.add(int(live[k]), int(a - starts[k]), int(b + q - starts[k]), q)
    t = BASE
    hashes = _mix(words.astype(np.uint64))
    for step in range(t.bit_length() - 1):
        hashes = _doubled(hashes, 1 << step)
    while True:
        keep = size[live] * 2 >= 9 * t  # three periods of 3t/2 words
        if not keep.any():
            return found.runs(len(texts))
        if not keep.all():
            inside = keep[docs]
            live, hashes = live[keep], hashes[inside]
            words, starts, docs = _joined(texts, live)
        double = _doubled(hashes, t)
        _scale(t, words, hashes, double, starts, docs, live, size, found)
        t, hashes = 2 * t, double


def _joined(texts: list[np.ndarray], live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The live texts with a separator of its own after each, their starts, and the text of each place."""
    parts = [p for k in live for p in (texts[k], [-1 - k])]
    words = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    length = np.array([len(texts[k]) + 1 for k in live], dtype=np.int64)
    return words, np.cumsum(length) - length, np.repeat(np.arange(len(live)), length)


def _scale(t, words, hashes, double, starts, docs, live, size, found: _Found) -> None:
    place = np.arange(len(words)) - starts[docs]
    room = size[live][docs] - place
    counted = hashes.copy()
    number = {int(k): n for n, k in enumerate(live)}
    for doc, a, b in found.periodic(t):
        if doc in number:
            base = starts[number[doc]]
            counted[base + a : base + b - t + 1] = _FAR
    least, step = counted, 1
    while step < t:
        least, step = np.minimum(least, _ahead(least, step, _FAR)), 2 * step
    ahead = _ahead(counted, t, _FAR)
    least = np.minimum(least, ahead)
    chosen = np.flatnonzero((room >= 2 * t) & (least != _FAR) & ((counted == least) | (ahead == least)))
    context = double[chosen]
    at, periods = [], []
    for lag in range(1, len(chosen)):
        gap = chosen[lag:] - chosen[:-lag]
        near = gap < 3 * t
        if not near.any():
            break
        pair = np.flatnonzero(near & (2 * gap >= 3 * t) & (context[lag:] == context[:-lag]))
        at.append(chosen[pair])
        periods.append(gap[pair])
    if not at:
        return
    at, periods = np.concatenate(at), np.concatenate(periods)
    order = np.lexsort((at, periods))
    period = until = 0
    for i, q in zip(at[order].tolist(), periods[order].tolist()):
        if q == period and i < until:  # inside the stretch just extended
            continue
        start, period, until = _last_difference(words, i, q), q, _first_difference(words, i, q)
        if until + q - start >= max(LEAST, COPIES * q):
            k = docs[start]
            found.add(int(live[k]), int(start - starts[k]), int(until + q - starts[k]), q)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are not a repetition inside a run."""
    out, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        out += words[at : max(at, start)]
        at = max(at, end)
    return b" ".join(out + words[at:])


def with_runs(
    docs: DataFrame,
    *,
    text: str = "text",
    key: str | None = None,
    rewrite: Rewrite | None = None,
    runs: str = "runs",
    kept: str = "collapsed",
) -> DataFrame:
    """``docs`` with the runs of its text, by start and period, and the text without repetitions.

    ``rewrite`` may change the words of a row before they are searched; it is given the row's ``key``.
    """
    carried = [c for c in docs.columns if c not in (runs, kept)]
    hidden, named = free_name(docs, "_words_of"), free_name(docs, "_key_of")
    source = docs.select(
        *[F.col(f"`{c}`") for c in carried],
        F.col(f"`{text}`").alias(hidden),
        (F.col(f"`{key}`") if key else F.lit(None).cast("string")).alias(named),
    )
    schema = T.StructType(
        [docs.schema[c] for c in carried] + [T.StructField(runs, T.ArrayType(_RUN)), T.StructField(kept, T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(hidden))
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                number: dict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                cut = [(t or "").encode().split() for t in texts.slice(a, b - a).to_pylist()]
                if rewrite is not None:
                    keys = part.column(part.schema.get_field_index(named)).to_pylist()
                    cut = [rewrite(k, w) for k, w in zip(keys, cut)]
                found = find_runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in cut])
                lists = [[dict(zip(_RUN.names, x)) for x in r] for r in found]
                rest = [collapsed(w, r).decode() for w, r in zip(cut, found)]
                columns = [part.column(part.schema.get_field_index(c)) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lists, pa.list_(_ARROW_RUN)), pa.array(rest, pa.string())], schema.names
                )

    return source.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones the first by start, then period."""
    none = F.lit(None).cast(_RUN)

    def better(best: Column, run: Column) -> Column:
        ours, theirs = run["length"] * best["period"], best["length"] * run["period"]
        before = (run["start"] < best["start"]) | ((run["start"] == best["start"]) & (run["period"] < best["period"]))
        return F.when(best.isNull() | (ours > theirs) | ((ours == theirs) & before), run).otherwise(best)

    return F.aggregate(runs, none, better)
