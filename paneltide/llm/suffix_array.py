"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is a slice of documents inside a task. Its words become numbers of the
test vocabulary; only stretches in which every two neighbouring words are also
neighbours in a test text can hold a match, and over these stretches the shard's
suffix array is built. Every test suffix is binary-searched in it; the range of
training suffixes that share its window gives the verbatim occurrences. Nothing is
shuffled: the test texts go to the tasks in blocks of bounded size, one block a pass.

Defined cases: a null text has no words; a test text of fewer words than the window
is one window of its own length, one without words is never matched; rows that
repeat an item id are one item; a null item id is an item with the empty id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.batches import free_name, slices
from paneltide.session import materialized

WINDOW = 10
#: Bytes of test text in one block, and so in one broadcast, unless one item alone is longer.
BLOCK_BYTES = 4 << 20
#: Bytes of training text in one shard.
SHARD_BYTES = 2 << 20
#: Bytes whose powers and running sums are held at a time, unless one word alone is longer.
PIECE_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("up", self.BASE), ("down", inverse)):
                grown = np.full(size, base, dtype=np.uint64)
                grown[0] = 1
                setattr(self, name, np.cumprod(grown, dtype=np.uint64))
        return self.up, self.down


POWERS = Powers()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in texts that lie one after another in ``data``."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = _IS_WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words, which depend on their bytes alone. ``starts`` and ``ends`` ascend."""
    value = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        stop = max(first + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
        begin, end = starts[first:stop] - base, ends[first:stop] - base
        piece = data[base : base + int(end[-1])]
        up, down = POWERS.upto(len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        value[first:stop] = (total[end] - total[begin]) * down[begin]
        first = stop
    return value ^ (value >> np.uint64(29))


def suffix_array(values: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``values`` sorted by the suffixes that start there, by prefix doubling.

    ``depth`` bounds how many values any two suffixes can share.
    """
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step <= depth and n:
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        moved = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(moved[1:] != moved[:-1])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1:
            break
    return order


def common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray):
    """Shared length of suffixes ``a[i:]`` and ``b[j:]`` up to ``most``, and whether a < b there."""
    length = np.zeros(len(i), dtype=np.int64)
    less = np.zeros(len(i), dtype=bool)
    active = np.flatnonzero(most > 0)
    while active.size:
        x, y = a[i[active] + length[active]], b[j[active] + length[active]]
        same = x == y
        less[active[~same]] = x[~same] < y[~same]
        active = active[same]
        length[active] += 1
        active = active[length[active] < most[active]]
    return length, less


def search(a: np.ndarray, i: np.ndarray, most: np.ndarray, b: np.ndarray, order: np.ndarray, upper: bool):
    """First place in ``order`` whose suffix of ``b`` is not before (``upper``: is after) ``a[i:]`` cut at ``most``."""
    lo, hi = np.zeros(len(i), dtype=np.int64), np.full(len(i), len(order), dtype=np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not open_.size:
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        length, less = common(a, i[open_], b, order[mid], most[open_])
        full = length >= most[open_]
        right = full if upper else np.zeros(len(mid), dtype=bool)
        right = right | (~full & ~less)
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


class TestBlock:
    """Test texts as one string of word numbers with its suffix array and distinct windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        data = np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8)
        offsets = np.cumsum([0] + [len(t) for _, t in items])
        data = _LOWER[data]
        starts, ends = word_spans(data, offsets)
        raw = data.tobytes()
        words = [raw[s:e] for s, e in zip(starts, ends)]
        of = np.searchsorted(offsets, starts, side="right") - 1
        vocabulary = list(dict.fromkeys(words))
        lengths = np.array([len(w) for w in vocabulary], dtype=np.int64)
        at = np.cumsum(np.concatenate([[0], lengths]))[:-1].astype(np.int64)
        flat = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
        hashes = word_hashes(flat, at, at + lengths) if vocabulary else np.zeros(0, np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two test words share a hash; change Powers.BASE")
        by_hash = np.argsort(hashes)
        self.hashes = hashes[by_hash]
        self.vocabulary = [vocabulary[k] for k in by_hash]
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.ids = np.array([number[w] for w in words] + [-1], dtype=np.int64)
        # -1 after each item, so that no suffix runs into the next one
        gaps = np.flatnonzero(of[1:] != of[:-1]) + 1 if len(of) else np.zeros(0, np.int64)
        self.ids = np.insert(self.ids, gaps, -1)
        self.item = np.append(np.insert(of, gaps, -1), -1) if len(of) else np.array([-1])
        self.names = [name for name, _ in items]
        is_word = self.ids >= 0
        edge = np.flatnonzero(~is_word)
        self.left = edge[np.searchsorted(edge, np.arange(len(self.ids)))] - np.arange(len(self.ids))
        first = np.concatenate([[0], edge[:-1] + 1]).astype(np.int64)
        self.offset = np.arange(len(self.ids)) - first[np.searchsorted(first, np.arange(len(self.ids)), side="right") - 1]
        size = self.left + self.offset
        need = np.minimum(window, size)
        begins = np.flatnonzero(is_word & (self.left >= need) & (need > 0))
        classes: dict[tuple[int, ...], int] = {}
        owners: list[set[str]] = []
        self.window_at, self.window_len = [], []
        for p in begins.tolist():
            key = tuple(self.ids[p : p + need[p]].tolist())
            if key not in classes:
                classes[key] = len(owners)
                owners.append(set())
                self.window_at.append(p)
                self.window_len.append(len(key))
            owners[classes[key]].add(self.names[self.item[p]])
        self.owners = [sorted(o) for o in owners]
        self.window_at = np.array(self.window_at, dtype=np.int64)
        self.window_len = np.array(self.window_len, dtype=np.int64)
        self.shortest = int(self.window_len.min()) if len(owners) else 0
        size = len(self.vocabulary) + 1
        pairs = self.ids[:-1] * size + self.ids[1:]
        self.pairs = np.unique(pairs[(self.ids[:-1] >= 0) & (self.ids[1:] >= 0)])
        self.order = suffix_array(self.ids, int(self.left.max()) if len(self.ids) else 0)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers by hash; -1 for words of no test text."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[some]
        found[some[same]] = at[same]
        return found


def shard_matches(block: TestBlock, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, dict]]:
    """Word counts of the texts of one shard, and by text its hit spans, items and longest match."""
    data = _LOWER[data]
    starts, ends = word_spans(data, offsets)
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    n_texts = len(offsets) - 1
    counts = np.bincount(text_of, minlength=n_texts).astype(np.int64)
    if not len(starts) or not len(block.owners):
        return counts, {}
    ids = block.lookup(word_hashes(data, starts, ends))
    n = len(ids)
    linked = np.zeros(n, dtype=bool)  # with the word before
    both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & (text_of[1:] == text_of[:-1])) + 1
    if both.size and block.pairs.size:
        key = ids[both - 1] * (len(block.vocabulary) + 1) + ids[both]
        at = np.minimum(np.searchsorted(block.pairs, key), len(block.pairs) - 1)
        linked[both[block.pairs[at] == key]] = True
    begin = np.flatnonzero((ids >= 0) & ~linked)
    stop = np.flatnonzero((ids >= 0) & ~np.append(linked[1:], False)) + 1
    long = (stop - begin) >= block.shortest
    begin, stop = begin[long], stop[long]
    if not begin.size:
        return counts, {}
    # the stretches one after another, each followed by a number of its own
    sizes = stop - begin
    place = np.arange(int(sizes.sum() + len(sizes)))
    run = np.repeat(np.arange(len(sizes)), sizes + 1)
    within = place - np.concatenate([[0], np.cumsum(sizes + 1)])[:-1][run]
    is_word = within < sizes[run]
    word = np.minimum(begin[run] + within, n - 1)
    values = np.where(is_word, ids[word], len(block.vocabulary) + 1 + run)
    raw = data.tobytes()
    for p in np.flatnonzero(is_word).tolist():  # words with the hash of a test word, byte by byte
        w = word[p]
        if raw[starts[w] : ends[w]] != block.vocabulary[values[p]]:
            values[p] = len(block.vocabulary) + 1 + len(sizes) + p
    order = suffix_array(values, int(sizes.max()))
    lo = search(block.ids, block.window_at, block.window_len, values, order, upper=False)
    hi = search(block.ids, block.window_at, block.window_len, values, order, upper=True)
    some = np.flatnonzero(hi > lo)
    found: dict[int, dict] = {}
    if not some.size:
        return counts, found
    number = (hi - lo)[some]
    kind = np.repeat(some, number)
    rank = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + np.repeat(lo[some], number)
    where = order[rank]
    # the longest match of each training suffix that begins an occurrence
    at = np.unique(where)
    limit = np.full(len(at), len(values), dtype=np.int64)
    near = search(values, at, limit, block.ids, block.order, upper=False)
    best, best_at = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for side in (near - 1, near):
        ok = np.flatnonzero((side >= 0) & (side < len(block.order)))
        length, _ = common(values, at[ok], block.ids, block.order[side[ok]], limit[ok])
        better = length > best[ok]
        best[ok[better]], best_at[ok[better]] = length[better], block.order[side[ok[better]]]
    first_word = np.concatenate([[0], np.cumsum(counts)])
    texts = text_of[word[where]]
    by_text = np.argsort(texts, kind="stable")
    groups = np.split(by_text, np.flatnonzero(np.diff(texts[by_text])) + 1)
    for group in groups:
        t = int(texts[group[0]])
        base = first_word[t]
        spans = np.stack([word[where[group]] - base, word[where[group]] - base + block.window_len[kind[group]]], 1)
        items: set[str] = set()
        for k in np.unique(kind[group]).tolist():
            items.update(block.owners[k])
        own = np.searchsorted(at, np.unique(where[group]))
        top = own[np.argmax(best[own])]
        found[t] = {
            "spans": merged(spans.tolist()),
            "items": items,
            "longest": (int(best[top]), block.names[block.item[best_at[top]]], int(block.offset[best_at[top]]), int(word[at[top]] - base)),
        }
    return counts, found


def merged(spans: list) -> list[list[int]]:
    """Sorted spans without overlap."""
    out: list[list[int]] = []
    for s, e in sorted((int(a), int(b)) for a, b in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


MATCHES = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()),
    T.StructField("longest_item", T.StringType()),
    T.StructField("longest_item_word", T.LongType()),
    T.StructField("longest_doc_word", T.LongType()),
])
_MATCH = "_test_matches"


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for i, t in rows.where("t is not null").toLocalIterator():
        raw = t.encode()
        if block and size + len(raw) > limit:
            yield block
            block, size = [], 0
        block.append((i or "", raw))
        size += len(raw)
    yield block


def _pass(docs: DataFrame, text: str, block: TestBlock, shard_bytes: int, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_BYTES of text
    earlier = name in docs.columns
    schema = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, MATCHES)])
    names = [f.name for f in schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for start, end in slices(texts, shard_bytes):
                part = batch.slice(start, end - start)
                raw = pa.compute.fill_null(texts.slice(start, end - start), "").cast(pa.large_binary())
                offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
                data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
                counts, found = shard_matches(test, data, offsets - offsets[0])
                old = part.column(part.schema.get_field_index(name)).to_pylist() if earlier else [None] * len(raw)
                out = []
                for k in range(len(raw)):
                    new = found.get(k, {"spans": [], "items": set(), "longest": (0, None, None, None)})
                    spans, items, longest = new["spans"], new["items"], new["longest"]
                    if (o := old[k]) is not None:
                        spans, items = merged(spans + o["spans"]), items | set(o["items"])
                        if o["longest_match"] >= longest[0]:
                            longest = tuple(o[f.name] for f in MATCHES.fields[3:])
                    out.append((int(counts[k]), spans, sorted(items), *longest))
                columns = [part.column(part.schema.get_field_index(n)) for n in names]
                kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                fields = [pa.array([r[i] for r in out], type=kinds[i]) for i in range(len(kinds))]
                columns.append(pa.StructArray.from_arrays(fields, MATCHES.names))
                yield pa.RecordBatch.from_arrays(columns, names + [name])

    return docs.mapInArrow(run, schema)


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
    name: str = _MATCH,
) -> DataFrame:
    """``docs`` with one more column, ``name``: word count, hit spans, items, longest match.

    One pass over ``docs`` for each block of test text; passes after the first read
    what the one before wrote, so a task never holds more than one block. A column of
    ``docs`` that has the name of the new one is replaced.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    block = next(blocks)
    docs = docs.drop(name)
    while True:
        docs = _pass(docs, text, TestBlock(block, window), shard_bytes, name)
        block = next(blocks, None)
        if block is None:
            return docs
        docs = materialized(docs)


def match_report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: counts, items with their digest, verdict, longest match and places."""
    m = F.col(_MATCH)
    spans = m["spans"]
    text = options.get("text", "text")
    found = find_matches(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), benchmark, **options)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return found.select(
        F.col(f"`{doc_id}`"),
        m["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
        m["longest_match"].alias("longest_match"),
        m["longest_item"].alias("longest_item"),
        m["longest_item_word"].alias("longest_item_word"),
        m["longest_doc_word"].alias("longest_doc_word"),
        spans.alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of a test text."""
    name = free_name(docs, _MATCH)
    found = find_matches(docs, benchmark, name=name, **options)
    return found.where(F.size(F.col(name)["spans"]) == 0).drop(name)


def plain_report(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple:
    """The report's first columns for one text by comparing every place; for tests."""
    import re

    def words(t):
        low = re.sub("[A-Z]", lambda c: c[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    own, hit, names = words(text), set(), set()
    for name, t in items:
        w = words(t)
        size = min(window, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for p in range(len(own) - size + 1 if size else 0):
            if tuple(own[p : p + size]) in windows:
                hit.update(range(p, p + size))
                names.add(name)
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(own), len(hit), len(names), digest, bool(hit)
