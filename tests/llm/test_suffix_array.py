import random
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paneltide.llm import suffix_array as S

WORDS = "the of and to in is über naïve x1 9 thing".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    items = [(str(k), text(rng, rng.choice([12, 25, 40]))) for k in range(12)]
    items += [("short", "naïve über thing x1"), ("one", "unique"), ("none", "?!"), ("short", "thing 9 9 9"), ("dup", items[0][1])]
    docs = [text(rng, rng.randint(0, 60)) for _ in range(25)]
    for k in range(10):
        words = items[k][1].split()
        at = rng.randint(0, 2)
        docs.append(f"{text(rng, 5)} -- {', '.join(words[at : at + 10 + k % 3]).upper()}! {text(rng, 4)}")
    docs += ["NAÏVE über thing X1", "naÏve", "a unique one", "", " \n", "word " * 5000, items[3][1] + " " + items[3][1]]
    return docs, items


def test_report_equals_brute_force(spark, make):
    docs, items = corpus()
    frame = make([*enumerate(docs), (None, docs[26]), (7, docs[26]), (99, None)], items=F.lit(1), spans=F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    for blocks in ({}, {"block_bytes": 150, "shard_bytes": 100}):
        got = S.match_report(frame, bench, **blocks).collect()
        assert len(got) == len(docs) + 3
        for r in got:
            body = docs[r.doc_id] if r.doc_id is not None and r.doc_id not in (7, 99) else None
            if r.doc_id in (7, None):
                body = docs[26] if r.doc_id is None or r.n_words == len(docs[26].split()) - 1 else docs[7]
            if r.doc_id == 7:
                continue
            want = S.plain_report(body, items)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want, r


def test_longest_match_and_its_places(spark, make):
    item = " ".join(f"w{k}" for k in range(30))
    doc = "aa bb " + " ".join(f"w{k}" for k in range(5, 20)) + " cc"
    bench = spark.createDataFrame([("7", item)], "item_id string, text string")
    r = S.match_report(make([(1, doc)]), bench).first()
    assert (r.longest_match, r.longest_item, r.longest_item_word, r.longest_doc_word) == (15, "7", 5, 2)
    assert r.spans == [[2, 17]]


def test_decontaminate_keeps_clean_rows_and_columns(spark, make):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id string, text string")
    frame = make([*enumerate(docs), (5, None)], extra=F.lit("x"))
    kept = S.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    want = sum(not S.plain_report(d, items)[4] for d in docs) + 1
    assert kept.count() == want
    empty = bench.limit(0)
    assert S.decontaminate(frame, empty).count() == len(docs) + 1
    assert S.match_report(frame.limit(0), bench).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_sorts_suffixes(values):
    array = np.array(values, dtype=np.int64)
    order = S.suffix_array(array, len(values)).tolist()
    assert order == sorted(range(len(values)), key=lambda i: values[i:])


def test_word_hashes_hold_a_piece_at_a_time(monkeypatch):
    words = [b"w%d" % (k % 977) for k in range(200_000)]
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    starts, ends = S.word_spans(data, np.array([0, len(data)]))
    monkeypatch.setattr(S, "POWERS", S.Powers())
    tracemalloc.start()
    got = S.word_hashes(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and len(S.POWERS.up) <= S.PIECE_BYTES + 1
    mask = (1 << 64) - 1
    for k in [0, 1, 976, 977, len(words) // 2, len(words) - 1]:
        value = sum((b + 1) * pow(S.Powers.BASE, p, 1 << 64) for p, b in enumerate(words[k])) & mask
        assert got[k] == value ^ (value >> 29)
    assert len(np.unique(got)) == 977
    monkeypatch.setattr(S, "PIECE_BYTES", 2)  # every word is longer
    assert (S.word_hashes(data[:50], starts[:10], ends[:10]) == got[:10]).all()
