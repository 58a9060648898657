import hashlib
import random

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from paneltide.llm import catalog
from paneltide.llm import substring_repeats as S


def plain(rows):
    """Every window of every text in order of (id, start)."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if seen.setdefault(window, (i, k)) != (i, k):
                gone.update(range(k, k + 20))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), b" ".join(kept).decode(), sorted(gone))
    return out


def spans(places):
    out = []
    for p in places:
        if out and sum(out[-1]) == p:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((p, 1))
    return out


def corpus(seed, letters):
    rng = random.Random(seed)

    def some(n):
        return [f"w{rng.randrange(letters)}" for _ in range(n)]

    passages = [some(rng.choice([19, 20, 21, 25, 40, 90])) for _ in range(8)]
    rows = []
    for i in range(70):
        words = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(passages))
            low = rng.randint(0, 12) if rng.random() < 0.5 else 0
            part = part[low:]
            if part and rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edit"
            words += part + some(rng.choice([0, 0, 1, 30]))
        rows.append((i, " ".join(words)))
    base = some(120)
    for i in range(70, 110):  # near copies of one text, each edited elsewhere
        words = list(base)
        words[rng.randrange(120)] = f"e{rng.randrange(3)}"
        rows.append((i, "\n".join(words)))
    rows += [(200, rows[3][1]), (201, "a " * 70), (202, None), (203, ""), (204, "a " * 19), (205, " ".join(base * 3)), (206, "é ü " * 25)]
    rng.shuffle(rows)
    return rows


def check(got, rows):
    wanted = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        n, m, kept, places = wanted[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, m), r.doc_id
        assert r.text == (None if dict(rows)[r.doc_id] is None else kept)
        assert [tuple(x) for x in r.repeats] == spans(places)


def test_equals_brute_force(make):
    for seed, letters in ((1, 10**6), (2, 40), (3, 3)):
        rows = corpus(seed, letters)
        frame = make(rows, id=F.lit("own"), row=F.lit("own"), whole=F.lit("own"), single=F.lit("own"), n_words=F.lit("own"))
        got = S.remove_repeats(frame.repartition(5))
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "row", "whole", "single", "n_words", "n_removed", "repeats"]
        got = got.collect()
        check(got, rows)
        assert all(r.id == r.row == r.whole == r.single == "own" for r in got)


def test_seed_hashes_that_collide_lose_nothing(make, monkeypatch):
    rows = corpus(4, 60)
    plain_hashes = S._Slice.hashes

    def coarse(self, start, end, k):
        value = plain_hashes(self, start, end, k)
        return value % np.uint64(5) if len(start) and end[0] - start[0] == S.SEED else value

    monkeypatch.setattr(S._Slice, "hashes", coarse)
    cloudpickle.register_pickle_by_value(S)
    try:
        check(S.remove_repeats(make(rows)).collect(), rows)
    finally:
        cloudpickle.unregister_pickle_by_value(S)


def test_null_and_repeated_ids_and_no_rows(make):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(None, "x " + passage), (None, "x " + passage), (None, passage), (7, passage), (7, passage), (None, None)]
    got = S.remove_repeats(make(rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [
        ("7", passage), ("7", passage), ("None", ""), ("None", "None"), ("None", "x"), ("None", "x")
    ]
    assert S.remove_repeats(make([])).count() == 0
    long = " ".join(f"l{k}" for k in range(60_000))
    got = {r.doc_id: r for r in S.remove_repeats(make([(1, long), (2, "start " + long + " end")])).collect()}
    assert got[1].n_removed == 0 and got[2].text == "start end" and [tuple(x) for x in got[2].repeats] == [(1, 60_000)]


def test_query_on_all_rows_by_brute_force(spark):
    docs = "/root/testdata/sf0.001"
    wanted = plain([(r.doc_id, r.text) for r in spark.read.parquet(f"{docs}/documents.parquet").collect()])
    got = catalog.op13_seed_extend_dedup(spark, docs).collect()
    assert len(got) == len(wanted)
    for r in got:
        n, m, kept, _ = wanted[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, m, hashlib.sha256(kept.encode()).hexdigest())
