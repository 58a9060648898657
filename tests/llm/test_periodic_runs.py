import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.llm import catalog
from paneltide.llm import periodic_runs as P


def plain_runs(words):
    """Every period compared with every place; the first period of a stretch is its smallest."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_rest(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def text(rng):
    words, letters = [], rng.choice([1, 2, 3, 5, 50, 1000])
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.6:
            q = rng.choice([1, 2, 3, 5, 7, 8, 11, 12, 13, 23, 24, 25, 31, 47, 48, 60, 95, 96, 130])
            root = [rng.randrange(letters) for _ in range(q)]
            if q > 3 and rng.random() < 0.3:  # a root that is nearly periodic itself
                root = (root[: max(1, q // rng.randint(2, 9))] * 20)[:q]
            words += (root * 9)[: rng.randint(q, 6 * q)]
        else:
            words += [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        if words and rng.random() < 0.2:
            words[rng.randrange(len(words))] = rng.randrange(letters)
    return words


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [text(rng) for _ in range(rng.randint(1, 6))]
        assert P.find_runs([np.array(t, dtype=np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def test_hashes_that_collide_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = [text(rng) for _ in range(20)]
    monkeypatch.setattr(P, "_mix", lambda x: x % np.uint64(7))
    assert P.find_runs([np.array(t, dtype=np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def test_rows_and_odd_tables(make):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in text(rng))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \n\t"), (None, "a " * 30), (43, "é b " * 40), (43, "é b " * 40)]
    rows.append((50, "x y z " * 40_000))
    clash = make(rows, runs=F.lit("own"), _words_of=F.lit("own"), _key_of=F.lit("own"), collapsed=F.lit("own"))
    got = P.with_runs(clash)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_words_of", "_key_of", "runs", "collapsed"]
    for r in got.collect():
        words = (r.text or "").encode().split()
        assert r._words_of == r._key_of == "own"
        if r.doc_id == 50:
            assert [tuple(x) for x in r.runs] == [(0, 120_000, 3)] and r.collapsed == "x y z"
            continue
        runs = plain_runs(words)
        assert [tuple(x) for x in r.runs] == runs
        assert r.collapsed.encode() == b" ".join(plain_rest(words, runs))
    assert P.with_runs(make([])).count() == 0


def test_query_on_all_rows_by_brute_force(spark):
    docs = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in catalog.op11_periodic_runs(spark, docs).collect()}
    rows = spark.read.parquet(f"{docs}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        words = catalog.planted_period(row.doc_id, (row.text or "").encode().split())
        if len(words) > 2500:
            continue  # its SQL covers the long ones
        runs, r = plain_runs(words), got[row.doc_id]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2]) and r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(plain_rest(words, runs))).hexdigest()
