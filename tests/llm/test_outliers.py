import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from paneltide.llm import outliers as O


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    counts = collections.Counter(windows)
    hit = {k for i, w in enumerate(windows) if counts[w] > 1 for k in (i, i + 1, i + 2)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def texts(seed=1, n=260):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(1, 9))) for _ in range(900)]

    def body(size):
        words = [rng.choice(vocabulary) for _ in range(size)]
        return "\n".join(" ".join(words[i : i + 17]) for i in range(0, size, 17))

    good = [body(int(rng.lognormvariate(5.3, 0.5)) + 50) for _ in range(n)]
    bad = [" ".join(w + "***" for w in body(200).split()) for _ in range(6)]
    return good, bad


ODD = [None, "", " \n\t", "one", "a b c a b c", "x\ny\nx\nx", "a a a a", "😀 é\u00a0z\u2003 |", "q " * 20000, "\x0b\x0c p"]


def test_statistics_equal_their_definition(make):
    good, bad = texts(n=30)
    rows = list(enumerate(ODD + good + bad))
    frame = O.with_statistics(make(rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in frame.collect():
        want = plain(rows[r.doc_id][1])
        assert tuple(r[n] for n in names) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_outliers_go_and_clean_documents_stay(make):
    good, bad = texts()
    rows = list(enumerate(good + bad + ODD))
    frame = make(rows, kept=F.lit("clash"), n_words=F.lit(0), scale=F.lit(1))
    out = {r.doc_id: r for r in O.judged(frame, ("doc_id", "kept")).collect()}
    assert len(out) == len(rows)
    assert all(out[i].kept for i in range(len(good)))
    assert not any(out[i].kept for i in range(len(good), len(good) + len(bad)))
    assert all(not r.kept for r in out.values() if r.base_failed)
    left = O.passing(frame)
    assert left.columns == frame.columns
    assert left.count() == len(good)


def test_small_groups_borrow_and_null_groups_count(spark, make):
    good, bad = texts()
    frame = make(list(enumerate(good + bad[:1])))
    frame = frame.withColumn("source", F.when(F.col("doc_id") < 250, "big").when(F.col("doc_id") < 255, "small"))
    out = {r.doc_id: r.kept for r in O.judged(frame, ("doc_id",)).collect()}
    assert all(out[i] for i in range(len(good))) and not out[len(good)]
    few = O.judged(frame.where("doc_id < 20 or doc_id = 260"), ("doc_id",)).collect()
    assert all(r.kept for r in few)  # too few rows for an estimate
    assert O.judged(frame.limit(0), ("doc_id",)).count() == 0


def test_estimates_follow_the_concentration_steps(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(600, 5)) * [1, 0.5, 0.3, 0.4, 0.6] + [5, 3, 0, 1, 0]
    data[:60] += 8
    rows = spark.createDataFrame([("g", *map(float, x)) for x in data], ["k", *O.VECTOR])
    got = O.covariance_estimates(rows, ["k"]).first()
    floors = np.diag(np.square(O.FLOOR))

    def bin_edge(values, share, step):
        bins = np.floor(values / step)
        return (np.sort(bins)[int(np.ceil(share * len(bins))) - 1] + 1) * step

    middle = np.array([bin_edge(data[:, i], 0.5, 1 / 64) for i in range(5)])
    spread = np.array([bin_edge(np.abs(data[:, i] - middle[i]), 0.5, 1 / 64) for i in range(5)])
    mean, factor = middle, np.diag(spread * 1.4826 + O.FLOOR)
    determinants = []
    for _ in range(O.STEPS):
        far = np.log2(np.maximum((np.linalg.solve(factor, (data - mean).T) ** 2).sum(0), 1e-9))
        inner = data[far < bin_edge(far, O.CORE, 1 / O.FINE)]
        mean = inner.mean(0)
        cov = np.cov(inner.T, bias=True)
        determinants.append(np.linalg.det(cov))
        factor = np.linalg.cholesky(cov + floors)
    assert np.allclose([got[f"m{i}"] for i in range(5)], mean)
    assert np.allclose([got[f"l{i}{j}"] for i in range(5) for j in range(i + 1)], [factor[i, j] for i in range(5) for j in range(i + 1)])
    assert determinants[-1] <= determinants[0]


def test_each_statistic_can_reject_alone(make):
    good, _ = texts()
    rng = random.Random(5)
    words = good[0].split()
    while len(words) < 700:
        words += ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(1, 9)))]
    fresh = [" ".join(words[i : i + 2]) for i in range(0, 120, 2)]
    lines = fresh[:20] + [w for w in words[200:210] for _ in range(5)] + fresh[20:30]  # half of the lines, few of the words
    phrase = " ".join(words[300:340])
    odd = {
        "duplicate lines": "\n".join(lines),
        "repeated words": "\n".join([" ".join(words[i : i + 17]) for i in range(0, 102, 17)] + [phrase, "x " + phrase]),
        "long words": "\n".join(" ".join(w + w[:5] for w in words[i : i + 17]) for i in range(0, 204, 17)),
    }
    out = {r.doc_id: r for r in O.judged(make(list(enumerate([*good, *odd.values()]))), ("doc_id",)).collect()}
    assert all(out[i].kept for i in range(len(good)))
    for k, name in enumerate(odd):
        r = out[len(good) + k]
        assert not r.base_failed and not r.kept, (name, r)
        assert r.distance < 80


def test_windows_whose_hashes_agree_are_told_apart(make, monkeypatch):
    good, _ = texts(n=6)
    rows = list(enumerate([*good, "a b c x a b c y d e f", "a a a a b", *ODD[:8]]))
    true_hash = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.shiftleft(F.pmod(true_hash(*c), F.lit(4)), 60))
    got = {r.doc_id: r.n_repeat_words for r in O.with_statistics(make(rows)).collect()}
    assert got == {i: plain(t)[4] for i, t in rows}


def test_estimates_are_joined_by_one_long(make, monkeypatch):
    seen = []
    plain = O._small
    monkeypatch.setattr(O, "_small", lambda table: seen.append(dict(table.dtypes)) or plain(table))
    lang = F.when(F.col("doc_id") % 3 == 0, "fr").when(F.col("doc_id") % 3 == 1, "en")
    docs = make([(i, " ".join(f"w{i * j % 97}" for j in range(60 + i))) for i in range(60)], lang=lang)
    assert O.judged(docs, ("doc_id",), least=10).where("distance is null").count() == 0
    # a join by texts takes a page of memory in each executor: only the lists of groups and the last one may
    by_text = [t for t in seen if "string" in t.values()]
    assert len(by_text) <= 3 and len(seen) - len(by_text) >= 2 * O.STEPS
    assert all(t["_k"] == "bigint" for t in seen if t not in by_text)
