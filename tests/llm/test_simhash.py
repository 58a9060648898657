import random

import xxhash
from pyspark.sql import functions as F

from paneltide.llm import simhash as M
from paneltide.llm.components import components


def plain_fingerprint(text, size=4):
    import re

    low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(numbers, radius):
    parent = list(range(len(numbers)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(numbers)):
        for j in range(i):
            if (numbers[i] ^ numbers[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(numbers))]


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(5)
    masks = M.masks()
    assert len(masks) == 31
    for _ in range(5000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not flip & m for m in masks)


def test_fingerprint_equals_its_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 50):
        text = " \t".join(rng.choice(["Ab", "ÄÖ", "c\u00a0d", "x", "\u2003"]) for _ in range(n))
        assert M.fingerprint(text) == plain_fingerprint(text)
    assert M.fingerprint(None) == 0


def near(rng, base, k):
    return base ^ sum(1 << b for b in rng.sample(range(64), k))


def test_links_give_the_components_of_all_pairs(spark):
    rng = random.Random(2)
    numbers = [rng.getrandbits(64) for _ in range(40)]
    for base in numbers[:6]:
        numbers += [near(rng, base, rng.randint(1, 6)) for _ in range(12)]
    numbers += [near(rng, numbers[0], 2) for _ in range(150)]  # one large group
    numbers = sorted(set(numbers))
    frame = spark.createDataFrame([(M.signed(n),) for n in numbers], "fp long")
    want = groups(numbers, 4)
    for bucket in (512, 20):  # the second sends groups through midpoints
        root = {r.node: r.root for r in components(M.links(frame, bucket=bucket)).collect()}
        got = [root.get(M.signed(n), M.signed(n)) for n in numbers]
        pairs = set(zip(want, got))
        assert len(pairs) == len(set(want)) == len(set(got))


def test_buckets_are_not_broadcast_however_small_they_seem(spark, monkeypatch):
    plans, write = [], M.materialized

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(M, "materialized", noted)
    M.links(spark.range(3000).select(F.xxhash64("id").alias("fp")))
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_classes_and_the_one_that_stays(spark, make):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(400)]
    other = [rng.choice(words) for _ in range(60)]
    changed = [*base[:399], "new"]
    texts = [(5, " ".join(base)), (3, " ".join(base).upper()), (9, " ".join(changed)), (1, " ".join(other)), (8, None), (4, " \n"), (None, "")]
    frame = make([*texts, (1, " ".join(other))], fp=F.lit("clash"), root=F.lit(0), _n=F.lit(1))
    rows = M.near_duplicate_classes(frame).collect()
    assert len(rows) == 8
    numbers = [plain_fingerprint(t) for _, t in texts]
    want = groups(numbers, 4)
    low = {}
    for (i, _), g in zip(texts, want):
        if i is not None:
            low[g] = min(i, low.get(g, i))
    expected = sorted((str(i), f"{n:016x}", low[g]) for (i, _), n, g in zip(texts, numbers, want))
    expected = sorted([*expected, ("1", f"{numbers[3]:016x}", 1)])
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == expected
    kept = M.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(low.values())
    assert M.near_duplicate_classes(frame.limit(0)).count() == 0


def test_ids_that_are_all_null_keep_one_row(make):
    assert M.keep_one(make([(None, "a b c"), (None, "a b c"), (None, "q r s t u v")])).count() == 2


def test_an_id_in_two_classes_keeps_only_its_own(make):
    one, two = "a b c d e f g", "q r s t u v w x"
    kept = M.keep_one(make([(3, one), (5, one), (5, two), (5, two), (8, two), (9, "k l m n o")])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, one), (5, two), (9, "k l m n o")]


def test_texts_are_not_shuffled_to_leave_out_a_few(spark, make):
    rng = random.Random(6)
    rows = [(k, " ".join(str(rng.random()) for _ in range(8))) for k in range(6000)]
    rows.append((6000, rows[0][1]))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 15))  # the ids that stay take more
    try:
        kept = M.keep_one(make(rows))
        assert kept.count() == 6000
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_components_of_a_long_path(spark):
    edges = spark.range(0, 60).selectExpr("id as a", "id + 1 as b")
    got = components(edges.union(spark.createDataFrame([(200, 100), (100, 150), (7, 7)], "a long, b long"))).collect()
    assert {r.node: r.root for r in got} == {**{k: 0 for k in range(1, 61)}, 150: 100, 200: 100}
