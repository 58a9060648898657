"""The pipeline against a brute-force run over the same documents."""

import hashlib
import random
import struct

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from paneltide.llm import catalog, line_chunks, simhash, suffix_array  # noqa: E402


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(1, 9))) for _ in range(900)]

    def body(n):
        words = [rng.choice(vocabulary) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + 17]) for i in range(0, n, 17))

    docs = [body(int(rng.lognormvariate(5.3, 0.4)) + 60) for _ in range(240)]
    items = [(k, body(24).replace("\n", " ")) for k in range(5)]
    passage = body(70).replace("\n", " ")
    for k in range(3):
        docs[k] += "\n" + items[k][1]
    for k in range(10, 16):
        docs[k] += "\n" + passage
    docs += [docs[20], docs[21].replace(docs[21].split()[0], "changed", 1), "short text", "*** " * 300, " ".join(f"w{k}###" for k in range(200))]
    return docs, items


def test_run_equals_brute_force(spark, make, tmp_path):
    docs, items = corpus()
    make([*enumerate(docs), (900, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = dict(enumerate(docs[:-3]))  # the short one, the repeats and the symbols go
    seen = set()
    for i, text in sorted(kept.items()):
        gone = set()
        for k, chunk in line_chunks.candidates(text):
            if chunk in seen:
                gone.add(k)
            seen.add(chunk)
        kept[i] = line_chunks.without(text, gone)[0]
    prints = {i: simhash.fingerprint(t) for i, t in kept.items()}
    parent = {i: i for i in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in kept:
        for j in kept:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    kept = {i: t for i, t in kept.items() if find(i) == i}
    pairs = [(str(k), t) for k, t in items]
    kept = {i: t for i, t in kept.items() if not suffix_array.plain_report(t, pairs)[4]}
    assert set(got) == set(kept)
    encoding = catalog.vocabulary().encoding()
    for i, text in kept.items():
        ids = encoding.encode_ordinary(text)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, make, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = make([*enumerate(docs[:20]), (None, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (frame, frame.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == frame.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in frame.schema], name
            out.count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
