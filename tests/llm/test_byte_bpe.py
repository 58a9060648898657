import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from paneltide.llm import byte_bpe as B
from paneltide.llm import catalog, lengths

TEXTS = [
    "Hello world, it's the naïve über-thing! 12345",
    "",
    None,
    "  spaces \n\n and\ttabs   ",
    "日本語 😀 emoji\u0000\u00a0\u2003x",
    "<|endoftext|> is text",
    "word " * 30000,
    "a" * 3000,
    "Hello world, it's the naïve über-thing! 12345",
]


@pytest.fixture(scope="module")
def vocabulary():
    return catalog.vocabulary()


def digest(ids):
    return hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_equals_the_library_and_comes_back(make, vocabulary):
    encoding = vocabulary.encoding()
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = B.round_trip(make([*rows, (0, TEXTS[0]), (None, TEXTS[3])]), vocabulary).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = TEXTS[3 if r.doc_id is None else r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        want = (len(ids), digest(ids), hashlib.sha256(text.encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_small_blocks_clashing_columns_and_no_rows(make, vocabulary):
    encoding = vocabulary.encoding()
    frame = make(list(enumerate(TEXTS)), ids=F.lit("clash"), _key=F.lit(1), word=F.lit("w"))
    out = B.encode(frame, vocabulary, block_bytes=40, settle=True)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "_key", "word", "ids"}
    for r in out.collect():
        ids = encoding.encode_ordinary(TEXTS[r.doc_id] or "")
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
    assert B.round_trip(make([]), vocabulary).count() == 0


def test_token_table_has_every_rank(spark, vocabulary):
    table = vocabulary.table(spark)
    assert table.count() == table.select("id").distinct().count() == len(vocabulary.ranks)


def test_length_table_answers_every_limit(spark, make, vocabulary):
    encoding = vocabulary.encoding()
    sizes = sorted(len(encoding.encode_ordinary(t or "")) for t in TEXTS)
    counted = lengths.with_lengths(make(list(enumerate(TEXTS)), length=F.lit(3)), vocabulary)
    assert sorted(r.n_tokens for r in counted.select("n_tokens").collect()) == sizes
    table = lengths.length_table(lengths.histogram(counted)).cache()
    rows = {r.length: r for r in table.collect()}
    assert set(rows) == set(sizes)
    for limit, r in rows.items():
        cut = sum(min(n, limit) for n in sizes)
        assert (r.n_docs, r.docs_upto) == (sizes.count(limit), sum(n <= limit for n in sizes))
        assert (r.tokens_upto, r.docs_over) == (sum(n for n in sizes if n <= limit), sum(n > limit for n in sizes))
        assert (r.tokens_truncated, r.tokens_lost) == (cut, sum(sizes) - cut)
    for limit in (0, 1, 7, 10_000, 10**6):
        assert lengths.truncated_total(table, limit) == sum(min(n, limit) for n in sizes)
    found = lengths.quantiles(table, [0.25, 0.5, 1.0])
    for share, value in found.items():
        assert sum(n <= value for n in sizes) >= share * len(sizes) > sum(n < value for n in sizes) - 1e-9
    assert lengths.length_table(lengths.histogram(counted.limit(0))).count() == 0
