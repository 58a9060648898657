"""Every operator and stage on empty tables, nulls everywhere, long and repeated texts and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from paneltide.llm import byte_bpe, catalog, chat, lengths, line_chunks, outliers, page_text, pseudonyms, simhash, suffix_array, warc

corpus_pipeline = pytest.importorskip("corpus_pipeline")

EMPTY = hashlib.sha256(b"").hexdigest()
LONG = "Long line of seven plain words here\n" * 20_000
ROWS = [
    (None, None),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t\n"),
    (4, LONG),
    (5, "one two"),
    (5, "one two"),
    (None, "one two"),
    (6, "\u0000 \u00e9\U0001f600 " * 30),
    (7, " ".join(f"word{k}" for k in range(80))),
]
CLASHES = (
    "_row", "_text", "_id", "_fp", "_root", "_low", "_n", "_whole", "_hash", "_marks", "_kept", "_doc", "_key", "_block", "_lang",
    "_test_matches", "fp", "low", "ids", "decoded", "kept", "n_words", "n_tokens", "fingerprint", "component_id", "spans",
    "n_replaced", "n_lines_removed", "distance", "record", "fields", "block", "warc_type", "window", "place", "tokens",
)


@pytest.fixture(scope="module")
def docs(make):
    """Null languages and sources too, and columns that have the names operators work with."""
    frame = make(ROWS)
    for name in ("lang", "source", "n_chars"):
        frame = frame.withColumn(name, F.when(F.col("doc_id") != 2, F.col(name)))
    return frame.select("*", *[F.lit("own").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def tests(spark):
    rows = [(None, None), (None, ""), (1, "..."), (1, "never seen"), (2, "word1 word2 word3"), (2, "word1 word2 word3")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("spans", F.lit(0))


def operators(tests):
    vocabulary = catalog.vocabulary()
    return {
        "pseudonyms": lambda d: pseudonyms.pseudonymize(d, b"k"),
        "pseudonym report": lambda d: pseudonyms.report(d, b"k"),
        "matches": lambda d: suffix_array.match_report(d, tests),
        "chunks": line_chunks.dedup_chunks,
        "classes": simhash.near_duplicate_classes,
        "page text": lambda d: page_text.with_main_text(d, source="text", name="main"),
        "encoding": lambda d: byte_bpe.encode(d, vocabulary),
        "round trip": lambda d: byte_bpe.round_trip(d, vocabulary),
        "quality": lambda d: outliers.judged(d, tuple(d.columns)),
        "lengths": lambda d: lengths.with_lengths(d, vocabulary),
    }


def test_rows_stay_whole_and_tables_may_be_empty(docs, tests):
    for name, apply in operators(tests).items():
        assert apply(docs).count() == len(ROWS), name
        assert apply(docs.limit(0)).count() == 0, name


def test_defined_results(docs, tests):
    matches = suffix_array.match_report(docs, tests).collect()
    assert {r.doc_id for r in matches if r.contaminated} == {7}
    assert all((r.n_words, r.n_hit, r.items_sha256) == (0, 0, EMPTY) for r in matches if r.doc_id in (1, 2, 3))
    prints = {r.doc_id: r for r in simhash.near_duplicate_classes(docs).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint == prints[3].fingerprint == "0" * 16
    assert prints[1].component_id == prints[3].component_id == 1
    encoded = [r for r in byte_bpe.round_trip(docs, catalog.vocabulary()).collect()]
    wanted = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS)
    assert sorted(r.decoded_sha256 for r in encoded) == wanted
    judged = {r.doc_id: r for r in outliers.judged(docs, ("doc_id",)).collect()}
    assert judged[1].n_words == 0 and judged[1].base_failed and not judged[1].kept
    assert judged[4].n_dup_lines == 19_999 and judged[4].n_repeat_words == 140_000 and judged[4].base_failed
    assert judged[7].kept and not judged[7].base_failed
    table = lengths.length_table(lengths.histogram(lengths.with_lengths(docs, catalog.vocabulary()))).collect()
    assert sum(r.n_docs for r in table) == len(ROWS) and min(r.length for r in table) == 0
    assert next(r.n_docs for r in table if r.length == 0) == 4
    assert lengths.length_table(lengths.histogram(lengths.with_lengths(docs.limit(0), catalog.vocabulary()))).count() == 0


def test_stages_keep_foreign_columns_as_they_are(spark, docs, tests, tmp_path):
    tests.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {"quality_rules": 1, "line_dedup": len(ROWS), "near_dedup": None, "decontamination": len(ROWS) - 1}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert left[name] in (None, len(rows)), name
        foreign = [c for c in CLASHES if name != "line_dedup" or c not in ("n_lines_removed",)]
        assert all(r[c] == "own" for r in rows for c in foreign), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert dict(corpus_pipeline.STAGES)["encoding"](spark, docs, str(tmp_path)).count() == len(ROWS)
    without = suffix_array.decontaminate(docs, tests.limit(0))
    assert without.count() == len(ROWS) and without.columns == docs.columns


def test_pages_and_turns(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<p>a" + "<div>b, c" * 5000)], "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit("own").alias(c) for c in CLASHES])
    assert page_text.extract(pages).count() == 4 and page_text.extract(pages.limit(0)).count() == 0
    for rows, n in ((pages, 8), (pages.limit(0), 0)):
        assert warc.derive(warc.responses(rows, catalog.CAPTURED), ("page_id",)).count() == n
    turns = [(None, None, None, None), (1, 0, None, None), (1, 0, None, None), (1, 1, "assistant", "x\\<|<\\|" * 3000), (1, None, "system", "")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").select(
        "*", *[F.lit("own").alias(c) for c in CLASHES]
    )
    got = {r.conv_id: r for r in chat.conversation_report(frame).collect()}
    assert got[1].n_turns == 4 and got[None].n_turns == 1
    assert got[1].loss_sha256 == hashlib.sha256(turns[3][3].encode()).hexdigest() and got[None].loss_chars == 0
    assert chat.conversation_report(frame.limit(0)).count() == 0
