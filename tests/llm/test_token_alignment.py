import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paneltide.llm import catalog
from paneltide.llm import token_alignment as A

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def plain(texts):
    """By the libraries' own encoders: every pair of tokens compared by its byte range."""
    first = Tokenizer.from_file(JSON)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    decode = byte_of()
    rows, count = [], Counter()
    for text in texts:
        row = (0, 0, 0, [], "")
        if text:
            ids = first.encode(" " + text, add_special_tokens=False).ids
            a = [(i, bytes(decode[c] for c in first.id_to_token(i))) for i in ids]
            b = []
            for i in second.encode(text):
                piece = second.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == b" " + text.encode():
                spans = []
                for side in (a, b):
                    at, own = 0, []
                    for i, x in side:
                        own.append((i, at, at + len(x)))
                        at += len(x)
                    spans.append(own)
                links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
                cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
                parts, low = [], 0
                for high in cuts:
                    parts.append("|".join(",".join(str(i) for i, s, e in own if low <= s and e <= high) for own in spans))
                    low = high
                row = (len(a), len(b), len(cuts), links, ";".join(parts))
                count.update(links)
        rows.append(row)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [
        (a, b, g, len(links), text, sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links))
        for a, b, g, links, text in rows
    ]


def corpus(seed=3):
    rng = random.Random(seed)
    pieces = ["the ", "ing", " über", "日本語", "\n\n", "  ", "▁", "🙂", "<|endoftext|>", "<s>", "don't", "12345", "\t", "\u0000", "naïve ", "é", " "]
    texts = ["".join(rng.choice(pieces[:6] + pieces[7:] if rng.random() < 0.9 else pieces) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [*texts, None, "", " ", "▁", "plain words", "plain words", "a" * 300]


def tokenizers():
    return A.RankedBytes(JSON, public_tokenizers.PATTERN), A.Pieces(MODEL)


def test_equals_every_pair_compared(make, monkeypatch):
    monkeypatch.setattr(A, "STRETCH", 16)
    texts = corpus()
    frame = make(list(enumerate(texts)), n_a=F.lit("own"), doc=F.lit("own"), block=F.lit("own"), pairs=F.lit("own"))
    both = tokenizers()
    got = {r.doc_id: r for r in A.align(frame, *both).collect()}
    groups = {r.doc_id: r.groups for r in A.with_groups(frame, *both).collect()}
    wanted = plain(texts)
    assert any(w[0] == 0 for w, t in zip(wanted, texts) if t) and len(got) == len(texts)
    for i, want in enumerate(wanted):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, groups[i], r.n_best, r.count_sum) == want, texts[i]
        assert r.groups_sha256 == (hashlib.sha256(want[4].encode()).hexdigest() if want[0] else "")
        assert r.doc == r.block == r.pairs == "own"


def test_counts_do_not_depend_on_blocks_and_null_ids_stay(make, monkeypatch):
    texts = [t for t in corpus(4)]
    frame = make([(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)]).repartition(5)
    whole = sorted((r.n_links, r.n_best, r.count_sum) for r in A.align(frame, *tokenizers()).collect())
    assert whole == sorted((w[3], w[5], w[6]) for w in plain(texts))
    counts = A.link_counts(frame, *tokenizers())
    assert counts.agg(F.sum("count")).first()[0] == sum(w[3] for w in plain(texts))
    assert A.align(make([]), *tokenizers()).count() == 0 and A.with_groups(make([]), *tokenizers()).count() == 0
    nothing = A.align(make([(1, None), (2, "")]), *tokenizers()).collect()
    assert [(r.n_a, r.n_best, r.groups_sha256) for r in nothing] == [(0, 0, "")] * 2


def test_query_on_all_rows_by_brute_force(spark):
    docs = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in catalog.op12_token_alignment(spark, docs).collect()}
    rows = spark.read.parquet(f"{docs}/documents.parquet").collect()
    first, second = tokenizers()
    aligner = A._Aligner(first, second)
    hf = Tokenizer.from_file(JSON)
    hf.encode_special_tokens = True
    count, own = Counter(), {}
    for row in rows:
        if row.text and got[row.doc_id].n_a:
            a, b = hf.encode(" " + row.text, add_special_tokens=False).ids, aligner.encode[1]([row.text])[0]
            assert (got[row.doc_id].n_a, got[row.doc_id].n_b) == (len(a), len(b))
            i = j = at_a = at_b = 0  # two pointers over both sides
            links = []
            while i < len(a):
                links.append((a[i], b[j]))
                end_a, end_b = at_a + aligner.sizes[0][a[i]], at_b + aligner.sizes[1][b[j]]
                if end_a <= end_b:
                    i, at_a = i + 1, end_a
                if end_b <= end_a:
                    j, at_b = j + 1, end_b
            own[row.doc_id] = links
            count.update(links)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    for row in rows:
        r, links = got[row.doc_id], own.get(row.doc_id, [])
        assert r.n_links == len(links)
        assert (r.n_best, r.count_sum) == (sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links))
