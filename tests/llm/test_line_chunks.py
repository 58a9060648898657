import random

from pyspark import cloudpickle
from pyspark.sql import functions as F

from paneltide.llm import line_chunks as L


def plain(rows):
    """Later occurrences of equal candidate chunks removed, by a walk in order of ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        gone = set()
        for k, chunk in L.candidates(text):
            if chunk in seen:
                gone.add(k)
            seen.add(chunk)
        out[i] = (L.without(text, gone)[0], len(gone))
    return out


def corpus(seed=8):
    rng = random.Random(seed)

    def line(n):
        return " ".join(rng.choice("alpha beta gamma delta über".split()) + str(rng.randint(0, 99)) for _ in range(n))

    passage = [line(12) for _ in range(14)]
    rows = []
    for i in range(30):
        lines = [line(rng.randint(0, 20)) for _ in range(rng.randint(1, 25))]
        if i % 3 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), passage[0] + " " + " ".join(passage[1:6]))
        rows.append((i, "\n".join(lines)))
    return [*rows, (40, rows[2][1]), (41, ""), (42, None), (43, "\n\n"), (44, "short\nlines"), (45, "short\nlines")], passage


def test_equals_a_walk_over_the_corpus(make):
    rows, _ = corpus()
    frame = make(rows, n=F.lit(1), chunk=F.lit("clash"), _no=F.lit(2))
    got = {r.doc_id: (r.text, r.n_chunks_removed) for r in L.dedup_chunks(frame).collect()}
    assert got == plain(rows)
    assert got[40][0] == "" or got[40][1] > 0
    assert got[45][0] == "short\nlines"


def walked(rows):
    """Lines in a run of more than 50 words that also begins at an earlier place removed; shares no code with the library."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split(" ")) if x else 0 for x in lines[a:b]) > 50:
                    if "\n".join(lines[a:b]) in seen:
                        gone.update(range(a, b))
                    seen.add("\n".join(lines[a:b]))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_equals_all_runs_tried(make):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("ab") * rng.randint(1, 3) for _ in range(n)) for n in (0, 1, 1, 2, 5, 8, 13, 20, 30, 51, 70)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        if i % 5 == 0:  # many one-word lines, and a text that repeats itself
            lines = [rng.choice("xyz") for _ in range(rng.randint(40, 80))] + ["end " * 9 + "end"]
            lines += lines[: rng.randint(0, len(lines))]
        if i % 4 == 1:
            lines[1:1] = rows[-1][1].split("\n")
        rows.append((i, "\n".join(lines)))
    assert {r.doc_id: r.text for r in L.dedup_chunks(make(rows)).collect()} == walked(rows)


def hashed(lines):
    return [L.line_hash(x.encode()) for x in lines], [len(x.split()) for x in lines]


def test_anchors_move_only_near_an_inserted_line():
    _, passage = corpus()
    whole = {a for _, a in L.anchors(*hashed(passage)).values()}
    moved = {a for _, a in L.anchors(*hashed([*passage[:7], "some other line", *passage[7:]])).values()}
    assert whole <= {a for _, a in L.anchors(*hashed(["x", *passage, "y"])).values()}
    assert len(whole) > 1 and len(whole - moved) <= 2


def test_anchor_is_the_least_inside_its_stretch():
    rng = random.Random(4)
    lines = [" ".join("w" * rng.randint(1, 9) for _ in range(rng.choice((0, 1, 9, 30, 60)))) for _ in range(300)]
    values, sizes = hashed(lines)
    for (a, b), (at, anchor) in L.anchors(values, sizes).items():
        assert a <= at < b
        assert anchor == (values[a] if b == a + 1 else min((values[k] * L.BASES[0] + values[k + 1]) % L.WIDE for k in range(a, b - 1)))


def test_chunk_boundaries_move_only_near_an_inserted_line():
    rng = random.Random(6)
    lines = [" ".join(str(rng.random()) for _ in range(6)) for _ in range(60)]
    cut = lambda ls: {"\n".join(ls[a:b]) for a, b, _, _ in L.chunks("\n".join(ls))}
    assert len(cut(lines) - cut([*lines[:30], "one more", *lines[30:]])) <= 2


def test_hash_clash_is_decided_by_bytes(make, monkeypatch):
    rows, _ = corpus()
    monkeypatch.setattr(L, "stretch_keys", lambda lines, ranges: [((b - a) % 2, 0) for a, b in ranges])
    cloudpickle.register_pickle_by_value(L)
    try:
        got = {r.doc_id: (r.text, r.n_chunks_removed) for r in L.dedup_chunks(make(rows)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(L)
    assert got == plain(rows)


def test_repeated_rows_null_ids_and_no_rows(make):
    long = " ".join(f"w{k}" for k in range(60))
    got = L.dedup_chunks(make([(None, long), (2, long), (2, long), (1, "x\n" + long)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "x\n" + long), ("2", ""), ("2", ""), ("None", "")]
    assert L.dedup_chunks(make([])).count() == 0


def test_no_shared_run_of_whole_lines_is_left(make):
    rng = random.Random(21)

    def line(n):
        return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))

    def longest(earlier, lines):
        """Words of the longest run of whole lines of ``lines`` that stands in one of ``earlier``."""
        best = 0
        for other in earlier:
            for i in range(len(lines)):
                for j in range(len(other)):
                    k = words = 0
                    while i + k < len(lines) and j + k < len(other) and lines[i + k] == other[j + k]:
                        words, k = words + len(lines[i + k].split()), k + 1
                    best = max(best, words)
        return best

    planted, rows, own = [], [], {}
    for size in (2, 4, 6, 10, 20):
        for _ in range(4):
            planted.append([line(rng.randint(51 // size + 1, 60 // size + 8)) for _ in range(size)])
    for i in range(60):
        before, after = [line(rng.randint(1, 15)) for _ in range(rng.randint(0, 6))], [line(9) for _ in range(rng.randint(0, 6))]
        own[i] = before + after
        rows.append((i, "\n".join(before + planted[i % len(planted)] + after)))
    rows.append((60, "\n".join([line(3), *rows[0][1].split("\n"), "tail"])))  # a run that takes in its surroundings
    got = {r.doc_id: r.text.split("\n") for r in L.dedup_chunks(make(rows)).collect()}
    whole = [t.split("\n") for _, t in rows]
    assert all(longest(whole[:i], got[i]) <= L.LONG for i in range(len(rows)))
    for i in range(60):  # the first copy stays, and of later ones what is not repeated
        assert got[i] == (whole[i] if i < len(planted) else own[i] or [""])
    assert got[60] == [whole[60][0], "tail"]
