import random
import time

import pytest
from pyspark.sql import functions as F

from paneltide.llm import page_text as P

BODY = "<p>First paragraph, with commas, and enough text to count as a part of the article.</p><p>Second one &amp; more; it goes on, and on, for a while.<p>Third"
TEXT = "First paragraph, with commas, and enough text to count as a part of the article. Second one & more; it goes on, and on, for a while. Third"

PAGES = [
    (None, ""),
    ("", ""),
    ("just text &lt;here&gt;\n  twice", "just text <here> twice"),
    (f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1>{BODY}</article><footer>(c)</footer></body>", f"Head {TEXT}"),
    (f"<body><div id=menu><ul><li><a href=1>one, two</a></ul></div><div class='post-body'>{BODY}</div><div class=sidebar><p>Some, other, words, here</p></div></body>", TEXT),
    (f"<body><main>{BODY}<aside>no</aside><form><p>sign up, now, please</p></form></main><section id=comments><p>I, as a reader, think so too, and write a lot about it, see.</p></section></body>", TEXT),
    (f"<div class='cookie-notice'>We, use, cookies, and more</div><script>var a='<p>no</p>';</script><style>p{{}}</style><article>{BODY}<!-- c --></article>", TEXT),
    ("<article><p>a<b>b</b>c<br>d</p><table><tr><td>x<td>y</table><pre>  q\n r </pre></article>", "abc d x y q r"),
    ("<article><p>unclosed <b>bold<p>next</article><p>tail text", "unclosed bold next"),
    ("<p>open <script>never ends", "open"),
    ("<article><header><h1>Title</h1></header><p>text &amp text &#233; &unknown;</p></article>", "Title text & text é &unknown;"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_pages(page, want):
    assert P.main_text(page) == want


def test_frame(spark):
    rows = [(k, f"u{k}", page) for k, (page, _) in enumerate(PAGES)]
    rows += [(None, None, "<p>deep " + "<div>" * 3000 + "x, y</p>"), (0, "u0", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = P.extract(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)
    assert P.extract(frame.limit(0)).count() == 0


def plainly_scored(page):
    """Each element's points by walking from each block to the page, as the docstring says them."""
    nodes, blocks = P._parsed(page)
    points = {id(n): 0.0 for n in nodes}
    for owner, text, linked in blocks:
        if not owner.bad:
            own = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1.0, linked / len(text)))
            node = owner.parent if owner.tag in ("p", "h1", "h2") and owner.parent is not None else owner
            share = 1.0
            while node is not None:
                points[id(node)] += own * share
                share = share / 2 if share == 1.0 else share / 3
                node = node.parent
    return nodes, points


def test_points_equal_a_walk_from_each_block():
    rng = random.Random(3)
    parts = ["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<i>", "<h1>", "</h1>", "<ul>", "<li>", "<nav>", "</nav>", "one, two, three ", "words " * 40]
    for _ in range(300):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(5, 60)))
        nodes, points = plainly_scored(page)
        again, blocks = P._parsed(page)
        P._score(again, [b for b in blocks if not b[0].bad])
        assert [n.score for n in again] == pytest.approx([points[id(n)] for n in nodes])


@pytest.mark.parametrize(
    "page",
    [
        "<div><p>some text, more</p>" * 32000,
        "<a href='x'>y</a> <i>z" * 32000,
        "<i>" * 32000 + "<h1>x</h1>" * 32000,
        "<a" * 100000,
        "<!x" * 100000,
        "<![CDATA[" * 100000 + ">",
        "<a><i>x" * 32000,
        "<p>" + "<!--" * 100000,
    ],
)
def test_deep_and_unclosed_pages_take_time_by_their_length(page):
    start = time.process_time()
    P.main_text(page)
    assert time.process_time() - start < 10  # with work by the square it took minutes


def test_a_link_that_is_left_out_keeps_its_text_when_the_next_begins():
    assert P.main_text("<article><p>text <a class=ad>buy <a class=ad>now</a> more</p></article>") == "text more"
