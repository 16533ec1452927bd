"""Main texts of pages with a known article."""

import random
from html import escape

import pyarrow.parquet as pq

from fieldpulse.llm import extract, queries

LONG = "A paragraph with enough words in it to be told from menus and other short lines of the page, as articles have."


def plain_runs(lengths, window):
    """Runs of lines that are cut wherever ``window`` lines in a row are empty."""
    full = [i for i, n in enumerate(lengths) if n]
    out = []
    for i in full:
        if out and i - out[-1][1] <= window:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a, b + 1) for a, b in out]


def test_runs_end_where_a_window_is_empty():
    rng = random.Random(8)
    for _ in range(500):
        lengths = [rng.choice([0, 0, 0, 5, 90]) for _ in range(rng.randint(0, 30))]
        for window in (1, 2, 3, 5):
            assert extract.runs(lengths, window) == plain_runs(lengths, window)


def page(article, main="article", extra=""):
    close = main.split()[0]
    return (f"<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var x='</p><p>no';</script></head><body>"
            f"<header><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href=/>Home</a></li><li>Menu</li></ul></nav>"
            f"<div class='cookie-notice'><p>{LONG}</p></div>{extra}<{main}>{article}</{close}>"
            f"<aside><p>{LONG}</p></aside><form><label>{LONG}</label><textarea>{LONG}</textarea></form>"
            f"<section id='comments'><h3>Comments</h3><div class=comment><p>{LONG}</p></div></section><footer>&copy; {LONG}</footer></body></html>")


ARTICLE = (f"<h1>Title</h1><p><b>Bold</b>ed &lt;x&gt; &amp;amp; 1&nbsp;2\n\t3<br>4</p><p>One.</p><div class='ad'>Buy <p>{LONG}</p></div><p>Two.</p>"
           f"<!-- <p>no</p> --><p>{LONG}<ul><li>item<li><a href=x>link</a></ul><script>if (1 < 2) document.write('<p>no');</script><p>End")
WANT = "\n".join(["Title", "Bolded <x> &amp; 1 2 3 4", "One.", "Two.", LONG, "item", "link", "End"])


def test_pages_by_layout():
    for main in ("article", "main", "div role='main'", "div class='post has-sidebar'", "div id=content", "section"):
        assert extract.main_text(page(ARTICLE, main)) == WANT, main
    assert extract.main_text(page(ARTICLE, extra="<div class=ad>never closed " + LONG)) == WANT
    for cut in range(0, len(page(ARTICLE)), 7):
        extract.main_text(page(ARTICLE)[:cut])


def test_unmarked_pages():
    links = "".join(f"<li><a href=/{i}>A link with a long enough name number {i}</a></li>" for i in range(9))
    lines = f"<body><ul>{links}</ul><p>Title</p><p>{LONG}</p><p>Short.</p><ul>{links}</ul><p>tail</p></body>"
    assert extract.main_text(lines) == f"Title\n{LONG}\nShort."
    assert extract.main_text("<p>only</p>") == "only" and extract.main_text("no markup & such < 3") == "no markup & such < 3"
    assert extract.main_text("<nav>menu") == "" and extract.main_text(None) == extract.main_text("") == extract.main_text("<p>") == ""


def test_query_on_awkward_pages(spark, tmp_path):
    rows = [(1, "u", page(ARTICLE)), (None, None, page(ARTICLE)), (2, "v", None), (2, "v", ""), (3, "w", "<article>" + f"<p>{LONG}</p>" * 20_000),
            (4, "x", "<p>" + "<div>" * 5000 + "deep"), (4, "x", "<p>" + "<div>" * 5000 + "deep")]
    schema = "page_id bigint, url string, html string, text string, main_text int, n_chars string, c0 int, page int"
    spark.createDataFrame([(*r, "t", 1, "n", 5, 6) for r in rows], schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op12_html(spark, str(tmp_path))
    assert dict(got.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    texts = [WANT, WANT, "", "", "\n".join([LONG] * 20_000), "deep", "deep"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k, u, t, len(t))) for (k, u, _), t in zip(rows, texts))
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op12_html(spark, f"{tmp_path}/none").count() == 0


def test_generated_pages_give_their_paragraphs():
    """Documents put into markup come back whole, whatever their characters."""
    for row in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pylist():
        blocks = [" ".join(b.split()) for b in (row["text"] or "").split("\n")]
        blocks = [b for b in blocks if b]
        marked = "".join(f"<p>{escape(b)}</p>" for b in blocks)
        assert extract.main_text(page(marked)) == "\n".join(blocks)
