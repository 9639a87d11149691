import pytest

from cliptide.llm import pages

CASES = [
    ("<article><p>One  two\n three</p><p>Four</p></article>", "One two three\n\nFour"),
    ("<nav>Menu</nav><header>Site</header><article><header><h1>Title</h1></header><p>Text &amp; more&nbsp;text &#233; &lt;b&gt;</p></article><footer>End</footer>", "Title\n\nText & more text é <b>"),
    ("<main><div class='cookie-notice'>We use cookies</div><p>Body <b>bold</b><br>line</p><form>Name <input></form></main><p>Outside</p>", "Body bold line"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>Plain</p><!-- <p>no</p> --><aside>Side</aside>", "Plain"),
    ("<article><p>First</p><section id=\"comments\"><article class='comment'>Reader says</article></section><p>Last</p></article>", "First\n\nLast"),
    ("<div class=\"ad-slot\"><div>Buy</div> now</div><div class='content'><ul><li>A</li><li>B</li></ul></div>", "A\n\nB"),
    ("<article><p><b>Open<br><p>Next</p>", "Open\n\nNext"),
    ("<nav><ul><li>Open menu<article><p>Body</p></article>", "Body"),
    ("<article>Short</article><article><p>The longer article of the two</p></article>", "The longer article of the two"),
    ("<article><p>Cut off <a href='x", "Cut off"),
    ("<p title=\"a > b\">Quoted</p><p hidden>Not shown</p><p>x < y</p>", "Quoted\n\nx < y"),
    ("<article><script>unclosed <p>never text</p></article>", ""),
    ("<article><p>Intro text.</p><section class='related-work'><p>Earlier studies found it.</p></section><p class='notice-of-motion'>The motion text.</p>"
     "<div id='share-prices'><p>Prices rose.</p></div><p>End.</p></article>", "Intro text.\n\nEarlier studies found it.\n\nThe motion text.\n\nPrices rose.\n\nEnd."),
    ("<article><p>A</p><div class='related-posts'>More</div><div class='x share-buttons'>Share</div><div class='post-comments'>Said</div>"
     "<div class='weather-sidebar'>Rain</div><p>B</p></article><div class='related-work'>Out</div>", "A\n\nB"),
    ("just words", "just words"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_blocks(page, text):
    assert "\n\n".join(pages.blocks(page)[1]) == text


def test_host_boilerplate_goes_and_unique_text_stays(spark):
    foot = "<div>All rights in these pages are held by the editors of the paper</div>"
    rows = [(i, f"http://a.example.org/{i}", f"<div>Own words of page number {i} that stand nowhere else at all</div>{foot}") for i in range(8)]
    rows += [(100 + i, "http://b.example.org/", f"<article><p>Article {i} about a matter of its own kind</p></article>") for i in range(3)]
    rows += [(200 + i, "http://c.example.org/", "<article><p>The same article copied without any change at all</p></article>") for i in range(9)]
    rows += [(300, None, None), (301, "", ""), (302, "no url", "<p>text</p>"), (302, "no url", "<p>text</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' host", "'x' shard", "'x' text", "'x' blocks").repartition(4)
    got = sorted(pages.main_text(docs).collect(), key=lambda r: r.page_id)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id < 8:
            assert r.text == f"Own words of page number {r.page_id} that stand nowhere else at all"
        elif 200 <= r.page_id < 300:
            assert r.text.startswith("The same article")
        elif r.page_id in (300, 301):
            assert r.text == ""
    assert pages.main_text(docs.limit(0)).count() == 0


def test_shards_of_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(pages, "SHARD_PAGES", 16)
    foot = "<div>One line that every page of this very large host has at its end</div>"
    rows = [(i, "http://big.example.org/", f"<div>Page {i} says {i * i} and {i * 7} and {i * 11} to its readers</div>{foot}") for i in range(100)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 100 and all(r.text == f"Page {r.page_id} says {r.page_id**2} and {r.page_id * 7} and {r.page_id * 11} to its readers" for r in got)


def test_repeated_against_counting():
    host = ["a b c d e f g h".split(), "x a b c d e f y".split(), "a b c d e f g h".split(), "q a b c d e f g".split(), "k l m n o p".split()]
    got = pages.repeated([[" ".join(p)] for p in host])
    # "a b c d e f" is on three distinct pages of four; COVER of the first page's block needs "b c d e f g" too, on two.
    assert got[0] == [(2 / 4, 2)] and got[4] == [(1 / 4, 1)]


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in rows.collect()}
    for r in pages.main_text(rows).collect():
        body = html[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text and all(b in " ".join(__import__("html").unescape(body.replace("<br>", " ")).split()) for b in r.text.split("\n\n"))


def test_shards_do_not_change_the_text_of_a_large_host(spark, monkeypatch):
    def page(i):
        part = lambda n: (i * 37 + n) % 100
        inside = "".join(f"<p>{' '.join(f'matter{n}{c}' for c in 'abcdefghij')}</p>" for n in range(8) if part(n * 11) < 44 + n)
        outside = "".join(f"<div>{' '.join(f'notice{n}{c}' for c in 'abcdefghij')}</div>" for n in range(8) if part(n * 13) < 52 + 4 * n)
        own = f"Page {i} says {i * i} and {i * 7} and {i * 11} to its readers"
        return f"<article><p>{own}</p>{inside}</article>" if i % 2 else f"<div>{own}</div>{outside}{inside.replace('p>', 'div>')}"

    rows = [(i, "http://big.example.org/", page(i)) for i in range(200)]
    rows += [(i, "http://big.example.org/", page(7)) for i in range(200, 260)] + [(3, "http://big.example.org/", page(3))] * 3 + [(400, "http://big.example.org/", None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    monkeypatch.setattr(pages, "SHARD_PAGES", 1000)
    whole = sorted(map(tuple, pages.main_text(docs).collect()))
    for size in (16, 60):
        monkeypatch.setattr(pages, "SHARD_PAGES", size)
        assert sorted(map(tuple, pages.main_text(docs).collect())) == whole
    held = [pages.blocks(html) for _, _, html in rows]
    texts = ["\n\n".join(b for b, (part, n) in zip(g[1], told) if n < 4 or part < (0.5 if g[0] else 0.3)) for g, told in zip(held, pages.repeated([g[1] for g in held]))]
    assert [r[2] for r in whole] == [t for _, t in sorted(zip([r[0] for r in rows], texts))]
    assert len({t.count("\n\n") for t in texts}) > 3
