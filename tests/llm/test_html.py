import html as stdlib
import re

import duckdb
import pytest

from decafix.llm import catalogue
from decafix.llm.html import extract, main_blocks

P = ["Long first paragraph, with commas, and enough words in it to count as content of the page, surely.", "A second one, equally long, which says more about the same thing, and then stops at the end.", "Short."]
BODY = "".join(f"<p>{p}</p>" for p in P)


@pytest.mark.parametrize("page", [
    f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article>{BODY}</article><footer>&copy; me</footer></body>",
    f"<div id=header><h2>Site</h2></div><div class='content'>{BODY}</div><div class='sidebar'><p>{P[0]} aside</p></div>",
    f"<div class=wrap><div class=post-body>{BODY}</div><div id=comments><p>{P[1]} I say, you say, they say.</p><form><p>Your comment, please</p></form></div></div>",
    f"<main><div>{BODY}</div></main><aside><p>{P[0]}</p></aside><div class='cookie-notice'><p>{P[0]} accept, please, now</p></div>",
    f"<article><header><nav>x</nav></header>{BODY}<div class='related-posts'><ul><li><a>One</a></li><li><a>Two more</a></li></ul></div><script>var x='<p>no</p>'</script><div hidden>gone, gone, gone</div></article>",
    f"<table><tr><td>{BODY}</table><div style='display:none'><p>{P[0]}</p></div><div role=banner>top</div>",
    f"<div class='layout with-sidebar'><div class=sidebar><p>{P[1]} x</p></div><article>{BODY}</article></div>",
    f"<div class='page-notice'>{BODY}</div><nav><p>{P[0]}</p></nav>",
    f"<div><p>{P[0]}<p>{P[1]}<p>{P[2]}</div><!-- {BODY} --><style>p{{}}</style><noscript><p>on, on</p></noscript>",
])
def test_junk_goes_and_article_stays(page):
    assert main_blocks(page) == P


LINKS = "<ul><li><a href=a>Reference one</a></li><li><a href=b>Reference two</a></li></ul>"


@pytest.mark.parametrize("page,want", [
    (f"<article><p class=teaser>{P[0]}</p><p>{P[1]}</p></article>", P[:2]),
    (f"<article><p>{P[0]}</p><section class=legal><p>{P[1]}</p></section></article>", P[:2]),
    (f"<article><p>{P[0]}</p><p id=social-history>{P[1]}</p></article>", P[:2]),
    (f"<article><p>{P[0]}</p>{LINKS}</article>", [P[0], "Reference one", "Reference two"]),
    (f"<article><p>{P[0]}</p><table><tr><td><a href=a>Reference one</a></td></tr></table></article>", [P[0], "Reference one"]),
    (f"<body><article><p>A short one, this.</p></article><div><p>{P[0]}</p><p>{P[1]}</p></div></body>", ["A short one, this."]),
    (f"<body><div class=part><div><p>{P[0]}</p></div></div><div class=part><div><p>{P[1]}</p></div></div><div class=part><div><p>{P[0]}</p></div></div></body>", [P[0], P[1], P[0]]),
    (f"<body><div>{P[0]}</div><div>{P[1]}</div><div>{P[0]}</div></body>", [P[0], P[1], P[0]]),
    (f"<main><h1>Head</h1><p>{P[0]}</p><div class='share-buttons'>Share, this</div></main>", ["Head", P[0]]),
    (f"<article>{BODY}<div class='related'><p>{P[0]}</p></div><div class='notice'><p>{P[0]}</p></div><p class=advert>Buy, now</p></article>", P),
    (f"<article>{BODY}</article><div id=comments><article class=comment><p>{P[0]} {P[1]} {P[0]} {P[1]} I say</p></article></div>", P),
    (f"<article>{BODY}<section class=comments><h2>Said</h2><article class=comment-body><p>{P[0]} I say</p></article></section></article>", P),
    (f"<article>{BODY}<div class=reader-comments><p>{P[0]} I say</p></div><ol id=comment-list><li class=comment><p>{P[1]} I say</p></ol></article>", P),
    (f"<article>{BODY}</article><section id=comments><article><p>{P[0]} {P[1]} {P[0]} {P[1]} I say</p></article></section>", P),
    (f"<div class='post comments-open'><article>{BODY}</article></div>", P),
    (f"<article><p>{P[0]}</p><pre><span class=comment># set x</span>\nx = 1</pre><div class=author-reply-times><p>{P[1]}</p></div></article>", [P[0], "# set x x = 1", P[1]]),
])
def test_article_keeps_its_parts(page, want):
    assert main_blocks(page) == want


def test_white_space_references_and_order():
    got = main_blocks("<article><h1> T&eacute;st &amp; &#x41;&#66; </h1><p>a<b>b</b> c<br>d\n\n e&nbsp;f</p>tail<ul><li>one<li>two</ul><pre>x\n y</pre></article>")
    assert got == ["Tést & AB", "ab c d e f", "tail", "one", "two", "x y"]


@pytest.mark.parametrize("page", ["", "<", "<<<>>>", "<p", "</p></div>", "<a title='", "<div>" * 20_000 + "deep" + "</div>" * 20_000, "<p>" * 5000 + "x", "<header>" * 20_000 + "</div>" * 20_000, "<div class=ad><h1>" * 10_000, "<script>x", "<!-- x", "a < b & c > d &", '<p title="' * 2000, "\x00�"])
def test_broken_pages(page):
    assert all(b == " ".join(b.split()) for b in main_blocks(page))


def test_plain_text_and_whole_long_page():
    assert main_blocks("just text, no tags") == ["just text, no tags"]
    ps = [f"paragraph {i}, with a comma" for i in range(30_000)]
    assert main_blocks("<article>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>") == ps


def test_pages_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in catalogue.QUERIES["op7_html"](spark, sf).collect()}
    for pid, url, page in duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall():
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        want = [" ".join(stdlib.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        text = "\n\n".join(w for w in want if w)
        assert (got[pid]["text"], got[pid]["url"], got[pid]["n_chars"]) == (text, url, len(text))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>x</p>", "t"), (1, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract(df).collect()) == [("1", "", 0), ("1", "", 0), ("None", "x", 1)]
    assert extract(df.limit(0)).count() == 0
