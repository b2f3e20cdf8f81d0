"""Main texts on pages of several templates, broken markup, and hosts whose pages agree."""

import pytest

from trustloom.llm import html_text
from trustloom.llm.html_text import Page
from trustloom.llm.queries import QUERIES

P = ["The first paragraph tells what happened, and where; it is long enough to be prose.", "A second one, with an umlaut ä & a sign < in it, goes on for a while too.", "Short one."]
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Sport and weather</a></li></ul></nav>'


def own(source):
    page = Page(source)
    return page.text(page.choice())


def paragraphs(texts, wrap="<p>{}</p>"):
    return "".join(wrap.format(t.replace("&", "&amp;").replace("<", "&lt;")) for t in texts)


@pytest.mark.parametrize(
    "source",
    [
        f"<html><body>{NAV}<article><h1>Title</h1>{paragraphs(P)}</article><footer>&copy; x</footer></body></html>",
        f'<body><header class="site"><h1>Site</h1></header>{NAV}<div class="content"><h1>Title</h1>{paragraphs(P)}<div class="ad">Buy this long and very cheap thing now. It is good.</div></div><div id="comments"><p>I liked this article very much. Thanks!</p></div></body>',
        f'<div id="wrap" class="has-sidebar"><div class="cookie-notice"><p>We use cookies. Please agree to all of them, now.</p></div><main><h1>Title</h1>{paragraphs(P)}</main><aside><p>An aside about other things that are read a lot.</p></aside></div>',
        f'<form action="/"><table><tr><td>{NAV}</td><td><div class="story"><h1>Title</h1>{paragraphs(P)}</div></td></tr></table></form>',
        f'<body><div class="post"><div class="post-header"><h1>Title</h1></div>{paragraphs(P, "<div>{}</div>")}<form><p>Write to us, please, with your address.</p><input name="q"></form><section class="comments"><article class="comment"><p>First! This is a long comment that says nothing.</p></article></section></div></body>',
        f'<body><script>var a = "<article><p>no</p></article>";</script><style>p{{}}</style><!-- <p>no</p> --><article><header><h1>Title</h1></header>{paragraphs(P, "<p>{}")}<aside>no</aside></article><div style="display: none">hidden words that nobody sees, ever.</div></body>',
        f'<body><ARTICLE><H1>Ti<b>tl</b>e</H1>{paragraphs(P, "<p><i>{}<br></p>")}<span class="ad">Buy</span></ARTICLE><footer><p>Foot of the page, which is long enough to count.</p></footer>',
    ],
)
def test_templates(source):
    assert own(source) == "\n".join(["Title", *P])


def test_white_space_references_and_order():
    assert own("<article><p> a\n\t b&nbsp;&#99;&lt;d&gt; &amp;amp;<br>e</p>tail<ul><li>x<li>y</ul></article>") == "a b c<d> &amp; e\ntail\nx\ny"
    assert own("<article><table><tr><td>1</td><td>2</td></tr><tr><td><p>3</td><td>4</table></article>") == "1 2\n3\n4"
    assert own("") == "" and own("plain words") == "plain words" and own("<p>a<!-- never closed") == "a" and own("<p title='x>a") == ""


def test_deep_and_long_pages_are_read_in_one_pass():
    assert own("<div>" * 20_000 + "<p>deep text, that is here.</p>") == "deep text, that is here."
    assert own("<article>" + "<p>word, more.</p>" * 50_000 + "</article>").count("\n") == 49_999
    assert own("<b" * 30_000) == "" and own("</nav>" * 50_000 + "<p>x</p>") == "x"


def page(i, text, ad="An advertisement that is far longer than the text of this page, and that nothing marks as one. " * 3):
    return (i, f"http://host.example/{i}", f'<body><div class="body-{i}"><p>{text}</p></div><div class="box{i}"><p>{ad}</p></div></body>', "clash", 0)


def test_hosts_agree(spark):
    prose = "On most pages of this host the text is long, so that the vote is clear. " * 20
    rows = [page(i, prose) for i in range(9)] + [page(9, "A short text.")] + [(10, "http://other.example/", page(1, "A short text.")[2], "", 0), (11, None, page(1, prose)[2], "", 0), (12, "http://host.example/", None, "", 0)] + [page(3, prose)] * 2
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, path string, n_chars int")).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert by_id[9].text == "A short text." and by_id[9].n_chars == 13 and by_id[9].path == "body div.body-#"
    assert by_id[10].text.startswith("A short text.\nAn adv") or by_id[10].text.startswith("An adv")  # alone, a page can't know
    assert by_id[11].text == by_id[3].text == prose.strip() and by_id[12].text == "" and by_id[12].url == "http://host.example/"


def test_joined_by_host_and_salt(spark, monkeypatch):
    rows = [page(i, "It is a long text, as texts go, and it goes on. " * 30) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, a string, b int")
    told = sorted(map(tuple, html_text.main_texts(pages).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, html_text.main_texts(pages).collect())) == told
    assert html_text.main_texts(pages.limit(0)).collect() == []


def test_query(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<body>{NAV}<article><h1>Title {i}</h1>{paragraphs(P)}</article></body>") for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op12_html_text"](spark, str(tmp_path)).collect()}
    text = lambda i: "\n".join([f"Title {i}", *P])
    assert got == {i: (u, text(i), len(text(i))) for i, u, _ in rows}
