"""Main text of pages with planted parts."""

import html
import random
import re

from evalmill.llm.main_text import main_text, main_texts

from .helpers import SF

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def paragraph(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ","]) for _ in range(n)) + "."


def page(rng, semantic):
    paragraphs = [paragraph(rng, rng.randrange(12, 60)) for _ in range(rng.randrange(2, 7))]
    title = paragraph(rng, 5)
    menu = "".join(f'<li><a href="/{k}">{rng.choice(WORDS)}</a>' for k in range(6))
    body = "".join(f"<p>{html.escape(p)}" + ("</p>" if rng.random() < 0.6 else "") for p in paragraphs)
    tag = ("<article>", "</article>") if semantic else ('<div class="post-body">', "</div>")
    noise = f'<div class="cookie-notice"><p>{paragraph(rng, 40)}</p></div><aside><p>{paragraph(rng, 50)}</p></aside>'
    comments = f'<section id="comments"><p>{paragraph(rng, 80)}</p><p>{paragraph(rng, 80)}</p></section>'
    ad = f'<div class="ad">{paragraph(rng, 30)}</div>'
    source = (
        f"<html><head><title>x</title><script>if (a<b) '<p>'</script></head><body><header><p>{paragraph(rng, 20)}</p></header><nav><ul>{menu}</ul></nav>{noise}"
        f"<div id=page>{tag[0]}<h1>{title}</h1>{ad}{body}{tag[1]}{comments}</div><form><p>{paragraph(rng, 30)}</p></form><footer>{paragraph(rng, 40)}</footer>"
    )
    return source, "\n".join([title, *paragraphs])


def test_planted_articles():
    rng = random.Random(9)
    for k in range(120):
        source, want = page(rng, k % 2 == 0)
        assert main_text(source) == want


def test_given_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in main_texts(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ").replace("<b>", ""))
        want = "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_broken_and_odd_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text("<html><body></body>") == ""
    assert main_text("plain text &lt;b &eacute;&#233;&#xE9;&amp") == "plain text <b ééé&"
    assert main_text('<p title="a>b">x<script>var a="</p>";</script>y') == "xy"
    assert main_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert main_text("</b>" * 20000 + "<p>text <!-- open") == "text"
    assert main_text("<p>one<p>two<br>three<ul><li>a<li>b</ul>") == "one\ntwo three\na\nb"
    assert main_text("<style>p{}") == "" and main_text("a<b") == "a"


def test_names_do_not_leave_out_the_article():
    rng = random.Random(4)
    first, second, third = (paragraph(rng, 60) for _ in range(3))
    body = f"<h1>Title</h1><p>{first}</p><p>{second}</p>"
    want = f"Title\n{first}\n{second}"
    for name in ("overflow-hidden", "content has-sidebar", "elementor-widget-text-editor", "post comments-open", "sidebar-left", "widget"):
        assert main_text(f'<body><div class="{name}">{body}</div><div class="ad">ad</div><div id="site-footer">{third}</div>') == want
    assert main_text(f'<article>{body}<section id="social-policy"><p>{third}</p></section></article>') == f"{want}\n{third}"
    assert main_text(f'<div class="overflow-hidden"><p>{first}</p></div>') == main_text(f'<x-app class="widget"><p>{first}</p></x-app>') == first
    comments = "".join(f'<article id="div-comment-{k}" class="comment-body"><p>{third}</p></article>' for k in range(9))
    assert main_text(f'<div class="post comments-open">{body}</div><div id="comments" class="comments-area">{comments}</div>') == want


def test_siblings_of_an_article():
    rng = random.Random(5)
    first, second, third = (paragraph(rng, 60) for _ in range(3))
    assert main_text(f"<article>{4 * f"<p>{first}</p>"}</article><article><p>{second}</p></article><section><p>{third}</p></section>") == 4 * f"{first}\n" + f"{second}\n{third}"


def test_odd_rows(spark):
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long text, " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted((tuple(r) for r in main_texts(df).collect()), key=str)
    long_text = ("long text, " * 50000).strip()
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0), (None, "v", "", 0), (3, "w", long_text, len(long_text))], key=str)
    assert main_texts(df.limit(0)).count() == 0


def test_wrapped_paragraphs():
    """Wrappers to depth 5 around each paragraph lose neither paragraphs nor the heading."""
    rng = random.Random(6)
    for depth in range(6):
        for n in (2, 3, 5, 8):
            ps = [paragraph(rng, rng.randrange(12, 70)) for _ in range(n)]
            body = "".join("<div>" * depth + f"<p>{p}</p>" + "</div>" * depth for p in ps)
            source = f'<body><div class="wrap"><div><h1>Title here</h1>{body}</div></div><div class="footer">x</div>'
            assert main_text(source) == "\n".join(["Title here", *ps])


def test_parts_beside_the_container():
    rng = random.Random(7)
    ps = [paragraph(rng, 40) for _ in range(4)]
    core = "".join(f"<p>{p}</p>" for p in ps)
    links = '<div><a href="x">Privacy</a> <a href="y">Terms</a></div>'
    source = f"<body><h1>Head</h1><div>{core}</div><div><p>Thanks for reading.</p></div><ul><li>one<li>two</ul>{links}"
    assert main_text(source) == "\n".join(["Head", *ps, "Thanks for reading.", "one", "two"])


def test_names_of_comments_adverts_and_related_parts():
    rng = random.Random(8)
    ps = [paragraph(rng, 40) for _ in range(4)]
    core, want = "<h1>T</h1>" + "".join(f"<p>{p}</p>" for p in ps), "\n".join(["T", *ps])
    names = (
        "reader-comments article-comments user-comments comment-thread comments-wrap disqus_thread related-posts recommended-stories "
        "newsletter-form cookie-policy-popup ad-leaderboard sponsored-content relatedPosts commentList"
    )
    for name in names.split():
        for tag in ("div", "section", "article"):
            for kind in ("class", "id"):
                for length in (30, 400):  # 400: readers write more than the author
                    part = f'<{tag} {kind}="{name}"><p>{paragraph(rng, length)}</p></{tag}>'
                    assert main_text(f"<body><article>{core}</article>{part}") == want, name
                    assert main_text(f"<body><div>{core}{part}</div>") == want, name
    text = paragraph(rng, 60)
    for name in ("related-work", "no-ads", "with-comments"):
        assert main_text(f'<article>{core}<section id="{name}"><p>{text}</p></section></article>') == f"{want}\n{text}"
    code = '<pre><span class="comment"># add</span> x = 1</pre>'
    assert main_text(f"<article>{core}{code}</article>") == f"{want}\n# add x = 1"


def test_announced_articles():
    """Articles whose headline is a link go, but on a page that lists nothing else."""
    rng = random.Random(9)
    ps = [paragraph(rng, 40) for _ in range(4)]
    core, want = "<h1>T</h1>" + "".join(f"<p>{p}</p>" for p in ps), "\n".join(["T", *ps])
    parts = [(paragraph(rng, 4), paragraph(rng, 25)) for _ in range(3)]
    teasers = "".join(f'<article><h3><a href="x">{a}</a></h3><p>{b}</p></article>' for a, b in parts)
    assert main_text(f"<body><article>{core}</article>{teasers}") == want
    assert main_text(f"<body><div><article>{core}</article><div>{teasers}</div></div>") == want
    assert main_text(f"<body><article>{core}<div>{teasers}</div></article>") == want
    assert main_text(f"<body><div>{teasers}</div>") == "\n".join(x for part in parts for x in part)
