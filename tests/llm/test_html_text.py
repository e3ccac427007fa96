"""Page extraction: boilerplate, blocks, votes, broken markup."""

from tessera.llm import html_text as h

SCHEMA = "page_id long, url string, html string, text string, host string, path int"
PROSE = "Some long enough prose that reads like a sentence, with a comma or two, number %d."


def article(k, cls="post-%d"):
    return (
        f'<html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="home has-sidebar"><header><h1>Site</h1></header>'
        f'<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div id="sidebar"><p>{PROSE % 900}</p></div><div class="ad-box">Buy!</div>'
        f'<div class="{cls % k}"><header><h2>Head {k}</h2></header><p>{PROSE % k}<br>next &amp; line&nbsp;x<p>unclosed <b>bold</b>text<div class="share">Share me</div>'
        f'<form><input><p>Mail</p></form><ul><li>one<li>two</ul><p>3 < 4 &lt;b&gt;</p></div>'
        f'<section id="comments"><p>{PROSE % 901} {PROSE % 902} {PROSE % 903}</p></section><footer>&copy; foot</footer></body></html>'
    )


def want(k):
    return "\n\n".join([f"Head {k}", f"{PROSE % k} next & line x", "unclosed boldtext", "one", "two", "3 < 4 <b>"])


def test_one_page():
    page = h.blocks(article(4))
    assert h.best_path(page)[0].endswith("div.post-0")
    assert h.extract_page(article(4), None) == want(4)
    assert h.extract_page(article(4), "html/body/gone") == want(4)


def test_odd_input():
    for x, y in [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a", "a"), ("a<br>b", "a b"), ("</div></p>x", "x"), ("<script>x", ""), ("<", "<"), ("<p>1 < 2</p>", "1 < 2"),
        ("<div>a<p>b</p>c</div>", "a\n\nb\n\nc"), ("<b>x</b>y", "xy"), ("&lt;p&gt; &#233; &eacute;", "<p> é é"), ("<p>a \n\t b</p> <p> </p>", "a b"), ("<div hidden>a</div>b", "b"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<a href='>'>x</a>", "x"), ('<div style="display: none">q</div>z', "z"), ("<p>" * 3000 + "deep", "deep"),
    ]:
        assert h.extract_page(x, None) == y, x
    assert h.extract_page("<div>" * 2000 + "deep", None) == "deep"
    big = "<article>" + "<p>word word word word word word.</p>" * 20_000 + "</article>"
    assert len(h.extract_page(big, None).split("\n\n")) == 20_000


def test_hostile_markup_is_read_in_linear_time():
    import time

    for text in ('<a <b "' * 14_000, "<a '" * 25_000, '<a href="x' * 10_000, "<!x" * 33_000, "<b>" * 33_000 + "</i>" * 25_000, "<div>" * 20_000 + "deep", "<!--" * 25_000,
                 "<b>" * 20_000 + "<p>x" * 10_000, "<form>" * 16_000, "<" * 100_000, '<a b="' + "<p>" * 30_000, "<li>" * 25_000, "<ul><li>" * 12_000):
        begun = time.process_time()
        h.extract_page(text, None)
        assert time.process_time() - begun < 2, text[:20]
    assert h.extract_page('Hello <a title="x>world', None) == "Hello world"
    assert h.extract_page("a <b c' d>e</b> f", None) == "a e f"
    assert h.extract_page('<p title="a > b">c</p>', None) == "c"


def test_forms_and_ambiguous_names():
    body = "".join(f"<p>{PROSE % k}</p>" for k in range(8))
    text = "\n\n".join(PROSE % k for k in range(8))
    pages = [
        f'<body><form id="aspnetForm"><div class="wrap">{body}</div><form class="searchform"><p>Search here</p></form></form></body>',
        f'<body><div id="share"><div class="text">{body}</div></div><p>14 characters.</p></body>',
        f'<body><div class="modal"><div class="inner">{body}</div></div></body>',
        f'<body><div class="post">{body}</div><div id="share"><p>Share this.</p></div><form><p>Your mail, please.</p></form></body>',
    ]
    for page in pages:
        assert h.extract_page(page, None) == text, page[:60]


def test_a_teaser_does_not_bind_a_long_page():
    story = "".join(f"<p>{PROSE % k}</p>" for k in range(20))
    page = f'<html><body><div class="lead"><p>A short teaser of the story.</p></div><div class="story-body">{story}</div></body></html>'
    assert h.extract_page(page, "html/body/div.lead") == "\n\n".join(PROSE % k for k in range(20))


def test_votes_bind_small_pages(spark):
    rows = [(i, f"https://a.example/{i}", article(i)) for i in range(8)]
    # alone, the long notice beside the short text would win
    rows.append((8, "http://a.example:80/x", f'<html><body class="home has-sidebar"><div class="box"><p>{PROSE % 1}</p><p>{PROSE % 2}</p></div><div class="post-9"><p>Short.</p></div></body></html>'))
    rows += [(9, None, None), (10, "nohost", ""), (11, "https://b.example/", "<body><p>only text</p></body>")]
    rows += [rows[0]]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = h.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert [text[i] for i in range(8)] == [want(i) for i in range(8)]
    assert text[8] == "Short." and text[9] == text[10] == "" and text[11] == "only text"
    assert h.main_text(df.limit(0)).count() == 0


def test_doubtful_wrappers():
    text = "\n\n".join(["Head", *(PROSE % k for k in range(6))])
    body = "<h2>Head</h2>" + "".join(f"<p>{PROSE % k}</p>" for k in range(6))
    side = f'<div class="sidebar-primary widget-area"><div class="widget"><p>{PROSE % 900}</p></div></div>'
    tail = f'<div class="comments-wrap">{"".join(f"<p>{PROSE % k}</p>" for k in range(910, 920))}</div>'
    pages = [
        f'<div class="content-sidebar-wrap"><main>{body}</main>{side}</div>',
        f'<div class="content-sidebar-wrap"><div class="entry-content">{body}</div>{side}{tail}</div>',
        f'<div class="site-content with-sidebar">{body}</div>{side}',
        f'<div class="elementor-widget elementor-widget-theme-post-content"><div class="elementor-widget-container">{body}</div></div>',
        f'<div class="widget Blog" id="Blog1"><div class="blog-posts"><div class="post hentry">{body}</div></div></div>{side}',
        '<div class="page">' + "".join(f'<div class="elementor-widget" id="e{k}">{x}</div>' for k, x in enumerate(body.replace("><", ">\n<").split("\n"))) + "</div>",
        f'<div class="post">{body}<div class="share-box"><p>{PROSE % 903}</p></div></div><div class="related-posts"><article><p>{PROSE % 904}</p></article></div>',
    ]
    for p in pages:
        assert h.extract_page(f"<html><body><nav><a href=x>Home</a></nav>{p}<footer>foot</footer></body></html>", None) == text, p
    assert h.extract_page('<div class="notice-box">only this</div>', None) == "only this"
    assert h.extract_page(f'<div class="sidebar"><p>{PROSE % 1}</p></div><div class="box">x</div>', None) == "x"
