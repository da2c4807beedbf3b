from reviewlake.llm import extract

LONG = "A paragraph of the article that says one thing after the other and goes on for quite a while."


def test_article_with_everything_around():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site name of a paper</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
    <!-- comment --><div class="ad">Buy this product now, it is the best of all products that there are.</div>
    <article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>Short.</p><p>&lt;tag&gt; caf&eacute;&nbsp;&#8364;   {LONG}</p>
    <aside>Side note that stands beside the text and is long enough.</aside><form><p>Your name</p></form></article>
    <section id="comments"><p>I read this and disagree with every single word of it, {LONG}</p></section>
    <div role="alert" class="cookie-notice">We use cookies. {LONG}</div><footer>&copy; {LONG}</footer>"""
    assert extract.main_text(html) == f"Title & more\n{LONG}\nShort.\n<tag> café € {LONG}"


def test_page_without_article_markup():
    html = f"<body><div class='sidebar'><p>{LONG}</p></div><div id='content'><h2>Head</h2><p>{LONG}<p>No.<p>{LONG}</div><div><a href='x'>one</a><a href='y'>two</a></div></body>"
    assert extract.main_text(html) == f"Head\n{LONG}\nNo.\n{LONG}"


def test_tiny_article_next_to_long_advert():
    assert extract.main_text(f"<div class='ad'>{LONG * 3}</div><article><h1>Auxpa.</h1><p>Auxpa.</p></article>") == "Auxpa.\nAuxpa."


def test_odd_pages():
    assert extract.main_text("") == extract.main_text("<p> </p>") == extract.main_text("<nav>menu</nav>") == ""
    assert extract.main_text("no markup at all") == "no markup at all"
    assert extract.main_text("<p>open <b>tags <i>everywhere") == "open tags everywhere"
    assert extract.main_text("</div></p>stray ends<p>and text").count("\n") == 1
    assert extract.main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert extract.main_text("<div>" * 5000 + "deep") == "deep"


def test_table_of_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = extract.extract(pages)
    assert found.columns == ["page_id", "url", "text"]
    assert sorted((r["page_id"] or 0, r["text"]) for r in found.collect()) == [(0, ""), (1, "a"), (1, "a"), (2, "")]
    assert extract.extract(pages.limit(0)).collect() == []


def paragraphs(n):
    return "".join(f"<p>{k} {LONG}</p>" for k in range(n)), "\n".join(f"{k} {LONG}" for k in range(n))


def test_names_that_hold_a_mark_word():
    inside, text = paragraphs(3)
    for name in ("content no-sidebar", "long-form", "ad-free", "with-comments page"):
        assert extract.main_text(f"<div><a href='x'>one</a></div><div class='{name}'>{inside}</div>") == text
    for name in ("ad", "cookie-notice", "sidebar-left", "post sidebar", "social_share", "main-navigation"):
        assert extract.main_text(f"<div class='{name}'><p>{LONG}</p></div><div>{inside}</div>") == text
    assert extract.main_text(f"<div class='sidebar'>{inside}</div><div><p>Short.</p></div>") == "Short."


def test_form_around_a_page_and_forms_in_it():
    inside, text = paragraphs(3)
    assert extract.main_text(f"<form><nav>Menu</nav><div>{inside}</div><form><p>Your name</p></form></form>") == text
    assert extract.main_text(f"<form id='aspnet'><div class='ad'>{LONG}</div><article>{inside}<div class='related-posts'><p>{LONG}</p></div></article></form>") == text
    assert extract.main_text(f"<article><p>{LONG}</p><form>{inside}</form></article>") == LONG


def test_articles_by_weight():
    inside, text = paragraphs(6)
    assert extract.main_text(f"<div>{inside}</div><article><h3>Read next</h3><p>A teaser of another page.</p></article>") == text
    assert extract.main_text(f"<article>{inside}</article><div><p>{LONG}</p></div>") == text
    assert extract.main_text(f"<article>{inside}</article><article class='comment'><p>I disagree. {LONG}</p></article>") == text
    assert extract.main_text(f"<div>{inside}</div><article class='comment'><p>I disagree. {LONG}</p></article>") == text
    assert extract.main_text(f"<article class='post teaser'>{inside}</article>") == text
    assert extract.main_text(f"<article><p>{LONG}</p></article><article><p>Two. {LONG}</p></article>") == f"{LONG}\nTwo. {LONG}"


def test_given_pages_equal_a_plain_reading():
    """Pages as the given ones are: what a regular expression finds within the article."""
    import html
    import re

    import pyarrow.parquet as pq

    strip = re.compile(r"<(script|style|nav|aside|form|footer|header)\b.*?</\1>|<!--.*?-->", re.S | re.I)
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        body = strip.sub("", re.search(r"<article[^>]*>(.*?)</article>", page, re.S).group(1))
        blocks = re.split(r"</?(?:p|h[1-6]|div|li|ul|ol|blockquote|section|article)\b[^>]*>", body)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
        assert extract.main_text(page) == "\n".join(b for b in plain if b)
