"""Tag-path ratios decide inside marked articles, and a wrapper's name puts no article out."""

from html.parser import HTMLParser

import pyarrow.parquet as pq

from waymark.llm import tagpath

LONG = "Here is a long sentence, with commas, points and much to say; it goes on. " * 5
TEXT = LONG.strip()


def test_ratios_decide_inside_articles():
    junk = "<div class='meta'><span>x1</span></div>" + "".join(f"<div class='tags'><span class='k{i}'><a href=x>tag{i}</a></span></div>" for i in range(4))
    got = tagpath.extract(f"<body><article><h1>Title, here</h1><p>{LONG}</p><p>Short.</p>{junk}</article></body>")
    assert TEXT in got and "Title, here" in got and "Short." in got and "tag" not in got


def test_wrappers_are_not_inherited():
    for wrap in ("<div class='layout has-sidebar'>", "<div id='page-nav'>", "<form>"):
        assert tagpath.extract(f"<body>{wrap}<article><p>{LONG}</p></article></body>") == TEXT
    for wrap in ("<div class='layout has-sidebar'>", "<div id='page-nav'>"):
        assert tagpath.extract(f"<body>{wrap}<div><p>{LONG}</p></div><div class='ad'>buy, now.</div></div></body>") == TEXT
    inside = f"<article><p>{LONG}</p><div class='comments'><article><p>{LONG[:80]}reader</p></article></div></article>"
    assert tagpath.extract(f"<body>{inside}</body>") == TEXT


def test_long_words_of_names_and_text_nodes():
    assert tagpath.extract("<article><p>AT&<b>amp;</b> T, and more to say here.</p></article>") == "AT&amp; T, and more to say here."
    for name in ("search-tips", "side-story", "social-history", "share-price"):
        assert tagpath.extract(f"<body><div class='{name}'><p>{LONG}</p></div></body>") == TEXT
    assert tagpath.extract(f"<body><div><h2>Head</h2><p>{LONG}</p></div><div class='share'>Tweet, please.</div></body>") == f"Head\n{TEXT}"
    assert tagpath.extract(f"<article><p>{LONG}</p></article><!-- open") == TEXT
    assert tagpath.extract(f"<article><p>1 < 2, and {LONG}</p><p title=\"open>{LONG}</p></article>").startswith("1 < 2, and Here")


class Plain(HTMLParser):
    """An extractor of its own: blocks of the page's article, nothing of what never is content."""

    SKIP = ("script", "style", "nav", "aside", "form", "header", "footer", "figure", "button")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.skipped = 0
        self.blocks = [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skipped += tag in self.SKIP
        if tag in ("p", "h1", "h2", "h3", "li", "div", "br", "article"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skipped -= tag in self.SKIP
        if tag in ("p", "h1", "h2", "h3", "li", "div", "article"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.blocks[-1].append(data)


def test_pages_equal_a_plain_parser():
    """All given pages of two sizes, against an extractor by the standard library's parser."""
    n = 0
    for size in ("sf0.001", "sf0.01"):
        for html in pq.read_table(f"/root/testdata/{size}/pages.parquet", columns=["html"]).column(0).to_pylist():
            plain = Plain()
            plain.feed(html or "")
            plain.close()
            want = "\n".join(x for x in (" ".join("".join(b).split()) for b in plain.blocks) if x)
            assert tagpath.extract(html) == want
            n += 1
    assert n > 200


def page(body):
    return tagpath.extract(f"<html><body>{body}</body></html>").split("\n")


def test_lists_tables_and_code_stay_whole():
    rest = "<ul><li>one<li>two</ul><pre>x = 1\ny = 2</pre><table><tr><td>1</td><td>2</td></tr></table><p>End.</p>"
    want = ["Title", TEXT, "one", "two", "x = 1 y = 2", "1", "2", "End."]
    assert page(f"<article><h1>Title</h1><p>{LONG}</p>{rest}</article>") == want
    assert page(f"<div id='top'>Welcome</div><div class='post'><h1>Title</h1><p>{LONG}</p>{rest}</div><div class='bottom'>All rights reserved.</div>") == want


def test_names_lower_a_score_but_put_no_article_out():
    assert page("<article><h1>T</h1><div class='menu-of-the-day'><p>Soup, bread, and a long list of other dishes.</p></div></article>") == ["T", "Soup, bread, and a long list of other dishes."]
    assert page(f"<div class='menu'><h2>Menu</h2><p>{LONG}</p></div>") == ["Menu", TEXT]


def test_comments_and_notices_without_an_article():
    for extra in ("<div class='feedback'><p>I liked it, really; thanks.</p></div>", "<section id='user-responses'><p>I liked it, really; thanks.</p></section>", "<div><p>We use cookies, as all do.</p><a href=x>Accept</a></div>", "<div class='cookie-bar'>We use cookies.</div>", "<ul><li><a href=a>Home</a><li><a href=b>About us</a></ul>"):
        assert page(f"<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>{extra}") == ["Title", TEXT, TEXT], extra
        assert page(f"{extra}<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>") == ["Title", TEXT, TEXT], extra


def test_links_inside_text_stay_and_lists_of_links_go():
    assert page(f"<article><p>{LONG}<a href=x>a link</a>, and more.</p><ul><li><a href=y>Other page</a><li><a href=z>Next page</a></ul></article>") == [f"{TEXT} a link, and more."]
