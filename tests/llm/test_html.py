import re
from html.parser import HTMLParser

import numpy as np
import pytest

from tracemill.llm import html

PROSE = "It was the best of the times and it was the worst of times, for all of them and for us"


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href="/a>b">Menu</a></ul></nav><!-- <p>gone --> <div class="cookie-notice">{PROSE}</div>
    <div id=sidebar><p>{PROSE}</div><article><header><h1>Title &amp; more</h1></header><p><b>{PROSE}.<br><p>Of.</p><p>x &lt;y&gt;&nbsp;z&eacute; 1 < 2
    <ul><li>one<li>two</ul><form><input><p>{PROSE}</form><p>ZZZ QQQ WWW {"KKK " * 40}</p><section class="comments"><p>{PROSE}</p></section></article>
    <aside>{PROSE}</aside><footer>&copy; {PROSE}</footer></body></html>"""
    want = f"Title & more {PROSE}. Of. x <y> zé 1 < 2 one two ZZZ QQQ WWW {' '.join(['KKK'] * 40)}"
    assert html.main_text(page) == want


def test_without_article_blocks_decide():
    page = f"<div>Short head</div><div>{PROSE}</div><p>Of it.</p><div>{PROSE}</div>" + "<ul>" + '<li><a href="x">Link with words</a></li>' * 5 + "</ul><p>end bit</p>"
    assert html.main_text(page) == f"Short head {PROSE} Of it. {PROSE}"


def test_odd_pages():
    for page, want in ((None, ""), ("", ""), ("plain", "plain"), ("<p>a<!-- never closed", "a"), ("a<script>x", "a"), ("<p>a <b", "a"), ("1 < 2", "1 < 2"), ("<p>a</p></div></p>", "a"), ("&#x41;&#66;&unknown;", "AB&unknown;"), ("<p>a\n\t b c</p>", "a b c")):
        assert html.main_text(page) == want, page
    for unit in ("<", "<a ", '<a "', "<p>", "<div>", "<!--", "</p>", "&", "<script>"):
        html.main_text(unit * 30_000)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{PROSE}</article>", "t"), (1, "u", None, "t"), (None, None, "x", "t")], "page_id bigint, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract(pages).collect())
    assert got == [("1", "", 0), ("1", PROSE, len(PROSE)), ("None", "x", 1)]
    assert html.extract(pages.limit(0)).count() == 0


def test_a_language_without_stop_words_keeps_its_text():
    one = "Wczoraj rano mieszkańcy miasta spotkali nowego burmistrza przed starym ratuszem."
    two = "Burmistrz obiecał naprawę mostu oraz budowę szkoły jeszcze przed końcem roku."
    menu = "<div>" + " ".join(f'<a href="/{k}">Wiadomości i sport {k}</a>' for k in range(5)) + "</div>"
    page = f"<body><nav>all of the news that is for you and for the others in it</nav>{menu}<div><p>{one}</p><p>{two}</p></div></body>"
    assert html.main_text(page) == f"{one} {two}"


def test_names_that_only_mention_a_part_are_content():
    for attributes in ('class="content no-sidebar"', 'class="with-header"', 'data-id="share-1"', 'class="login-wall article-body"', 'class="has-nav-left"', "id=post-1", 'data-x="a" class=main-column'):
        assert html.main_text(f"<div {attributes}><p>{PROSE}</p></div><div><p>{PROSE} two</p></div>") == f"{PROSE} {PROSE} two", attributes
    for attributes in ('class="x site-footer"', 'id="sidebar-left"', "class=navBar", 'class="cookie-banner fixed"', 'class="related-posts"', "class='AD'", 'role="navigation"', "class=comment-list"):
        assert html.main_text(f"<div><p>{PROSE} two</p></div><div {attributes}><p>{PROSE}</p></div>") == f"{PROSE} two", attributes


def test_a_name_does_not_drop_most_of_the_prose():
    long = f"<p>{PROSE}.</p>" * 6
    assert html.main_text(f'<div class="widget">{long}</div><p>{PROSE}</p>') == " ".join([PROSE + "."] * 6 + [PROSE])
    assert html.main_text(f'<div class="widget">{long}</div><article><p>{PROSE}</p></article>') == PROSE
    assert html.main_text(f'<div class="comments">{long}</div><p>{PROSE}</p>') == PROSE


def test_a_slash_does_not_end_a_script():
    assert html.main_text(f'<script src="a.js"/>var secret = 1;</script><p>{PROSE}</p>') == PROSE
    assert html.main_text(f"<div/><p>{PROSE}</p><svg/><p>{PROSE}</p>") == f"{PROSE} {PROSE}"


class Plain(HTMLParser):
    """Blocks by the library's parser, with the whole stack of open elements each: (text, linked characters, elements)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.now, self.raw, self.link, self.opened = [], [], [], None, False, 0

    def cut(self):
        text = " ".join("".join(t for t, _ in self.now).split())
        if text:
            self.found.append((text, sum(len("".join(t.split())) for t, link in self.now if link), list(self.stack)))
        self.now = []

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        if tag in ("script", "style", "title"):
            self.raw = tag
            if tag == "title":
                self.cut()
        elif tag == "a":
            self.link = True
        elif tag == "br":
            self.now.append(("\n", False))
        elif tag not in ("b", "meta"):
            self.cut()
            while self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] == tag == "li"):
                self.stack.pop()
            self.opened += 1
            self.stack.append((tag, dict(attrs), self.opened))

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
        elif tag == "a":
            self.link = False
        elif tag not in ("b", "br", "meta"):
            self.cut()
            at = [k for k, (t, _, _) in enumerate(self.stack) if t == tag]
            if at:
                del self.stack[at[-1] :]

    def handle_data(self, data):
        if not self.raw:
            self.now.append((data, self.link))


def plain_text(page):
    """The rules once more, by looking up every neighbour of every block."""
    p = Plain()
    p.feed(page)
    p.close()
    p.cut()
    rows, forms, total, articles = [], {}, 0, 0
    for text, linked, stack in p.found:
        bad = any(t in ("nav", "footer", "aside", "head") or a.get("class") in ("ad", "comments", "sidebar") or (t == "header" and "article" not in [x[0] for x in stack[:k]]) for k, (t, a, _) in enumerate(stack))
        article = any(x[0] == "article" for x in stack)
        words = re.findall(r"[^\W\d_]+", text.lower())
        stops = sum(w in html.STOP_WORDS for w in words) / max(1, len(words))
        around = [n for t, _, n in stack if t == "form"]
        if not bad and len(text) >= 70 and linked <= 0.4 * len(text):
            total += len(text)
            articles += len(text) if article and not around else 0
            for n in around:
                forms[n] = forms.get(n, 0) + len(text)
        inside = [0] + [n for t, _, n in stack if t not in html.OWN_TAGS or stack[-1][2] != n]
        rows.append([text, bad, article, stops, linked / max(1, len(text.replace(" ", ""))), inside[-1], around])
    for r in rows:
        r[1] = r[1] or any(2 * forms.get(n, 0) <= total or articles for n in r[6])
    rows = [r[:6] for r in rows]
    known = any(s >= 0.2 and len(t) >= 40 and share <= 0.4 and not bad for t, bad, _, s, share, _ in rows)
    labels = []
    for t, bad, article, s, share, _ in rows:
        if bad or (share > 0.4 and not article):
            labels.append("bad")
        elif len(t) >= 70 and (s >= 0.2 or not known) and share <= 0.4:
            labels.append("good")
        else:
            labels.append("bad" if 40 <= len(t) < 280 and s < 0.1 and known and not article else "")
    out = []
    for k, (t, _, article, _, _, inside) in enumerate(rows):
        label = labels[k]
        if not label:
            sides = [next((j for j in order if labels[j]), None) for order in (range(k - 1, -1, -1), range(k + 1, len(rows)))]
            kin = any(j is not None and labels[j] == "good" and rows[j][5] == inside for j in sides)
            near = [j for j in sides if j is not None and not ((article or kin) and rows[j][1])]
            kinds = {labels[j] for j in near}
            if not near:
                label = "good" if article or "good" not in labels else "bad"
            elif len(kinds) == 1:
                label = kinds.pop()
            else:
                left, right = k - sides[0], sides[1] - k
                label = "good" if article else "bad" if left == right else labels[sides[0] if left < right else sides[1]]
        if label == "good":
            out.append(t)
    return " ".join(out)


def test_random_pages_equal_a_plain_implementation():
    g = np.random.default_rng(9)
    text = [PROSE, "Of it.", "Zzz qqq www kkk jjj xxx vvv yyy ppp lll mmm nnn", "&copy; 2020 &amp; more", "the of and", "Kkk " * 90, PROSE[:45]]

    def block(depth):
        kind = g.integers(0, 9)
        body = text[g.integers(0, len(text))]
        if depth and kind < 4:
            tag = ["div", "section", "article", "nav", "footer", "aside", "header", "form", 'div class="ad"', 'div class="comments"'][g.integers(0, 10)]
            end = "" if g.random() < 0.05 else f"</{tag.split()[0]}>"
            return f"<{tag}>" + "".join(block(depth - 1) for _ in range(g.integers(0, 5))) + end
        if kind == 4:
            return f'<ul><li><a href="x">{body}</a><li>{body}</ul>'
        return ["<p>{}", "<p><b>{}<br></p>", "<div>{}</div>", "<script>var a='</p>';</script><p>{}</p>"][kind % 4].format(body)

    seen = 0
    for _ in range(1500):
        page = "<html><head><title>The title of it</title><style>p{}</style></head><body>" + "".join(block(2) for _ in range(g.integers(1, 8)))
        want = plain_text(page)
        seen += bool(want)
        assert html.main_text(page) == want, page
    assert seen > 800


LONG_TEXT = "The river was high that year and the people of the town had to go to the hills with all that they could carry, which was not much."
SHORT_TEXT = "They came back in the spring."


@pytest.mark.parametrize(
    "page",
    [
        '<div title="A hidden gem"><p>{0}</p><p>{1}</p></div>',
        '<div class="article-with-ads"><p>{0}</p><p>{1}</p></div>',
        '<div class="post-with-comments"><p>{0}</p><p>{1}</p></div>',
        '<div class="recipe cookie"><p>{0}</p><p>{1}</p></div>',
        '<body><form id="aspnetForm" action="/x"><p>{0}</p><p>{1}</p></form></body>',
        '<body><a name="top"><p>{0}</p><p>{1}</p></body>',
        '<body><a href="#top">Top<p>{0}</p><p>{1}</p><p>{0}</p><a href="/">Home</a></body>',
        '<article><p data-caption="the hidden valley">{0}</p><p>{1}</p></article>',
        '<body><p>{0}</p><p>{1}</p><footer><p>Company 2024, all rights reserved by the owners of it.</p></footer></body>',
        '<body><nav><a href="/">Home</a></nav><div><h1>A year</h1><p>{0}</p><p>{1}</p></div><footer>Company</footer></body>',
    ],
)
def test_articles_that_names_and_anchors_must_not_lose(page):
    got = html.main_text(page.format(LONG_TEXT, SHORT_TEXT))
    assert LONG_TEXT in got and SHORT_TEXT in got and "Company" not in got and "Home" not in got


@pytest.mark.parametrize(
    "extra",
    [
        '<div class="cookie-banner">{0}</div>', '<div class="comments">{0}</div>', '<div hidden>{0}</div>', '<div aria-hidden="TRUE">{0}</div>', "<div style='color:red; display : none'>{0}</div>", '<form class="newsletter"><p>{0}</p></form>',
        '<a href="/x"><h3>A story that is told</h3><p>{0}</p></a>', '<div class="row comments"><p>{0}</p></div>',
    ],
)
def test_what_is_no_article_stays_out(extra):
    other = LONG_TEXT.replace("river", "lake")
    got = html.main_text(f"<body><div><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div>{extra.format(other)}</body>")
    assert got == f"{LONG_TEXT} {LONG_TEXT}"
