"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First each block is decided on its own: link density, stop-word density and
length make it good or bad, and blocks in navigation, page headers, footers, asides, forms, notices, adverts or comments
are bad. Elements say what they are by tag, role, or the words of a class or id that name a block; an element that only a layout name makes bad
keeps its text where it holds more than half of the page's prose and no article lies outside, and so does a form. Anchors without a target are
no links. Blocks that are short, or lie in an article
and lack stop words, stay open. In the second pass open blocks take the label of their nearest decided neighbours on both sides;
where these differ, an article's block is good, another's takes the nearer one. On a page without any decided block, open blocks are
good. Where no block of a page that could be text reaches the stop-word density, as in a language that the list lacks, its blocks
are decided by length and link density only.

A null page is empty, and its text is the empty string. Unclosed comments, scripts and tags run to the end of the page. Pages of
any length are read whole. Equal distances to a good and a bad neighbour make a block bad. Repeated rows give equal results each;
an empty table gives no rows; columns of pages named text or n_chars give way to the results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with be this by from or at an not have but they which you we his her
    der die das und ist von zu mit den sich nicht auf ein eine dem für des im auch als wird es sie werden
    le la les de des et est un une du que qui dans en pour pas sur au avec par plus ce il elle ne se
    el los las del y que en un una por con para no su lo como más pero sus al es se son""".split()
)
# Names of elements.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas audio video noembed noframes xmp".split())
FOREIGN = frozenset(("svg", "math"))  # only these elements end by a slash
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form menu head dialog select button fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
    disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup
    promo promotion promoted related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription teaser toolbar topbar widget""".split()
)
# Words of names that say where or what shape a block is (the word before them says which), and that say it lacks a part or has one.
SHAPES = frozenset("area articles bar block box boxes btn button buttons col column container content dialog form group holder icons inner item items left links list main outer panel posts right section slot stories top unit wrap wrapper zone".split())
CONDITIONS = frozenset("can has have hide hides is js no non not show shows with without".split())
ALWAYS = frozenset(  # names that no amount of prose overrules: comments, adverts, notices
    """comment comments commentlist disqus reply replies respond ad ads advert adverts advertisement advertising adsbygoogle consent cookie cookies
    gdpr newsletter notice notices notification paywall popup promo promoted promotion sponsor sponsored subscribe subscription""".split()
)
GOOD_TAGS = frozenset(("article", "main"))
OWN_TAGS = frozenset("p h1 h2 h3 h4 h5 h6".split())  # elements of a single block
UNENDED = "a without an end"  # before the next anchor: it ends with its block
SHORT, LONG = 40, 70  # characters
LINKED, STOPPED = 0.4, 0.2  # shares

_tag = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?""")
_attribute = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""").findall
_invisible = re.compile(r"display\s*:\s*none", re.I).search
_next_anchor = re.compile(r"<(/?)a(?=[\s/>])", re.I).search
_names = re.compile("[A-Z]*[a-z]+|[A-Z]+").findall
_words = re.compile(r"[^\W\d_]+").findall


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of open tags, close tags and text, without comments and raw elements."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], ""
        if lt == n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _tag.match(page, lt)
        if not m:
            nxt = page[lt + 1 : lt + 2]
            if nxt.isalpha() and nxt.isascii() or nxt == "/":
                return  # a tag that never ends
            yield "text", "<", ""
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        close, attributes = m[1] or m[4], (m[3] or m[6] or "")
        if not close and name in RAW_TAGS and not (name in FOREIGN and attributes.endswith("/")):
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            yield "raw", name, ""
        elif name == "a" and not close:
            after = _next_anchor(page, at)
            yield "open", "a" if after and after[1] else UNENDED, attributes
        else:
            yield ("close" if close else "open"), name, attributes


def attributes_of(text: str) -> dict[str, str]:
    """By lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _attribute(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_invisible(given.get("style", "")))


def role_of(name: str) -> str:
    """What a class name or id says its block is: its last word that is no shape, before a word that says what it has or lacks; nothing where
    it begins with a condition."""
    parts = [x.lower() for x in _names(name)]
    parts = parts[: next((k for k, x in enumerate(parts) if x in CONDITIONS), len(parts))]
    while len(parts) > 1 and parts[-1] in SHAPES:
        parts.pop()
    return parts[-1] if parts else ""


def bad_element(name: str, attributes: str, in_article: bool) -> str:
    """Why an element's blocks are no main text: "element" (its tag, role, a name in ALWAYS or being hidden), "name" (a layout name, or a form),
    "later name" (a name in ALWAYS after another one that isn't bad); "" if nothing says so."""
    if name in BAD_TAGS and name != "form" or (name == "header" and not in_article):
        return "element"
    why = "name" if name == "form" else ""
    if not attributes or name in ("html", "body", "article", "main"):
        return why
    given = attributes_of(attributes)
    if hidden(given) or given.get("role", "").lower() in BAD_ROLES:
        return "element"
    for key in ("class", "id"):
        before = False  # a name that says something else came first
        for role in map(role_of, given.get(key, "").split()):
            if role in ALWAYS and not before:
                return "element"
            if role in ALWAYS:
                why = "later name"
            elif role in BAD_NAMES and not (role == "header" and in_article):
                why = why or "name"
            else:
                before = True
    return why


class Block:
    """`marks`: numbers of the elements around it that only a name makes bad, negative for a later name. `inside`: number of the element that it
    stands in, its own paragraph or heading aside."""

    __slots__ = ("text", "linked", "bad", "article", "label", "marks", "inside")

    def __init__(self, parts: list[tuple[str, bool]], bad: bool, article: bool, marks: frozenset[int] = frozenset(), inside: int = 0):
        self.text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
        self.linked = sum(len("".join(p.split())) for p, link in parts if link)
        self.bad, self.article, self.label, self.marks, self.inside = bad, article, "", marks, inside

    def prose(self) -> int:
        """Characters, if the block is long and has few links."""
        n = len(self.text)
        return n if n >= LONG and self.linked <= LINKED * n else 0


def blocks(page: str) -> list[Block]:
    stack: list[tuple[str, bool, bool, frozenset[int], int]] = [("", False, False, frozenset(), 0)]  # name, bad, in an article, marks, number
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    link, marked, opened = "", 0, 0

    def cut() -> None:
        nonlocal parts, link
        if parts:
            name, bad, article, marks, number = stack[-1]
            b = Block(parts, bad, article, marks, stack[-2][4] if name in OWN_TAGS else number)
            if b.text:
                out.append(b)
            parts = []
        if link == UNENDED:
            link = ""

    for kind, name, attributes in pieces(page):
        if kind == "text":
            parts.append((name, bool(link)))
        elif kind == "raw":
            if name in BLOCK_TAGS:
                cut()
        elif name in ("a", UNENDED):
            link = name if kind == "open" and "href" in attributes_of(attributes) else ""
        elif name == "br":
            parts.append(("\n", False))
        elif kind == "open":
            block = name in BLOCK_TAGS
            bad = bad_element(name, attributes, stack[-1][2])
            if block or bad:
                cut()
                if block and name not in VOID_TAGS:
                    while stack[-1][0] == "p" or (stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                        stack.pop()
            if name not in VOID_TAGS and (block or bad):
                _, over, article, marks, _ = stack[-1]
                opened += 1
                if bad in ("name", "later name"):
                    marked += 1
                    marks = marks | {marked if bad == "name" else -marked}
                stack.append((name, over or bad == "element", article or name in GOOD_TAGS, marks, opened))
        else:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                cut()
                del stack[depth:]
            elif name in BLOCK_TAGS:
                cut()
    cut()
    return judged_by_name(out)


def judged_by_name(found: list[Block]) -> list[Block]:
    """Elements that only a name makes bad are bad, unless one holds more than half of the page's prose (all of it, if a later name says what
    no prose overrules) and no article lies outside."""
    held: Counter = Counter()
    total = articles = 0
    for b in found:
        if not b.bad and (n := b.prose()):
            total += n
            held.update(dict.fromkeys(b.marks, n))
            articles += n if b.article and not b.marks else 0
    lifted = {m for m, n in held.items() if (2 * n > total if m > 0 else n == total) and not articles}
    for b in found:
        b.bad = b.bad or bool(b.marks - lifted)
    return found


def decide(found: list[Block]) -> list[Block]:
    """Both passes; returns the blocks, labelled."""
    measured = []
    for b in found:
        words = _words(b.text.lower())
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        measured.append((b, len(b.text), density, b.linked / max(1, len(b.text.replace(" ", "")))))
    known = any(density >= STOPPED and n >= SHORT and share <= LINKED and not b.bad for b, n, density, share in measured)
    for b, n, density, share in measured:
        if b.bad or (share > LINKED and not b.article):
            b.label = "bad"
        elif n >= LONG and (density >= STOPPED or not known) and share <= LINKED:
            b.label = "good"
        elif n >= SHORT and density < STOPPED and known and not b.article and n < 4 * LONG:
            b.label = "bad" if density < STOPPED / 2 else ""
    decided = [k for k, b in enumerate(found) if b.label]
    labels = {k: found[k].label for k in decided}
    left, before = [-1] * len(found), -1
    for k in range(len(found)):
        left[k] = before = k if k in labels else before
    right, after = [-1] * len(found), -1
    for k in range(len(found) - 1, -1, -1):
        right[k] = after = k if k in labels else after
    for k, b in enumerate(found):
        if b.label:
            continue
        # What an element makes bad has no say beside a good block that stands in the same element as the open one, or in an article.
        kin = any(x >= 0 and labels[x] == "good" and found[x].inside == b.inside for x in (left[k], right[k]))
        near = [x for x in (left[k], right[k]) if x >= 0 and not ((b.article or kin) and found[x].bad)]
        if not near:
            b.label = "good" if b.article or not any(v == "good" for v in labels.values()) else "bad"
        elif len({labels[x] for x in near}) == 1:
            b.label = labels[near[0]]
        elif b.article:
            b.label = "good"
        else:
            b.label = labels[left[k]] if k - left[k] < right[k] - k else labels[right[k]] if k - left[k] > right[k] - k else "bad"
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in decide(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text and n_chars for every page."""
    keep = tuple(k for k in keep if k not in ("text", "n_chars"))
    rows = pages.select(*keep, F.col("html").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(keep))]
            yield {n: b.column(k) for k, n in enumerate(keep)} | {"text": texts, "n_chars": list(map(len, texts))}

    fields = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep)
    return map_batches(rows, run, f"{fields}, text string, n_chars bigint")
