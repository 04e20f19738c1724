"""Main text of web pages: the best-scoring contiguous run of tokens.

A page is a row of words and tags. Their weights are log odds of lying in the content, learnt from labelled
pages: words by the kind and size of their block, whether they are link text and what the elements around them
are called, tags by name. One linear scan finds the contiguous run with the greatest sum; at a fixed cost each, the run
may pass over stretches that elements around them call something else, which takes adverts and
notices out of the middle of an article.

Only what is never content by itself (scripts, styles, forms, hidden elements) is cut before the scan.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z|(?=<))", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden|aria-label)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "select", "title", "head", "canvas", "audio", "video"}
#: Elements that hold their text as it is up to their own end tag.
_OPAQUE = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose inside is not content wherever they are.
_NEVER = {"form", "button", "fieldset", *_RAW}
#: Elements whose name says what they hold; the names of others (div, p, table) say nothing.
_SECTION = {"nav", "header", "footer", "aside", "menu", "dialog", "article", "main"}
_PARAGRAPH = {"p", "blockquote", "pre"}
_ITEM = {"li", "td", "th", "dt", "dd", "caption"}
_CALLED = {-1: "called something else", 0: "not called", 1: "called content"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_LETTERS = re.compile(r"[a-z]+")


@dataclass
class Token:
    """A piece of text or a tag; outside is true in an element that is never content, called is -1 in an element called something else, 1 in one called content, else 0, place names the block element, link is true in a link, group is the block without regard to line breaks."""

    kind: str
    text: str = ""
    outside: bool = False
    block: int = 0
    place: str = ""
    link: bool = False
    called: int = 0
    group: int = 0


@dataclass
class Weights:
    """Log odds of lying in the content: marks by section name or word of class, id or role, features of tokens."""

    marks: dict[str, float] = field(default_factory=dict)
    features: dict[str, float] = field(default_factory=dict)


def _marks(name: str, attributes: str) -> Iterator[str]:
    """What an element is called: <name> of a section, words of class, id, role and label."""
    if name in _SECTION:
        yield f"<{name}>"
    if name in ("html", "body"):
        return
    for key, value in _ATTRIBUTE.findall(attributes or ""):
        if key.lower() in ("class", "id", "role", "aria-label"):
            yield from _LETTERS.findall(value.lower())


def _standing(name: str, attributes: str, marks: dict[str, float]) -> int:
    """-2 for an element that is never content, -1 for one that is called something else, 1 for one that is called content, else 0."""
    if name in _NEVER:
        return -2
    for key, value in _ATTRIBUTE.findall(attributes or "") if name not in ("html", "body") else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return -2
    total = sum(marks.get(m, 0.0) for m in set(_marks(name, attributes)))
    return (total > 0) - (total < 0)


def tokens(page: str, marks: dict[str, float]) -> Iterator[Token]:
    """Words and tags of a page in order. End tags that match no open element are only marks; open ones end with their parents."""
    stack: list[tuple[str, int]] = []
    at = block = group = links = 0
    inside = {-2: 0, -1: 0, 0: 0, 1: 0}
    lower, place = None, ""
    n = len(page)

    def close() -> str:
        nonlocal links
        gone, was = stack.pop()
        inside[was] -= 1
        links -= gone == "a"
        return gone

    def text(found: str) -> Token:
        return Token("text", found, inside[-2] > 0, block, place, links > 0, -1 if inside[-1] else min(inside[1], 1), group)

    def tag(name: str, attributes: str = "", own: int = 0) -> Token:
        return Token(name, attributes, inside[-2] > 0 or own == -2, block, called=-1 if inside[-1] or own == -1 else 0)

    while at < n:
        cut = page.find("<", at)
        m = None
        end = n if cut < 0 else cut
        if end > at:
            yield text(page[at:end])
        if cut < 0:
            return
        m = _TOKEN.match(page, cut)
        if not m:
            yield text("<")
            at = cut + 1
            continue
        at = m.end() if m.end() > cut else cut + 1
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            block += 1
            group += name != "br"
            place = place if name == "br" else "" if m[1] else name
        if m[1]:
            if any(x[0] == name for x in reversed(stack)):
                while close() != name:
                    pass
            yield tag("/" + name)
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
            # These end an open one of the same kind, unless a list or table lies between.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        close()
                    break
                if stack[k][0] in ("ul", "ol", "table", "dl", "div", "article", "section", "main", "body", "blockquote", "nav", "aside", "footer", "header", "form"):
                    break
        own = _standing(name, m[3], marks)
        yield tag(name, m[3], own)
        if name in _OPAQUE:
            lower = page.lower() if lower is None else lower
            stop = lower.find("</" + name, at)
            at = n if stop < 0 else stop
            if stop >= 0:
                shut = page.find(">", stop)
                at = n if shut < 0 else shut + 1
            continue
        if name in _VOID or m[4] == "/" and name not in _BLOCK:
            continue
        stack.append((name, own))
        inside[own] += 1
        links += name == "a"


def features(toks: list[Token]) -> list[tuple[str, ...]]:
    """What the weight of each token is the sum of: a tag's name; the place and size of words' block, link text or not, and what the elements around are called.

    Words outside of paragraphs count by whether paragraphs hold a fifth of the page's running words.
    """
    size: Counter = Counter()
    running = 0
    for t in toks:
        if t.kind == "text" and not t.outside:
            n = len(t.text.split())
            size[t.group] += n
            if not t.link and t.called >= 0 and t.place not in _HEADING | _ITEM:
                running += 4 * n if t.place in _PARAGRAPH else -n

    def of(t: Token) -> tuple[str, ...]:
        if t.kind != "text":
            return ("<" + t.kind.lstrip("/") + ">",)
        many = "few" if size[t.group] < 5 else "some" if size[t.group] < 12 else "many"
        if t.place in _HEADING:
            place = "heading"
        elif t.place in _PARAGRAPH:
            place = f"{many} in a paragraph"
        else:
            place = f"{many} in {'an item' if t.place in _ITEM else 'other blocks'}{' among paragraphs' if running > 0 else ''}"
        return place, "link" if t.link else "no link", _CALLED[t.called]

    return [of(t) for t in toks]


#: What it costs the best run to pass over a stretch that is called something else, in nats: in the labelled pages
#: the content ends before six such stretches and goes on after three, log(6.5 / 3.5).
PASS_COST = 0.62

#: Labelled pages, written by hand as there are no labels in the table: html with the content between [[ and ]], which may come several times. They have the usual sections, names
#: of boilerplate (one of them an element), and pages without any telling name.
LABELLED = (
    '<html><head><title>a b</title><script>x</script></head><body><nav class="navbar navigation menu"><ul><li><a href="/x">home</a></li><li><a href="/y">news</a></li></ul></nav><div class="ad">buy this now please</div><div class="breadcrumb"><a href="/">home</a></div>'
    '[[<article class="article"><h1>how to bake bread</h1><p>flour water salt and time make a fine loaf of bread</p>]]<div class="advert">the best oven of this year is here at half the price of last year</div><div class="sponsored">a word from those who pay for this page and ask you to read it</div>'
    '[[<p>let it <b>rest</b> for an <a href="/h">hour</a> then bake it until it is brown</p><p>Done.</p></article>]]<div class="related"><a href="/r">more bread</a></div><footer class="foot"><p>&copy; site and all rights reserved</p></footer></body></html>',
    '<body><header class="masthead"><a href="/">logo</a><form><input><button>search</button></form></header><div id="sidebar"><ul><li><a href="/1">one</a></li><li><a href="/2">two</a></li></ul></div><div class="search"><p>find it</p></div><div class="social"><a href="/s">tell a friend</a></div>'
    '[[<div class="content main"><h2>the river in spring</h2><p>the water rises in april and covers the low fields for weeks</p><ul><li>birds come back</li><li>boats go out again when the wind is fair and the days are long</li></ul><blockquote>it was a wet year said the miller</blockquote></div>]]'
    '<div class="share"><p>pass it on</p></div><div class="comments"><p>nice text thanks i have read it twice and shall read it again</p><p>i agree</p></div><div class="respond"><p>say what you think of it</p></div><footer>contact us</footer></body>',
    '<body><div class="cookie consent">we use cookies to improve your visit <button>ok</button></div><div class="banner"><p>big sale today</p></div><div class="topbar"><a href="/l">sign in</a></div><main>[[<h1>a short report</h1><p>the council met on monday and agreed to mend the bridge</p><table><tr><td>cost</td><td>forty</td></tr></table><p>work starts in may</p>]]'
    '<aside class="aside"><h3>related</h3><a href="/a">other story</a><p>what the mayor said last year about the bridge and the road to it</p></aside>[[<p>and it ends in june if all goes well with the weather and the men</p>]]</main><div class="widget"><p>weather today</p></div><div class="legal"><a href="/t">terms</a></div><footer><a href="/t">terms</a> <a href="/p">privacy</a></footer></body>',
    '<body><div class="menubar"><a href="/a">a</a> <a href="/b">b</a></div><div class="notice alert">the site is closed on sunday night for some hours</div><div class="modal popup">sign up and get ten percent off your first order</div><div class="post entry">[[<h1>on walking</h1><p>i walk each day by the sea with an old dog and a stick</p><p>some days it rains and then we walk faster than before</p><pre>two lines of code</pre>]]</div>'
    '<section id="comments"><h3>comments</h3><div class="comment"><p>well said and i shall walk there myself one day soon</p></div><div class="reply"><p>so shall i</p></div></section><div class="newsletter subscribe"><p>join our list and hear from us each week</p><form>join our list <input></form></div><div class="pagination pager"><a href="/2">next</a></div></body>',
    '<body><div class="adverts ads"><p>cheap flights to the sun from ten in the morning</p></div><div class="promo promotion"><p>two for one</p></div><div class="sidebar side"><p>about the author who lives in a small town by a lake</p></div><div class="toc"><a href="#a">part one</a></div><div class="page"><div class="body">[[<h1>Old clocks</h1><p>Clocks.</p><p>a clock that has stopped is right two times a day and wrong for the rest of it</p>]]'
    '<div class="advertisement">new clocks for old ones this week only in our shop</div>[[<p>mend it</p><ol><li>open the case</li><li>clean the wheels</li></ol>]]</div></div><div class="recommended recommendations"><h3>read next</h3><p>a long look at the sun dials of the old town and who made them</p></div><div class="copyright"><p>all rights reserved</p></div></body>',
    '<body><div class="x1"><a href="/a">start</a> <a href="/b">shop</a> <a href="/c">about</a></div><div><ul><li><a href="/1">first page</a></li><li><a href="/2">second page</a></li><li><a href="/3">third page</a></li></ul></div>[[<div class="x2"><h1>the small harbour</h1><p>the harbour is small and holds nine boats when the tide is in and none when it is out</p><p>men mend <a href="/n">nets</a> on the wall</p></div><div><p>in winter it is closed and the boats stand in the street before the houses</p></div>]]'
    '<div><a href="/4">an other harbour</a> <a href="/5">the light house</a></div><div>one two three</div><div><span>tel 123</span></div></body>',
    '<body><table><tr><td><a href="/a">home</a></td><td><a href="/b">links</a></td><td>menu</td></tr></table><table><tr><td>[[<h2>bees</h2>bees fly from march to october and dance to tell the others where to go<br>a hive holds forty thousand of them in a good summer<p>they sleep little</p>]]</td></tr></table><table><tr><td><a href="/c">next</a></td><td>page 3</td><td>hits 100</td></tr></table></body>',
    '<body><div><a href="/">start</a></div><div>a line of an advert in a few words</div><div>[[<h1>tides</h1><p>the tide comes in two times a day and the boats rise with it until they float</p><p>Then it turns.</p><ul><li>at low tide the sand is dry for an hour or more</li><li>walk fast</li></ul><p>nobody who lives here walks out to the island without a table of the tides in the pocket</p>]]</div><div>the tide site of the north coast and its makers, all of it written with care</div></body>',
    '<body><div><ul><li><a href="/m">mills</a></li><li><a href="/d">dams</a></li></ul></div><div>come and see our new shop of lamps and chairs today</div><div>[[<h1>the old mill</h1><p>the mill stands by the weir and its wheel has not turned since the great flood of that winter</p><p>Stones lie in the grass.</p>]]</div><div>mill pages, a site about mills and weirs and the people who keep them</div></body>',
    '<body><div class="skip"><a href="#c">skip</a></div><div class="toolbar"><a href="/p">print</a></div><div class="login signup"><p>log in or sign up</p></div><div class="overlay gdpr"><p>we and our partners keep data on your device to show you what you may like</p></div>[[<div class="story text"><h1>Snow</h1><p>snow fell for two days and shut the road over the pass</p><h2>Trains</h2><p>no train ran</p></div>]]<div class="disqus discussion replies commentlist"><p>we had no snow at all where i live and it was quite warm</p></div><div class="sponsor adsense"><p>tyres for snow and ice</p></div><div class="contentinfo complementary"><p>about us</p></div></body>',
)


def learn(pages: tuple[str, ...] = LABELLED) -> Weights:
    """Weights from labelled pages, half a count added to each.

    Marks are counted by element, which is inside if it touches the content, and those met both in and out say nothing; features
    are counted by word or tag, without what is never content.
    """
    texts = []
    for page in pages:
        parts = re.split(r"\[\[|\]\]", page)
        texts.append(("".join(parts), [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(1, len(parts), 2)]))
    elements: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for text, content in texts:
        open_: list[tuple[str, int, list[str]]] = []
        for m in _TOKEN.finditer(text):
            name = (m[2] or "").lower()
            if not name or name in _VOID:
                continue
            if not m[1]:
                open_.append((name, m.start(), list(_marks(name, m[3]))))
                continue
            while open_:
                last, start, marks = open_.pop()
                elements[any(a < m.end() and start < b for a, b in content)].update(marks)
                if last == name:
                    break
    known = [k for k in {*elements[True], *elements[False]} if not (elements[True][k] and elements[False][k])]
    marks = {k: math.log(elements[True][k] + 0.5) - math.log(elements[False][k] + 0.5) for k in known}
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    total: Counter = Counter()
    for text, content in texts:
        at = 0
        toks = list(tokens(text, marks))
        for t, own in zip(toks, features(toks), strict=True):
            found = t.text if t.kind == "text" else "<" + t.kind
            at = text.lower().index(found.lower(), at)
            inside = any(a <= at < b for a, b in content)
            at += len(found)
            n = len(t.text.split()) if t.kind == "text" else 1
            if not t.outside:
                total[inside, t.kind == "text"] += n
                for k in own:
                    seen[inside][k] += n

    def odds(k: str) -> float:
        share = {y: (seen[y][k] + 0.5) / (total[y, not k.startswith("<")] + 1) for y in (True, False)}
        return math.log(share[True] / share[False])

    return Weights(marks, {k: odds(k) for k in {*seen[True], *seen[False]}})


def score(weights: Weights, t: Token, own: tuple[str, ...]) -> float:
    """Tags are always negative; what is never content weighs nothing."""
    if t.outside:
        return 0.0
    total = sum(weights.features.get(k, 0.0) for k in own)
    return len(t.text.split()) * total if t.kind == "text" else min(total, -0.1)


def best_region(scores: list[float], passable: list[bool], cost: float = PASS_COST) -> tuple[int, int, list[tuple[int, int]]]:
    """(start, end, gaps) of the run whose sum is greatest, where gaps of passable tokens count nothing but ``cost`` each.

    One scan with two sums, of the best run that ends here and of the best one that is in a gap here; (0, 0, []) if no sum is
    positive. Ties go to the run that ends first and then to the one with fewer gaps.
    """
    best: tuple = (0.0, 0, 0, None)
    run: tuple = (0.0, 0, None)
    gap: tuple | None = None
    for i, (s, free) in enumerate(zip(scores, passable, strict=True)):
        before = run
        if run[0] <= 0:
            run = (0.0, i, None)
        if gap is not None and gap[0] > run[0]:
            run = (gap[0], gap[1], (gap[2], gap[3], i))
        run = (run[0] + s, run[1], run[2])
        if not free:
            gap = None
        elif before[0] > cost and (gap is None or before[0] - cost > gap[0]):
            gap = (before[0] - cost, before[1], before[2], i)
        if run[0] > best[0]:
            best = (run[0], run[1], i + 1, run[2])
    gaps, link = [], best[3]
    while link is not None:
        gaps.append((link[1], link[2]))
        link = link[0]
    return best[1], best[2], gaps[::-1]


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the greatest sum and no gaps, (0, 0) if none is positive."""
    return best_region(scores, [False] * len(scores))[:2]


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best run, white space inside a block as one space, blocks joined by one space."""
    toks = list(tokens(page or "", weights.marks))
    chosen = toks
    # Without a tag there is nothing to tell apart.
    if any(t.kind != "text" for t in toks):
        a, b, gaps = best_region([score(weights, t, k) for t, k in zip(toks, features(toks), strict=True)], [t.called < 0 or t.outside or t.kind != "text" or t.text.isspace() for t in toks])
        edges = [a, *[x for g in gaps for x in g], b]
        chosen = [t for i in range(0, len(edges), 2) for t in toks[edges[i] : edges[i + 1]]]
    blocks: list[str] = []
    last, part = None, []
    for t in [*chosen, None]:
        if t is not None and (t.kind != "text" or t.outside):
            continue
        if t is None or t.block != last:
            text = " ".join(html.unescape("".join(part)).split())
            if text:
                blocks.append(text)
            part = []
        if t is not None:
            last = t.block
            part.append(t.text)
    return " ".join(blocks)


def extract_text(pages: DataFrame, html_col: str = "html", labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """``pages`` with text string: the main text of each page, empty if there is none.

    ``labelled`` are the pages that the weights are learnt from, content between [[ and ]]. A null page counts as an empty one; very
    long pages are read once from end to end. Rows are independent: repeated rows give repeated
    results, an empty table none. A column of ``pages`` named text is replaced. Pages go to the tasks
    by Arrow batches and are not shuffled.
    """
    weights = learn(labelled)

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, weights) for x in column], dtype=object)

    udf = F.pandas_udf(run, "string")
    return pages.withColumn("text", udf(F.coalesce(F.col(html_col), F.lit(""))))
