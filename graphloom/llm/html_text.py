"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides each block by
its length, link density and share of stop words, after dropping what stands
in menus, forms, scripts and the like. Pass two gives blocks that are too
short or too poor in stop words to decide the label of their nearest decided
neighbours.

Marks and names are weighed by the text that they hold, never trusted alone:

* an ``article`` counts if no more running text stands outside all articles than
  in it; then it is taken whole, together with others at least half as large,
  but without articles within it. Else articles are teasers or comments, and drop.
* an element whose names speak against it stays if it holds most of the long
  text; one named for comments or consent only if there is no text beside it.
* ``main`` limits the page if it holds most of the running text.

Where the stop words of a page's language are not known, length and links alone
decide, and a page without any decided block keeps what is not linked. The
scanner reads a page once, from left to right, whatever its nesting.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.batches import as_bytes, map_batches, without

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for was on are as with be at by this from or an which
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    le la les de des et en un une du dans est que qui pour par sur au avec ce il ne pas plus
    el los las y en un una por con del se para como al su lo más no
    """.split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SKIPPED_TAGS = frozenset("nav footer aside form head menu dialog button select".split())
RAW_TAGS = frozenset("script style textarea noscript template iframe svg math object audio video canvas noembed noframes title".split())
#: Those that hold text or nothing to the end of the page if they are not closed; the others are then passed over.
TO_THE_END = frozenset("script style textarea title iframe noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Names in class, id or role that mark what is not part of an article, alone or with each other and with PLACES.
NOISE = frozenset(
    """
    ad ads adv advert advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert
    newsletter subscribe subscription popup modal overlay dialog sidebar aside complementary widget related recommended recommendations share sharing social
    card teaser preview menu nav navbar navigation breadcrumb breadcrumbs masthead footer contentinfo copyright comment comments disqus respond reply replies login signup signin search pagination pager toolbar skip
    """.split()
)
#: Words that only say where or how large a named part is.
PLACES = frozenset("area bar bottom box button buttons container form global header icons inner item items left link links list main outer panel post posts right section site text top wrap wrapper".split())
#: Parts that may outgrow the article they stand beside; these never count as the article.
BESIDE = frozenset("cookie cookies consent gdpr comment comments disqus respond reply replies".split())
ITEM_TAGS = frozenset("p li td th tr dt dd option".split())
LINKED, SHORT, LONG, SOME_STOPS, MANY_STOPS, KNOWN_STOPS = 0.33, 70, 200, 0.15, 0.25, 0.2
GOOD, BAD, OPEN = 1, 0, -1
KEPT, DOUBTED, DROPPED = 0, 1, 2

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))?)?")
_WORDS = re.compile(r"[^\W\d_]+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}


class _Scanner:
    """Finds the ends of tags and raw elements; what is not found once is not looked for again, so all searches together read a page a few times at most."""

    def __init__(self, html: str) -> None:
        self.html, self.quoted, self.missing = html, True, set()

    def end_of_tag(self, at: int) -> int:
        """Behind the > that ends the tag; one in a quoted value does not, unless the page's quotes do not match."""
        pos = at
        while self.quoted and (m := _STOP.search(self.html, pos)):
            if m[0] == ">":
                return m.end()
            close = self.html.find(m[0], m.end())
            if close < 0:
                break
            pos = close + 1
        self.quoted = False
        end = self.html.find(">", at)
        return end + 1 if end >= 0 else len(self.html)

    def end_of_raw(self, tag: str, at: int) -> int:
        """Where the end tag of an element without markup begins; at the end of the page or where it began if there is none."""
        found = None if tag in self.missing else _RAW_ENDS[tag].search(self.html, at)
        if found:
            return found.start()
        self.missing.add(tag)
        return len(self.html) if tag in TO_THE_END else at


class _Block:
    __slots__ = ("article", "doubt", "heading", "linked", "main", "noise", "parts")

    def __init__(self, noise: bool, doubt: int, article: int, main: bool, heading: bool) -> None:
        self.parts, self.linked, self.noise, self.doubt, self.article, self.main, self.heading = [], 0, noise, doubt, article, main, heading


class _Page:
    """Blocks in page order. Doubted elements and articles are numbered from 1: ``around`` has for each doubted one the one around it (0 is none), ``beside`` those named for comments or consent, ``within`` for each article the one around it."""

    def __init__(self) -> None:
        self.blocks, self.around, self.beside, self.within = [], [0], {0: False}, [0]


def _verdict(tag: str, attributes: str, within: bool) -> tuple[int, bool, bool, bool]:
    """(verdict, beside, article, main): whether an element is kept, dropped, or dropped unless what it holds says otherwise."""
    article, main = tag == "article", tag == "main"
    if tag == "form":
        return DOUBTED, False, False, False
    if tag in SKIPPED_TAGS or tag == "header" and not within:
        return DROPPED, False, False, False
    if "=" not in attributes and "hidden" not in attributes.lower():
        return KEPT, False, article, main
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), values[0] or values[1] or values[2])
    article, main = article or found.get("itemprop", "").lower() == "articlebody", main or found.get("role", "").lower() == "main"
    if tag in ("html", "body"):
        return KEPT, False, article, main
    if found.get("aria-hidden", "").lower() == "true" or "hidden" in found or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return DROPPED, False, article, main
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower().split()
    named = [words for name in names if not NOISE.isdisjoint(words := set(re.split(r"[^a-z0-9]+", name)) - {""}) and words <= NOISE | PLACES]
    if main or not named or found.get("itemprop", "").lower() == "articlebody":
        return KEPT, False, article, main
    return DOUBTED, any(not BESIDE.isdisjoint(words) for words in named), article, main


def blocks_of(html: str) -> _Page:
    page, scan = _Page(), _Scanner(html)
    stack: list[tuple] = []  # open elements that matter: tag, verdict, doubted element around it, article around it, opens main
    count: dict[str, int] = {}
    noise = doubt = article = main = 0
    links, breaks, heading, at = 0, 0, False, 0
    block = _Block(False, 0, 0, False, False)

    def new() -> _Block:
        if block.parts:
            page.blocks.append(block)
        return _Block(noise > 0, doubt, article, main > 0, heading)

    def text(s: str) -> None:
        nonlocal breaks
        if s:
            block.parts.append(s)
            if links:
                block.linked += len(s.strip())
            if not s.isspace():
                breaks = 0

    def pop() -> None:
        nonlocal noise, doubt, article, main
        tag, verdict, doubt, article, opens_main = stack.pop()
        count[tag] -= 1
        noise -= verdict == DROPPED
        main -= opens_main

    while m := _OPEN.search(html, at):
        text(html[at : m.start()])
        name = _NAME.match(html, m.end())
        if name is None:  # a comment, a declaration, or an end tag without a name
            if html.startswith("!--", m.end()):
                end = html.find("-->", m.end() + 3)
                at = end + 3 if end >= 0 else len(html)
            else:
                end = html.find(">", m.end())
                at = end + 1 if end >= 0 else len(html)
            continue
        at = scan.end_of_tag(name.end())
        tag, close, attributes = name[0].lstrip("/").lower(), name[0][0] == "/", html[name.end() : at]
        if tag in RAW_TAGS:
            if not close and not attributes.endswith("/>"):  # what it holds is no markup
                at = scan.end_of_raw(tag, at)
            continue
        if tag == "a":
            links = 0 if close else 1
            continue
        if tag == "br":
            breaks += 1
            block.parts.append(" ")
            if breaks == 2:
                block = new()
            continue
        if close:
            if tag not in BLOCK_TAGS and not count.get(tag):
                continue
            links = 0 if tag in BLOCK_TAGS else links
            if count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            heading, block = False, new()
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                links, block = 0, new()
            continue
        verdict, beside, marks, opens_main = _verdict(tag, attributes, article > 0 or main > 0)
        if tag not in BLOCK_TAGS and not verdict and not marks and not opens_main:
            continue
        links = 0 if tag in BLOCK_TAGS else links
        if tag in ITEM_TAGS and stack and stack[-1][0] == tag:
            pop()  # an unclosed one ends where its sibling begins
        if tag not in ITEM_TAGS or verdict or marks or opens_main:
            stack.append((tag, verdict, doubt, article, opens_main))
            count[tag] = count.get(tag, 0) + 1
            noise += verdict == DROPPED
            main += opens_main
            if verdict == DOUBTED:
                page.around.append(doubt)
                doubt = len(page.around) - 1
                page.beside[doubt] = beside
            if marks:
                page.within.append(article)
                article = len(page.within) - 1
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        block = new()
    text(html[at:])
    new()
    return page


def _running(text: str, linked: int) -> bool:
    return linked <= LINKED * len(text)


def _without_noise(found: list[tuple], page: _Page) -> list[tuple]:
    """Blocks outside doubted elements, but for those that hold more than half of the long text; one for comments or consent needs all of the text."""
    around = page.around
    long, any_ = [0] * len(around), [0] * len(around)
    for text, linked, _, _, doubt, _ in found:
        if _running(text, linked):
            any_[doubt] += len(text)
            long[doubt] += len(text) if len(text) >= LONG else 0
    total_long, total = sum(long), sum(any_)
    for d in range(len(around) - 1, 0, -1):  # an element comes after the one around it
        long[around[d]] += long[d]
        any_[around[d]] += any_[d]
    drop = [False] * len(around)
    for d in range(1, len(around)):
        drop[d] = drop[around[d]] or (total - any_[d] >= SHORT if page.beside[d] else 2 * long[d] <= total_long)
    return [x for x in found if not drop[x[4]]]


def _in_scope(found: list[tuple], within: list[int]) -> tuple[list[tuple], bool]:
    """The blocks of the main part and of the articles that count, and whether articles do."""
    mass = lambda blocks: sum(len(x[0]) for x in blocks if _running(x[0], x[1]))
    main = [x for x in found if x[5]]
    if 2 * mass(main) > mass(found):
        found = main
    own = [0] * len(within)
    for x in found:
        own[x[2]] += len(x[0]) if _running(x[0], x[1]) else 0
    rest = sum(len(x[0]) for x in found if not x[2] and len(x[0]) >= SHORT and _running(x[0], x[1]))
    most = max(own[1:], default=0)
    if not most or rest > most:
        return ([x for x in found if not x[2]] if rest else found), False
    keep = [False] * len(within)
    for a in range(1, len(within)):  # one within a kept one is no part of it
        up = within[a]
        while up and not keep[up]:
            up = within[up]
        keep[a] = 2 * own[a] >= most and not up
    return [x for x in found if keep[x[2]]], True


def _knows_language(found: list[tuple]) -> bool:
    """Whether the page's running text has the stop words that its language would have if they were listed."""
    words = [w for x in found if len(x[0]) >= SHORT and x[1] <= LINKED * len(x[0]) for w in _WORDS.findall(x[0].lower())]
    return bool(words) and sum(map(STOP_WORDS.__contains__, words)) >= KNOWN_STOPS * len(words)


def _label(text: str, linked: int, known: bool) -> int:
    """Pass one."""
    if not _running(text, linked):
        return BAD
    if len(text) < LONG and "©" in text or len(text) < SHORT and "copyright" in text.lower():
        return BAD
    if len(text) < SHORT:
        return BAD if linked else OPEN
    if not known:
        return GOOD if len(text) >= LONG or not linked else OPEN
    words = _WORDS.findall(text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
    if stops >= (SOME_STOPS if len(text) >= LONG else MANY_STOPS):
        return GOOD
    return OPEN if stops >= SOME_STOPS or not linked else BAD


def main_text(html: str) -> str:
    page, found = blocks_of(html), []
    for b in page.blocks:
        if not b.noise:
            raw = "".join(b.parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                found.append((text, b.linked, b.article, b.heading, b.doubt, b.main))
    found, marked = _in_scope(_without_noise(found, page), page.within)
    if marked:
        return "\n\n".join(x[0] for x in found)
    known = _knows_language(found)
    labels = [_label(*x[:2], known) for x in found]
    # pass two: the nearest decided block on either side, the page's edge being bad unless nothing is decided as good
    edge = BAD if GOOD in labels or not any(map(str.isalnum, "".join(x[0] for x in found))) else GOOD
    before, last = [], (None, edge)
    for i, label in enumerate(labels):
        before.append(last)
        if label != OPEN:
            last = (i, label)
    keep, after = [False] * len(labels), (None, edge)
    for i in range(len(labels) - 1, -1, -1):
        if labels[i] != OPEN:
            keep[i] = labels[i] == GOOD
            after = (i, labels[i])
            continue
        (p, left), (n, right) = before[i], after
        if edge == GOOD or found[i][3] and n is not None and right == GOOD:  # a heading goes with what it stands over
            keep[i] = True
        elif left == right:
            keep[i] = left == GOOD
        elif p is None or n is None:
            keep[i] = (right if p is None else left) == GOOD and len(found[i][0]) >= SHORT // 2
        else:
            keep[i] = (left if i - p < n - i or i - p == n - i and left == GOOD else right) == GOOD
    return "\n\n".join(x[0] for x, k in zip(found, keep, strict=True) if k)


def html_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    r"""Replace the column ``html_col`` by ``text`` and ``n_chars``, its code points.

    Whole pages are read, whatever their length; null and empty pages and pages
    without an article give "". Character references are decoded, white space
    within a block becomes one space, blocks are joined by two \n in page
    order. A script, style or title that is not closed takes the rest of the
    page with it, as in browsers; other elements that are not closed do not. Other columns pass through, those named text or n_chars are
    replaced; repeated rows stay; an empty table gives an empty table.
    """
    kept = without(pages, *{"text", "n_chars"} - {html_col})
    at = kept.columns.index(html_col)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x.decode()) for x in as_bytes(batch.column(at))]
            others = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if i != at]
            return pa.record_batch([*(c for _, c in others), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*(n for n, _ in others), "text", "n_chars"])

        return each

    fields = [T.StructField(f.name, f.dataType) for f in kept.schema if f.name != html_col]
    return map_batches(kept, make, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
