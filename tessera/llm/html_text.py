"""Main-text extraction with consensus host paths.

1. **Score**: each page is cut into blocks of text, each with the chain of its open elements. Every
   container (an element that holds blocks) gets a score: the characters of its prose blocks, less
   those of links and of short fragments, weighed by its tag and class. A container is named by its
   generalised path: tag and class names from the root, digits masked.
2. **Vote**: in Spark, each page votes for its best container's path; per host the path with the
   largest total wins (partial aggregates, so a host with a third of all pages is no hot task).
3. **Re-extract**: every page is read again with its host's winning path. A page on which that
   path holds no text, or next to nothing beside a long text, uses its own best container.

Boilerplate is left out wherever it stands: navigation, page headers and footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments, told by tag, role, class or id.
A name that is such a word tells it for certain. A name that only contains one (``has-sidebar``), or
that stands beside a promising one, or that also names wrappers (``share``, ``modal``), raises a
doubt, and so does a form: such elements are left out unless on this page they hold the main
element, a promising container of some weight, or most of the prose.

In a block, character references are decoded, white space (with ``<br>``) becomes one blank, ends
are trimmed; blocks are joined in page order by two line feeds.

Defined cases: null and empty html give the empty text; unclosed and stray tags are tolerated; a
page without any container gives what its body holds outside boilerplate; equal pages agree; pages
of any length are read whole, in linear time; an empty table gives no rows; of the other columns
none is read, whatever its name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import stage

#: HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset(
    "nav footer aside script style noscript template iframe svg button select textarea label menu dialog object canvas "
    "head title video audio map".split()
)
#: Elements that are boilerplate unless they wrap the main text: they raise a doubt.
DOUBTFUL = frozenset("form fieldset".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p "
    "form fieldset pre section summary table tbody td tfoot th thead tr ul caption".split()
)
RAW = frozenset("script style textarea title noscript iframe template".split())
CONTAINERS = frozenset("article body center dd details div main section td blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that mark boilerplate.
NEGATIVE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies copyright disqus feedback footer form gdpr masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar "
    "topbar widget widgets".split()
)
#: Negative words that also name wrappers of the main text; alone, they raise a doubt only.
WRAPPING = frozenset(
    "banner feedback form modal notice notices overlay popup promo promoted recommended related respond search share sharing signup skip "
    "social subscribe tags widget widgets".split()
)
#: Words that mark the main text.
POSITIVE = frozenset("article articlebody body content entry entrytext main maincontent post postbody story text prose".split())

OPENING = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:_-]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME_PARTS = re.compile(r"[A-Za-z]+")
DIGITS = re.compile(r"[0-9]+")
#: Elements that an opening tag closes if one is the innermost open block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SHORT = 25
#: Containers in a chain: text deeper down belongs to the last of them (browsers nest as deep).
DEEPEST = 512
#: A page's own best container overrules the host's path if it has so much prose and the path so small a share.
OWN_PROSE, PATH_SHARE = 500, 0.1
#: Shares of a page's prose: a promising container of some weight, and most of it.
WEIGHTY = 0.2
MOST = 0.5
#: The chain of a block outside all containers: the whole page, whose path is empty.
ROOT = ((0, "", False, -1),)


class Block:
    """A run of text between block tags, with the open containers around it."""

    __slots__ = ("text", "links", "chain", "tag", "doubts", "promise", "main")

    def __init__(self, text: str, links: int, chain: tuple, tag: str, doubts: tuple = (), promise: int = -1, main: int = -1):
        self.text, self.links, self.chain, self.tag = text, links, chain, tag
        # (depth, names) of the doubtful elements around; depth of the innermost promising one that is not doubtful, and of main
        self.doubts, self.promise, self.main = doubts, promise, main

    @property
    def prose(self) -> int:
        return max(0, len(self.text) - 2 * self.links)


def _label(tag: str, attributes: str) -> tuple[str, bool, bool, tuple[str, ...]]:
    """(generalised name, boilerplate, promising, doubtful names) of an element."""
    names, bad = [], tag in SKIP
    good = tag in ("article", "main")
    exact, doubts = False, []
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                bad = True
            elif key == "style":
                bad = bad or "display:none" in value.lower().replace(" ", "")
            elif key in ("class", "id", "role"):
                for token in value.split():
                    words = {w.lower() for w in NAME_PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))}
                    good = good or not POSITIVE.isdisjoint(words) or key == "role" and token == "main"
                    # body and html carry page-wide state in their classes
                    if tag not in ("body", "html", "article", "main") and not NEGATIVE.isdisjoint(words):
                        whole = token.lower().strip("0123456789-_")
                        exact = exact or whole in NEGATIVE and whole not in WRAPPING
                        doubts.append(DIGITS.sub("0", token).lower())
                if key == "class":
                    names = sorted(DIGITS.sub("0", t).lower() for t in value.split())
    return ".".join([tag, *names]), bad or exact and not good, good, tuple(doubts)


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of the tags in order; comments and declarations have no name.

    A quote counts only behind ``=``; one that is never closed does not hide the tag's end. What was
    once searched for in vain is not searched for again, so any markup is read in linear time."""
    missing: set[str] = set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        i = html.find(what, start)
        if i < 0:
            missing.add(what)
        return i

    at = 0
    while (start := find("<", at)) >= 0:
        follow = html[start + 1 : start + 2]
        if follow and follow in "!?":
            if html.startswith("<!--", start):
                end = find("-->", start + 4)
                at = end + 3 if end >= 0 else len(html)
            else:
                end = find(">", start)
                at = end + 1 if end >= 0 else start + 1
                if end < 0:
                    continue
            yield start, at, False, "", ""
            continue
        m = OPENING.match(html, start)
        if m is None:
            at = start + 1
            continue
        if find(">", m.end()) < 0:
            return
        k = m.end()
        while True:
            stop = STOP.search(html, k)
            if stop is None:
                end = find(">", m.end())
                break
            if stop[0] == ">":
                end = stop.start()
                break
            behind = stop.start() - 1
            while behind > m.end() and html[behind].isspace():
                behind -= 1
            if html[behind] != "=":
                k = stop.end()
                continue
            closed = find(stop[0], stop.end())
            if closed < 0:  # a quote that is never closed
                end = find(">", m.end())
                break
            k = closed + 1
        at = end + 1
        yield start, at, bool(m[1]), m[2].lower(), html[m.end() : end]


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page outside boilerplate, in order.

    A block's chain holds, from the root, (element number, path, promising) of its containers.
    """
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, tuple, str, tuple, int, int]] = []  # (tag, boilerplate, chain, path, doubts, promise, main)
    opened: Counter[str] = Counter()
    text: list[str] = []
    links = 0
    number = 0
    skipping = 0
    in_link = 0
    within = 0  # promising containers open: a header there belongs to the article

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                top = stack[-1] if stack else ("", False, ROOT, "", (), -1, -1)
                out.append(Block(joined, links, top[2], top[0], *top[4:]))
            text.clear()
        links = 0

    def pop() -> None:
        nonlocal skipping, in_link, within
        tag, bad, chain, *_ = stack.pop()
        opened[tag] -= 1
        skipping -= bad
        in_link -= tag == "a"
        if tag in CONTAINERS and chain and chain[-1][2] and chain[-1][3] == len(stack):
            within -= 1

    def add(piece: str) -> None:
        nonlocal links
        if piece and not skipping:
            text.append(piece)
            if in_link:
                links += len(piece)

    at, n = 0, len(html)
    for start, end, closing, tag, attributes in tags(html):
        if start < at:  # inside a script or the like
            continue
        add(html[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if opened[tag]:
                if tag in BLOCK or tag in SKIP:
                    flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            add(" ")
            continue
        block = tag in BLOCK
        if block or tag in SKIP:
            flush()
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table") or stack[k][0] in CONTAINERS - {"td", "dd"}:
                    break
        elif block and (opened["p"] or tag in HEADINGS and any(opened[x] for x in HEADINGS)):  # a block ends an open paragraph and what is open inside it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in HEADINGS and tag in HEADINGS:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in VOID or attributes.endswith("/"):
            if tag == "hr":
                flush()
            continue
        name, bad, good, doubtful = _label(tag, attributes)
        if tag == "header" and not within:
            bad = True
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        chain, path, doubts, promise, main = stack[-1][2:] if stack else (ROOT, "", (), -1, -1)
        if tag in CONTAINERS and len(chain) < DEEPEST:
            number += 1
            path = f"{path}/{name}" if path else name
            chain = (*chain, (number, path, good, len(stack)))
            within += good
        if tag in DOUBTFUL:
            doubtful = (*doubtful, f"{name}@{len(stack)}")
        if doubtful and len(doubts) < DEEPEST:
            doubts = (*doubts, (len(stack), doubtful))
        elif good and tag in CONTAINERS and tag not in ("html", "body"):
            promise = len(stack)
        if tag == "main":
            main = len(stack)
        stack.append((tag, bad, chain, path, doubts, promise, main))
        opened[tag] += 1
        skipping += bad
        in_link += tag == "a"
    add(html[at:])
    flush()
    return _settled(out)


def _settled(page: list[Block]) -> list[Block]:
    """The blocks without those of doubtful elements that the page's prose speaks against."""
    if not any(b.doubts for b in page):
        return page
    total = promised = 0
    held: dict[str, int] = defaultdict(int)  # prose in elements of a doubtful name
    inner: dict[str, int] = defaultdict(int)  # of it, in promising containers inside them
    taken: dict[str, int] = defaultdict(int)  # of it, in promising containers anywhere
    kept: set[str] = set()
    for b in page:
        prose = b.prose
        total += prose
        promised += prose if b.promise >= 0 else 0
        for name in {n for _, names in b.doubts for n in names}:
            held[name] += prose
            taken[name] += prose if b.promise >= 0 else 0
            if any(b.promise > depth for depth, names in b.doubts if name in names):
                inner[name] += prose
        for depth, names in b.doubts:
            if b.main > depth:
                kept.update(names)
    for name, prose in held.items():
        if inner[name] > WEIGHTY * total or prose >= MOST * total and promised - taken[name] < WEIGHTY * total:
            kept.add(name)
    out = [b for b in page if all(not kept.isdisjoint(names) for _, names in b.doubts)]
    return out or page


def scores(page: list[Block]) -> dict[str, float]:
    """Generalised path -> score, the best container of that path."""
    own: dict[int, float] = defaultdict(float)
    path_of: dict[int, tuple[str, bool]] = {}
    for b in page:
        size = len(b.text)
        prose = b.prose
        worth = prose if size >= SHORT or b.tag in HEADINGS or b.tag == "p" else prose * 0.3
        worth -= 0.5 * min(size, b.links)
        for number, path, good, _ in b.chain:
            own[number] += worth
            path_of[number] = (path, good)
    out: dict[str, float] = {}
    for number, worth in own.items():
        path, good = path_of[number]
        outer = path == "" or path.rpartition("/")[2].startswith("body")
        value = worth * (1.5 if good else 1.0) * (0.8 if outer else 1.0) + 1e-3 * path.count("/")
        out[path] = max(out.get(path, float("-inf")), value)
    return out


def best_path(page: list[Block]) -> tuple[str | None, float]:
    """The page's best path: the deepest container that holds nearly all of the best score."""
    ranked = scores(page)
    if not ranked:
        return None, 0.0  # no text at all
    path = max(sorted(ranked), key=lambda p: ranked[p])
    return path, max(ranked[path], 0.0)


def text_at(page: list[Block], path: str | None) -> str:
    """The blocks inside containers of ``path``, joined."""
    return "\n\n".join(b.text for b in page if any(c[1] == path for c in b.chain))


def extract_page(html: str | None, path: str | None) -> str:
    """Main text by the host's path, or by the page's own best container."""
    page = blocks(html)
    own, _ = best_path(page)
    if path is None or path == own:
        return text_at(page, own)
    prose = {p: sum(b.prose for b in page if any(c[1] == p for c in b.chain)) for p in (path, own)}
    if prose[own] >= OWN_PROSE and prose[path] < PATH_SHARE * prose[own]:
        return text_at(page, own)
    return text_at(page, path) or text_at(page, own)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that wins the vote of each host's pages; written."""

    @F.pandas_udf("struct<path:string,score:double>")
    def vote(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_path(blocks(h)) for h in html], columns=["path", "score"])

    votes = pages.select(host(F.col("url")).alias("host"), vote("html").alias("v")).filter("v.path is not null")
    total = votes.groupBy("host", F.col("v.path").alias("path")).agg(F.count("*").alias("pages"), F.sum(F.log1p("v.score")).alias("score"))
    best = total.groupBy("host").agg(F.max(F.struct("pages", "score", "path")).alias("best"))
    return stage(best.select("host", "best.path"), "host-paths")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    @F.pandas_udf("string")
    def extract(html: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([extract_page(h, p if isinstance(p, str) else None) for h, p in zip(html, path)], dtype=object)

    keyed = pages.select("page_id", "url", F.col("html"), host(F.col("url")).alias("host"))
    joined = keyed.join(host_paths(pages), "host", "left")
    out = joined.select("page_id", "url", extract("html", "path").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
