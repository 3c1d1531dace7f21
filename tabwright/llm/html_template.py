"""Main text of web pages: site templates are found by hashing element subtrees and counting them per host.

1. Every page is cut into elements; a subtree's hash covers its tag, its text and its children's hashes.
2. Spark counts, for every host, the distinct articles (pages without a marked article: whole texts) whose page holds
   a subtree, so that one article under several addresses counts once. A subtree with at least ``MIN_PAGES`` of them
   is the site's template, however many pages the host has. Beyond ``BROADCAST_TEMPLATES`` they stay a table, with
   which each page's subtrees are joined by (host, subtree), so their number has no bound.
3. A page's text is that of its article without template subtrees and without elements whose tag, role, class or
   id says that they are menus, headers, footers, sidebars, notices, adverts, forms, scripts or reader comments
   (a host with one page shows no template, so those names are needed as well).

Inside an article only boxes (``div``, ``ul`` and the like) can be template: a paragraph, table, figure or formula
that many articles of a host share is text, and so is a box around one. There a name must say nothing but the part
(``notice`` or ``notice-box``, not ``notice-board``), and a section's id must not be one that chapters have as well
(``discussion``, ``search``). Headings, phrases and list items are never judged by their names.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PAGES = 4
BROADCAST_TEMPLATES = 200_000  # template subtrees that may be broadcast; more are joined by a shuffle

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe noembed noframes xmp svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
# MathML element names; a formula reads on without spaces.
MATH = frozenset("math annotation maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms "
                 "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
DROPPED = frozenset("head nav footer aside form button dialog menu object canvas audio video map fieldset".split())
BOXES = frozenset("div section ul ol dl table form figure nav header footer aside center details".split())
CONTENT = frozenset("table figure dl details pre math".split())
UNNAMED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd tr td th pre blockquote figure figcaption html body".split()) | INLINE | MATH
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
               "th": ("tr", "table"), "option": ("select",)}
# Words in class, id and role that name a part which is not the article.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs topbar toolbar masthead pagination pager "
    "sidebar aside rail widget widgets complementary contentinfo footer foot colophon "
    "cookie cookies consent gdpr notice notices alert notification popup modal overlay paywall newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations trending "
    "comment comments commentlist disqus respond reply replies discussion search".split())
TOP_PARTS = frozenset("header head".split())
# Words that a part's name may hold beside those, and parts after which chapters of an article are named too.
FILLERS = frozenset("area articles bar block body box btn button buttons card cell col column container content div el form "
                    "group holder icons inline inner item items left link links list main module outer page panel posts "
                    "right section site slot small stories strip text the top unit view wrap wrapper zone".split())
CHAPTERS = frozenset("alert banner discussion foot footnotes menu navigation notice notices notification promotion rail "
                     "recommendations recommended related replies reply respond search share sharing social subscription "
                     "trending".split())
# Parts in which an article element is a comment or a teaser, never the page's article.
ASIDES = frozenset("nav footer aside dialog menu".split())
ASIDE_PARTS = frozenset("comment comments commentlist disqus respond replies related recommended recommendations "
                        "trending widget widgets".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)"
                    r"((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>?", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

ARTICLE, MAIN, PART, TOP, ASIDE, LOOSE, HOLDS_CONTENT = 1, 2, 4, 8, 16, 32, 64


def _name_flags(tag: str, attributes: str) -> int:
    """What class, id and role say of an element: PART (its names say so and nothing else), LOOSE (a word of a name
    says so), TOP, ASIDE, MAIN."""
    flags = 0
    if tag in UNNAMED:
        return flags
    for n in _NAMED.finditer(attributes):
        kind, value = n[1].lower(), n[2] or n[3] or n[4] or ""
        words = {w.lower() for w in _WORD.findall(value)}
        if words & PARTS:
            flags |= LOOSE
            for name in value.split():
                said = {w.lower() for w in _WORD.findall(name)}
                named = said & PARTS
                if kind == "id" and tag == "section":
                    named -= CHAPTERS
                if named and said <= PARTS | FILLERS:
                    flags |= PART
        if words & ASIDE_PARTS:
            flags |= ASIDE
        if words & TOP_PARTS:
            flags |= TOP
        if kind == "role" and words == {"main"}:
            flags |= MAIN
    return flags


class Page:
    """A page as text segments in order and elements over them.

    ``elements`` holds [tag, flags, first segment, end segment, hash, whether an article or main is inside,
    whether it is inside one]. Work grows with the page's length, however deep its elements are or whatever is left open.
    """

    def __init__(self, html: str | None):
        self.segments: list[str] = []
        self.elements: list[list] = []
        self._read(html or "")

    def _read(self, html: str) -> None:
        import xxhash
        segments, elements = self.segments, self.elements
        stack: list[tuple[str, int, list[str]]] = []  # tag, element (or -1), parts of the hash
        places: dict[str, list[int]] = {}  # where in the stack a tag is open
        blocks: list[int] = []  # where elements are open that aren't phrases
        inner: list[str] = []
        pos, size, depth, asides = 0, len(html), 0, 0

        def push(tag: str, at: int, parts: list[str]):
            places.setdefault(tag, []).append(len(stack))
            if tag not in INLINE and tag not in MATH:
                blocks.append(len(stack))
            stack.append((tag, at, parts))

        def close():
            nonlocal depth, asides
            tag, at, parts = stack.pop()
            places[tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            if at < 0:
                return
            e = elements[at]
            e[3] = len(segments)
            e[4] = xxhash.xxh64_intdigest(f"{tag}\x1e{chr(31).join(parts)}".encode("utf-8", "surrogatepass")) >> 1
            if e[1] & (ARTICLE | MAIN):
                depth -= 1
            if e[1] & ASIDE:
                asides -= 1
            above = opened[at]
            if above >= 0:
                elements[above][5] = elements[above][5] or e[5] or bool(e[1] & (ARTICLE | MAIN))
                if tag in CONTENT or e[1] & HOLDS_CONTENT:
                    elements[above][1] |= HOLDS_CONTENT
            (stack[-1][2] if stack else inner).append(str(e[4]))
            if tag not in INLINE and tag not in MATH:
                segments.append(" ")

        def text(raw: str):
            if raw:
                raw = unescape(raw) if "&" in raw else raw
                segments.append(raw)
                short = " ".join(raw.split())
                if short:
                    (stack[-1][2] if stack else inner).append(short)

        opened: list[int] = []  # of every element, the element around it (or -1)
        around: list[int] = []  # of every open place, the innermost element there
        while pos < size:
            m = _TOKEN.search(html, pos)
            if m is None:
                text(html[pos:])
                break
            if m.start() > pos:
                text(html[pos:m.start()])
            pos = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:  # an end tag closes up to its element, if that is open
                if places.get(tag):
                    down = places[tag][-1]
                    while len(stack) > down:
                        close()
                        around.pop()
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(html, pos)
                    pos = end.end() if end else size
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    segments.append(" ")
                continue
            down = len(stack)
            if tag in CLOSES_P:  # an open paragraph with nothing but phrases in it ends here
                if places.get("p") and blocks[-1] == places["p"][-1]:
                    down = blocks[-1]
            elif tag in CLOSES_SAME and places.get(tag):
                if all(not places.get(t) or places[t][-1] < places[tag][-1] for t in CLOSES_SAME[tag]):
                    down = places[tag][-1]
            while len(stack) > down:
                close()
                around.pop()
            if tag in INLINE and tag != "span" and "=" not in m[3]:
                push(tag, -1, stack[-1][2] if stack else inner)
                around.append(around[-1] if around else -1)
                continue
            flags = TOP if tag == "header" else PART if tag in DROPPED else 0
            flags |= ASIDE if tag in ASIDES else 0
            if "=" in m[3]:
                flags |= _name_flags(tag, m[3])
            if tag in ("article", "main"):
                part = flags & (PART | LOOSE) if tag == "article" else 0
                flags = (PART if part else 0) | (ARTICLE if tag == "article" else MAIN)
            if flags & (ARTICLE | MAIN) and (flags & (PART | LOOSE) or asides):
                flags &= PART  # a reader's comment or a teaser marked up as an article
            if tag not in INLINE and tag not in MATH:
                segments.append(" ")
            push(tag, len(elements), [])
            opened.append(around[-1] if around else -1)
            around.append(len(elements))
            elements.append([tag, flags, len(segments), 0, 0, False, depth > 0])
            if flags & (ARTICLE | MAIN):
                depth += 1
            if flags & ASIDE:
                asides += 1
        while stack:
            close()

    def _whole(self) -> bool:
        """Whether no article or main is marked, so that the body is the article."""
        return not any(e[1] & (ARTICLE | MAIN) for e in self.elements)

    def _may_be_template(self, e: list, whole: bool) -> bool:
        tag, flags, _, _, _, holds, inside = e
        if holds or tag in INLINE or tag in MATH or tag in ("html", "body") or flags & (ARTICLE | MAIN):
            return False
        if inside:
            return tag in BOXES and tag not in CONTENT and not flags & HOLDS_CONTENT
        return whole or tag in BOXES

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that may be template: boxes, and outside an article every block with text."""
        whole, filled = self._whole(), [0]
        for s in self.segments:
            filled.append(filled[-1] + (not s.isspace()))
        return {e[4] for e in self.elements if filled[e[3]] > filled[e[2]] and self._may_be_template(e, whole)}

    def _spans(self, elements: list[list]) -> list[bool]:
        """Which segments lie in any of the elements."""
        change = [0] * (len(self.segments) + 1)
        for e in elements:
            change[e[2]] += 1
            change[e[3]] -= 1
        out, now = [], 0
        for c in change[:-1]:
            now += c
            out.append(now > 0)
        return out

    def _article(self) -> list[bool]:
        """Which segments are the article's, parts of other kinds in it included."""
        if self._whole():
            return [True] * len(self.segments)
        articles = [e for e in self.elements if e[1] & ARTICLE]
        return self._spans([e for e in self.elements if e[1] & (ARTICLE if articles else MAIN)])

    def article_hash(self) -> int:
        """Stands for the article's text, whatever is around it on the page."""
        import xxhash
        text = " ".join("".join(s for s, c in zip(self.segments, self._article(), strict=True) if c).split())
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1

    def text(self, templates) -> str:
        """Text of the article without template subtrees and parts that are named as something else."""
        whole, out = self._whole(), []
        for e in self.elements:
            tag, flags, _, _, h, holds, inside = e
            if holds or tag in ("html", "body") or flags & (ARTICLE | MAIN):
                continue
            if flags & PART or not inside and flags & (TOP | LOOSE) or h in templates and self._may_be_template(e, whole):
                out.append(e)
        return " ".join("".join(s for s, c, g in zip(self.segments, self._article(), self._spans(out), strict=True)
                                if c and not g).split())


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port (null where there is none)."""
    h = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(h != "", h)


def _subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, article, subtrees) of ``pages`` (url, html): hashes of the html and of the article's text."""
    @F.pandas_udf("article long, subtrees array<long>")
    def read(html: pd.Series) -> pd.DataFrame:
        found = [Page(h) for h in html]
        return pd.DataFrame({"article": pd.Series([p.article_hash() for p in found], dtype="int64"),
                             "subtrees": pd.Series([sorted(p.subtrees()) for p in found], dtype=object)})

    html = F.col("html").cast("string")
    return (pages.select(host(F.col("url").cast("string")).alias("host"), html.alias("html"))
            .where("host is not null and html is not null")
            .select("host", F.xxhash64("html").alias("page"), read("html").alias("read"))
            .select("host", "page", "read.article", "read.subtrees"))


def _counted(found: DataFrame, min_pages: int) -> DataFrame:
    """Subtrees of at least ``min_pages`` articles of their host; one page stands for each article (any: the least)."""
    return (found.groupBy("host", "article").agg(F.min("subtrees").alias("subtrees"))
            .select("host", F.explode("subtrees").alias("subtree"))
            .groupBy("host", "subtree").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree, n_pages): template subtrees of each host of ``pages`` (url, html).

    Pages of a host with the same article count once, so copies of one article make no template. Counts are combined
    before every shuffle; pages without a host or html are left out.
    """
    return _counted(_subtrees(pages), min_pages)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with ``text`` (main text, empty if none; null html is empty) and ``n_chars`` (its code points).

    Every row is returned, repeated ones too; columns of those two names are replaced, others are kept.
    """
    from tabwright.llm.common import cut_lineage, written
    found = written(_subtrees(pages), "page-subtrees")
    known = cut_lineage(_counted(found, min_pages).select("host", "subtree"))
    pages = pages.withColumn("__host", host(F.col("url").cast("string")))
    if known.count() <= BROADCAST_TEMPLATES:
        by_host: dict[str, set[int]] = {}
        for h, subtree in known.toLocalIterator():
            by_host.setdefault(h, set()).add(subtree)
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        @F.pandas_udf("string")
        def site_text(html: pd.Series, hosts: pd.Series) -> pd.Series:
            return pd.Series([Page(h).text(shared.value.get(at, ())) for h, at in zip(html, hosts, strict=True)],
                             dtype=object)

        return (pages.withColumn("text", site_text(F.col("html").cast("string"), "__host"))
                .withColumn("n_chars", F.char_length("text").cast("long")).drop("__host"))
    by_page = (found.select("host", "page", F.explode("subtrees").alias("subtree"))
               .join(known, ["host", "subtree"], "left_semi")
               .groupBy(F.col("host").alias("__host"), F.col("page").alias("__page"))
               .agg(F.collect_set("subtree").alias("__subtrees")))

    @F.pandas_udf("string")
    def text(html: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([Page(h).text(frozenset(g) if g is not None else frozenset())
                          for h, g in zip(html, gone, strict=True)], dtype=object)

    return (pages.withColumn("__page", F.xxhash64(F.col("html").cast("string")))
            .join(by_page, ["__host", "__page"], "left")
            .withColumn("text", text(F.col("html").cast("string"), "__subtrees"))
            .withColumn("n_chars", F.char_length("text").cast("long")).drop("__host", "__page", "__subtrees"))
