"""Review extraction from crawled pages.

Input is a table of fetched pages ``(page_id, url, html[, source])``. The
parse runs per page inside ``mapInPandas`` (Arrow batches, stdlib
``html.parser``; no third-party HTML library is needed), emitting one row per
review container; everything after it (rating parse, date normalisation,
keys, cut-off, frontier) is Column expressions. Plain tags are told by one
pattern, once a page, and only elements that a rule names become nodes.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revq.functions.dates import normalize_date
from revq.functions.text import py_strip
from revq.functions.keys import ASIN_RE, clean_title, parse_rating, review_key, url_base, url_page_no, url_tail

# --- fixed values: selector rule sets ---------------------------------------
# Each selector: (tag, attribute, kind, value); kind is "eq" (one token or
# the whole value equals), "re" (regex search on a token or the whole value)
# or "any" (tag only). Lists are tried in order; the first hit wins.
MARKETPLACE_A = {
    "containers": [[("div", "data-hook", "eq", "review")]],
    "rating": [("i", "data-hook", "eq", "review-star-rating")],
    "title": [("a", "data-hook", "eq", "review-title"), ("span", "data-hook", "eq", "review-title")],
    "body": [("span", "data-hook", "eq", "review-body")],
    "date": [("span", "data-hook", "eq", "review-date")],
    "author_link": [("a", "class", "re", "author")],
    "author_name": [("span", "class", "eq", "a-profile-name")],
    "drop": [],
    "strip_star_title": True,
    "rating_first_token": True,
}
MARKETPLACE_B = {
    "containers": [
        [("div", "class", "eq", "RcXBOT")],
        [("div", "class", "full", "col _2wzgFH K0kLPL")],
        [("div", "class", "re", r"EKFha-")],
    ],
    "rating": [("div", "class", "re", r"_1lRcqv|XQDdHH|hGQGAP")],
    "title": [("p", "class", "re", r"z9E0IG|_2-N8zT")],
    "body": [("div", "class", "re", r"ZmyHeo|t-ZTKy")],
    "date": [("p", "class", "re", r"_2sc7ZR|_2mcZGG")],
    "author_link": [],
    "author_name": [("p", "class", "re", r"_2sc7ZR|_2V5EHH"), ("p", "class", "re", r"MrFlB3")],
    "drop": [("span", "class", "re", r"teGi1e")],
}
# generic article pages: one review per <article>, title <h1>, body = all <p>
ARTICLE = {
    "containers": [[("article", None, "any", None)]],
    "rating": [],
    "title": [("h1", None, "any", None)],
    "body_all": [("p", None, "any", None)],
    "date": [("time", None, "any", None)],
    "author_link": [],
    "author_name": [],
    "drop": [],
}
RULES = {"amazon": MARKETPLACE_A, "flipkart": MARKETPLACE_B, "article": ARTICLE}
ANONYMOUS = "anonymous"
REVIEWS_ORIGIN = "https://www.amazon.in"
REVIEWS_TAIL = "/ref=cm_cr_arp_d_paging_btm_next_{page}?ie=UTF8&reviewerType=all_reviews&pageNumber={page}"
# --- end of fixed values ---------------------------------------------------

# The page parser runs in Python workers. Ship this module's code with the
# task (by value) so executors do not need the package installed.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # older cloudpickle: rely on --py-files
    pass

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP_TEXT = {"script", "style", "template"}
CLOSES_P = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "nav", "header", "footer"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "inside")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent, self.inside = tag, attrs, [], parent, None

    def iter(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def strings(self):
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if not isinstance(c, Node):
                yield c
            elif c.tag not in SKIP_TEXT:
                stack.extend(reversed(c.children))

    def text(self) -> str:
        """Stripped pieces joined with '' (like ``get_text(strip=True)``)."""
        return "".join(s.strip() for s in self.strings() if s.strip())


# A tag that needs no rule of the standard parser: quoted values without references.
PLAIN = re.compile(r'([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_-]*="[^"&]*")*)( ?/)?|/([a-zA-Z][a-zA-Z0-9]*)')
ATTR = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"')
# elements whose content some version of the standard parser reads by rules of its own
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
OTHER, END, INLINE, START, SINGLE = range(5)  # what stands between < and >


class _Builder(HTMLParser):
    """Tree of the elements in ``wanted``; of others only the texts stay, in
    the nearest wanted element around them."""

    def __init__(self, wanted: set[str]):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.cur = self.root
        self.wanted = wanted
        self.open: list[tuple[str, Node]] = []  # open elements: tag, the node around it
        self.depth = defaultdict(int)  # open elements by tag
        self.seen: dict[str, tuple] = {}  # markup between < and > that the page repeats

    def read(self, html: str) -> None:
        """The whole page: plain tags and texts at once, other markup by the standard parser.

        That parser gets pieces that end before a ``<``, each twice the last
        one, until it holds nothing back.
        """
        first, *parts = html.split("<")
        if first:
            self.handle_data(unescape(first))
        k = 0
        while k < len(parts):
            k, size = self._read_plain(parts, k), 1
            while k < len(parts):
                self.feed("<" + "<".join(parts[k : k + size]))
                k, size = k + size, 2 * size
                if not self.rawdata and self.cdata_elem is None:
                    break
        self.close()

    def _read_plain(self, parts: list[str], k: int) -> int:
        """Read plain tags and the texts behind them from part ``k`` on; the
        part where other markup begins, or their number."""
        seen, opened, depth = self.seen, self.open, self.depth
        for k in range(k, len(parts)):
            inner, closed, text = parts[k].partition(">")
            kind, tag, attrs = (seen.get(inner) or self._kind(inner)) if closed else (OTHER, "", ())
            if kind == OTHER:
                return k
            if kind == INLINE:
                opened.append((tag, self.cur))
                depth[tag] += 1
            elif kind == END:
                self.handle_endtag(tag)
            elif kind == START:
                self.handle_starttag(tag, attrs)
            else:
                self.handle_startendtag(tag, attrs)
            if text:
                self.cur.children.append(unescape(text))
        return len(parts)

    def _kind(self, inner: str) -> tuple:
        """(kind, tag, attributes) of the markup between < and >."""
        m = PLAIN.fullmatch(inner)
        tag = (m[1] or m[4]).lower() if m else ""
        if not m or (m[1] and tag in RAW):
            kind = OTHER
        elif m[4]:
            kind = END
        elif m[3]:
            kind = SINGLE
        else:
            kind = START if tag in self.wanted or tag in VOID or tag in CLOSES_P else INLINE
        attrs = [(name.lower(), value) for name, value in ATTR.findall(m[2])] if m and m[2] else []
        self.seen[inner] = kind, tag, attrs
        return self.seen[inner]

    def _node(self, tag, attrs) -> Node:
        node = Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.depth["p"]:
            self._close("p")
        node = self._node(tag, attrs) if tag in self.wanted else self.cur
        if tag not in VOID:
            self.open.append((tag, self.cur))
            self.cur = node
            self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in self.wanted:
            self._node(tag, attrs)

    def handle_endtag(self, tag):
        if self.depth[tag]:
            self._close(tag)

    def handle_data(self, data):
        self.cur.children.append(data)

    def _close(self, tag):
        closed = None
        while closed != tag:
            closed, self.cur = self.open.pop()
            self.depth[closed] -= 1


def parse_html(html: str, wanted: set[str]) -> Node:
    b = _Builder(wanted | SKIP_TEXT)
    b.read(html or "")
    return b.root


def _tags(rules: dict) -> set[str]:
    """Tags that the selectors of a rule set name."""
    lists = [v for k, v in rules.items() if k != "containers" and isinstance(v, list)]
    return {sel[0] for sels in lists + rules["containers"] for sel in sels}


def _matches(n: Node, sel) -> bool:
    tag, attr, kind, value = sel
    if n.tag != tag:
        return False
    if kind == "any":
        return True
    if attr not in n.attrs:
        return False
    v = n.attrs[attr]
    tokens = v.split() if attr == "class" else [v]
    if kind == "eq":
        return value in tokens or v == value
    if kind == "full":
        return v == value
    return any(re.search(value, t) for t in tokens) or bool(re.search(value, v))


def _find(root: Node, sels) -> Node | None:
    """First element that matches. The elements inside ``root`` are listed by
    tag at its first search; drops come after its last one (``_body``)."""
    if root.inside is None:
        root.inside = defaultdict(list)
        for n in root.iter():
            if n is not root:
                root.inside[n.tag].append(n)
    for sel in sels:
        for n in root.inside.get(sel[0], ()):
            if _matches(n, sel):
                return n
    return None


def _find_all(root: Node, sels) -> list[Node]:
    for group in sels:
        hits = [n for n in root.iter() if n is not root and any(_matches(n, s) for s in group)]
        if hits:
            return hits
    return []


def _body(c: Node, rules: dict) -> str:
    if "body_all" in rules:
        paras = [n for n in c.iter() if n is not c and any(_matches(n, s) for s in rules["body_all"])]
        return "\n".join(t for t in (p.text() for p in paras) if t)
    body = _find(c, rules["body"])
    if body is None:
        return ""
    if rules["drop"]:
        for n in list(body.iter()):
            if n is not body and any(_matches(n, s) for s in rules["drop"]):
                n.parent.children.remove(n)
    return body.text()


def _author(c: Node, rules: dict) -> tuple[str, str]:
    link = _find(c, rules["author_link"])
    if link is not None and link.attrs.get("href"):
        return link.attrs["href"], "link"
    name = _find(c, rules["author_name"])
    return (name.text(), "name") if name is not None else (ANONYMOUS, "none")


def _review(c: Node, rules: dict) -> dict:
    star, title, date = (_find(c, rules[k]) for k in ("rating", "title", "date"))
    author, author_kind = _author(c, rules)
    return {
        "strip_star_title": bool(rules.get("strip_star_title")),
        "rating_first_token": bool(rules.get("rating_first_token")),
        "star_text": star.text() if star is not None else None,
        "title": title.text() if title is not None else "",
        "text": _body(c, rules),
        "raw_date": date.text() if date is not None else "",
        "author": author,
        "author_kind": author_kind,
    }


def _unread(pos: int, e: Exception) -> dict:
    return {
        "pos": pos,
        "strip_star_title": False,
        "rating_first_token": False,
        "star_text": None,
        "title": "",
        "text": "",
        "raw_date": "",
        "author": "",
        "author_kind": "none",
        "error": f"{type(e).__name__}: {e}"[:200],
    }


def extract_page(html: str, rules: dict) -> Iterator[dict]:
    """Review dicts of one page (raw fields; typing happens in Spark).

    A page or a review that cannot be read gives one row with ``error`` set
    and no text, so it is counted and never stops the task.
    """
    try:
        containers = _find_all(parse_html(html, _tags(rules)), rules["containers"])
    except Exception as e:  # markup the standard parser refuses
        yield _unread(-1, e)
        return
    for i, c in enumerate(containers):
        try:
            yield {"pos": i, **_review(c, rules), "error": None}
        except Exception as e:
            yield _unread(i, e)


EXTRACT_SCHEMA = (
    "page_id long, url string, source string, pos int, strip_star_title boolean, rating_first_token boolean, "
    "star_text string, title string, "
    "text string, raw_date string, author string, author_kind string, error string"
)
OUT_ROWS = 512  # reviews handed on at a time


def _extract_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [f.split()[0] for f in EXTRACT_SCHEMA.split(", ")]
    rows: list[dict] = []
    for pdf in it:
        for page_id, url, html, source in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["source"]):
            for r in extract_page(html, RULES[source]):
                rows.append({"page_id": page_id, "url": url, "source": source, **r})
                if len(rows) >= OUT_ROWS:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=cols)


def readable_pages(pages: DataFrame) -> DataFrame:
    """Pages of a known source (in any letter case) with a URL and a body;
    others give nothing (S5)."""
    known = pages.withColumn("source", F.lower("source"))
    return known.filter(F.col("source").isin(*RULES) & (F.col("url") != "") & F.col("html").isNotNull())


def extract_raw(pages: DataFrame) -> DataFrame:
    """One row per review container; pages of unknown source or without a
    URL give nothing. Rows with ``error`` could not be read."""
    if "source" not in pages.columns:
        pages = pages.withColumn("source", F.lit("article"))
    return readable_pages(pages).select("page_id", "url", "html", "source").mapInPandas(_extract_batches, EXTRACT_SCHEMA)


def extract_reviews(pages: DataFrame, product_id=None) -> DataFrame:
    """Typed review rows: rating (missing star -> 0, unreadable -> row dropped),
    cleaned title, body (empty -> dropped), normalised date, reviewer id
    (tail of the author link, else the profile name, else 'anonymous'),
    review key. ``product_id`` defaults to the listing URL (no query)."""
    raw = extract_raw(pages)
    whole = py_strip("star_text").try_cast("double")
    whole_int = F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), F.lit(None)).otherwise(whole.try_cast("int"))
    rating = (
        F.when(F.col("star_text").isNull(), F.lit(0))
        .when(F.col("rating_first_token"), parse_rating("star_text"))
        .otherwise(whole_int)
    )
    reviewer = F.when(F.col("author_kind") == "link", url_tail("author")).otherwise(F.col("author"))
    prod = F.lit(product_id) if isinstance(product_id, str) else (product_id if product_id is not None else url_base("url"))
    typed = raw.select(
        "page_id",
        "url",
        "pos",
        prod.alias("product_id"),
        "source",
        rating.alias("rating"),
        F.when(F.col("strip_star_title"), clean_title("title")).otherwise(F.col("title")).alias("title"),
        "text",
        normalize_date("raw_date").alias("date"),
        reviewer.alias("reviewer_id"),
    )
    kept = typed.filter((F.col("text") != "") & F.col("rating").isNotNull())
    return kept.withColumn("review_id", review_key("reviewer_id", "date", "product_id"))


def count_occurrences(col: str, needle: str) -> F.Column:
    """Non-overlapping occurrences of a literal (JVM-side, no parse)."""
    c = F.col(col)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def page_listing(pages: DataFrame, container: str = "<article") -> DataFrame:
    """(page_id, listing, page_no, fetched, n_reviews) from a pages table."""
    return pages.select(
        "page_id",
        url_base("url").alias("listing"),
        url_page_no("url").alias("page_no"),
        F.col("html").isNotNull().alias("fetched"),
        F.coalesce(count_occurrences("html", container), F.lit(0)).alias("n_reviews"),
    )


def page_cutoff(listing: DataFrame) -> DataFrame:
    """Keep pages before the first fetched page with no reviews (S3).

    A failed fetch (``fetched`` false) is skipped, not a stop. The first empty
    page per listing is a grouped min() (combined map-side, so a listing with
    very many pages stays spread) joined back to the pages.
    """
    empty = listing.filter(F.col("fetched") & (F.col("n_reviews") == 0))
    cut = empty.groupBy(F.col("listing").alias("_listing")).agg(F.min("page_no").alias("_cut"))
    kept = listing.filter("fetched").join(cut, F.col("listing").eqNullSafe(F.col("_listing")), "left")
    return kept.filter(F.col("_cut").isNull() | (F.col("page_no") < F.col("_cut"))).drop("_listing", "_cut")


def page_template(url: F.Column, source: F.Column) -> F.Column:
    """URL of a listing's review pages with ``{page}`` for the number.

    Marketplace A: a reviews URL keeps its query and has its ``pageNumber``
    replaced or added; any other URL needs a product code (``/dp/<code>``).
    Marketplace B: the query dropped, ``?page=`` added. NULL (no pages) for
    a URL without code, a blank URL or an unknown source.
    """
    code = F.regexp_extract(url, ASIN_RE, 1)
    numbered = F.regexp_replace(url, r"pageNumber=\d+", "pageNumber={page}")
    sep = F.when(numbered.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    added = F.when(numbered.contains("pageNumber="), numbered).otherwise(F.concat(numbered, sep, F.lit("pageNumber={page}")))
    a = F.when(url.contains("product-reviews"), added).when(
        code != "", F.concat(F.lit(REVIEWS_ORIGIN + "/product-reviews/"), code, F.lit(REVIEWS_TAIL))
    )
    b = F.concat(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("?page={page}"))
    kind = F.lower(source)
    return F.when(url == "", F.lit(None)).when(kind == "amazon", a).when(kind == "flipkart", b)


def crawl_frontier(listings: DataFrame, max_pages: int = 10) -> DataFrame:
    """(source, listing, page_no, page_url) for pages 1..max_pages of every
    distinct (source, url) whose page URLs are known (S4, S5). A URL that
    resolves to no template gives no rows."""
    base = listings.select(F.lower("source").alias("source"), F.col("url").alias("listing")).distinct()
    known = base.withColumn("template", page_template(F.col("listing"), F.col("source"))).filter("template IS NOT NULL")
    numbered = known.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
    url = F.replace("template", F.lit("{page}"), F.col("page_no").cast("string"))
    return numbered.select("source", "listing", "page_no", url.alias("page_url"))
