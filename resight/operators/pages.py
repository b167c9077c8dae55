"""Text, result cards and page sequences from saved HTML.

Text is made by Spark's own functions; only character references go to Arrow batches, and pages whose elements count (identity, criteria,
cards) are read there as trees.  Errors are rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import by_rows
from ..functions.unicode import replaced
from ..sources.tables import save_versions, scratch

# Elements without text for a reader, and elements that stand on lines of their own.
SKIPPED = ["script", "style", "noscript", "iframe", "button"]
BLOCKS = ["p", "div", "section", "article", "header", "footer", "main", "aside", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "nav"]
# Elements that have no end tag; words in titles of pages that ask for a login; keys of criteria by their label.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LOGIN = ("sign in", "login", "security", "verification", "authwall")
CRITERIA = {
    "seniority level": "seniority", "employment type": "employment_type", "job function": "job_function", "industries": "industries",
    "karrierestufe": "seniority", "beschäftigungsverhältnis": "employment_type", "tätigkeitsbereich": "job_function", "branchen": "industries",
}
# Where a posting's page has its parts, and a result page its cards and their fields, the first that is found.
POSTING = {"content": [".show-more-less-html__markup"], "title": [".topcard__title"], "item": [".description__job-criteria-item"], "label": [".description__job-criteria-subheader"], "value": [".description__job-criteria-text"]}
CARDS = {
    "card": ["div.job-search-card", "div.base-card", "div.jobs-search__results-list > li"],
    "title": ["h3.base-search-card__title", "h3.base-search-card__title a", "h3.base-card__title", "h3.result-card__title", "h3.job-card-list__title", "h3"],
    "company": ["h4.base-search-card__subtitle a", "h4.base-search-card__subtitle", "a.topcard__flavor--name", "span.topcard__flavor a", "h4"],
    "location": ["span.job-search-card__location", "span.topcard__flavor--bullet", "span"],
    "link": ["a.base-card__full-link", "a.job-card-container__link", "a.result-card__full-card-link", "a"],
}
_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
_REST = r"""\b(?:[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+>|[^>]*>)"""


def _unescaped(t: Column) -> Column:
    """Character references as html.unescape() reads them, which gets them one by one."""
    return replaced(t, _REFERENCE, entities.unescape, t.contains("&"))


def _marked(html: Column) -> Column:
    """HTML without its elements: blocks on lines of their own, scripts, styles and the title left out."""
    t = F.regexp_replace(html, "(?s)<!--.*?(?:-->|\\z)", "")
    t = F.regexp_replace(t, f"(?is)<({'|'.join([*SKIPPED, 'title'])}){_REST}.*?(?:</\\1\\s*>|\\z)", "")
    t = F.regexp_replace(t, f"(?i)<li{_REST}", "\n• ")
    t = F.regexp_replace(t, f"(?i)</?(?:{'|'.join([*BLOCKS, 'br', 'li'])}){_REST}", "\n")
    return F.regexp_replace(t, f"</?[A-Za-z!][A-Za-z0-9-]*{_REST}", "")


def _lines(plain: Column) -> Column:
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\t\\r\\f\\x0B \\xA0]+", " ")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != "•")), "\n")


def html_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of each page: paragraphs and list items on lines of their own, scripts, styles and the title left out, blanks squeezed; null for null.

    Only character references go to Python.
    """
    t = pages.select(id_col, _marked(F.col(html_col)).alias("_t")).select(id_col, _unescaped(F.col("_t")).alias("_t"))
    return t.select(id_col, _lines(F.col("_t")).alias("text"))


class Node:
    """An element: tag, attributes, and parts that are texts or elements."""

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.parts = tag, attrs, up, []

    def all(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            if n is not self:
                yield n
            todo.extend(reversed([p for p in n.parts if isinstance(p, Node)]))

    def meets(self, step: str) -> bool:
        tag, _, cls = step.partition(".")
        return (not tag or self.tag == tag) and (not cls or cls in (self.attrs.get("class") or "").split())

    def select(self, selectors: list[str]) -> list[Node]:
        """The elements below of the first selector that finds any: tag, .class, tag.class, `a b` and `a > b`."""
        for s in selectors:
            *above, last = s.replace(" > ", " >").split()
            if found := [n for n in self.all() if n.meets(last.lstrip(">")) and n._under(above, last.startswith(">"))]:
                return found
        return []

    def _under(self, above: list[str], direct: bool) -> bool:
        if not above:
            return True
        n = self.up
        while n is not None:
            if n.meets(above[-1].lstrip(">")) and n._under(above[:-1], above[-1].startswith(">")):
                return True
            n = None if direct else n.up
        return False

    def text(self) -> str:
        """All its text in one line."""
        out, todo = [], [self]
        while todo:
            p = todo.pop()
            if isinstance(p, str):
                out.append(p)
            elif p.tag not in SKIPPED:
                todo.extend(reversed(p.parts))
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, text):
        self.at.parts.append(text)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def text_lines(node: Node) -> str:
    """The text of an element as html_text() makes it, without recursion over deep pages."""
    out, todo = [], [node]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.tag not in SKIPPED and p.tag != "title":
            own = p.tag in BLOCKS or p.tag in ("br", "li")
            out.append("\n• " if p.tag == "li" else "\n" if own else "")
            todo.extend([*(["\n"] if own else []), *reversed(p.parts)])
    lines = (re.sub("[\t\r\f\v \xa0]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x and x != "•")


def _postings(root: Node) -> Iterator[dict]:
    """JSON-LD objects of type JobPosting, in lists and graphs too; what is no JSON is passed over."""
    for script in root.select(["script"]):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            doc = json.loads("".join(p for p in script.parts if isinstance(p, str)))
        except ValueError:
            continue
        for obj in doc if isinstance(doc, list) else [doc]:
            graph = obj.get("@graph", [obj]) if isinstance(obj, dict) else []
            yield from (x for x in (graph if isinstance(graph, list) else []) if isinstance(x, dict) and x.get("@type") == "JobPosting")


def _page(page_id: str, html: str | None, identity: re.Pattern, urn: str, where: dict[str, list[str]]) -> tuple:
    """title, text, locator, criteria, error_kind"""
    if html is None:
        return None, None, None, [], "parse"
    root = tree(html)
    first = lambda node, name: next(iter(node.select(where.get(name, []))), None)
    head = first(root, "title") or next(iter(root.select(["title"])), None)
    title = head.text() if head else None
    confirmed = False
    link = next((n for n in root.select(["link"]) if n.attrs.get("rel") == "canonical" and n.attrs.get("href")), None)
    if link:
        m = identity.search(link.attrs["href"])
        if not m or m[1] != page_id:
            return title, None, None, [], "identity_mismatch"
        confirmed = True
    named = next((n.attrs["data-semaphore-content-urn"] for n in root.all() if n.attrs.get("data-semaphore-content-urn", "").startswith(urn)), None)
    if named is not None:
        if named != urn + page_id:
            return title, None, None, [], "identity_mismatch"
        confirmed = True
    node, locator = first(root, "content"), (where.get("content") or [""])[0]
    text = text_lines(node) if node else ""
    if not text:
        for obj in _postings(root):
            own = obj.get("identifier")
            own = own.get("value") if isinstance(own, dict) else own
            m = identity.search(str(obj.get("url", "")))
            if (str(own) == page_id or m and m[1] == page_id) and isinstance(obj.get("description"), str):
                text, locator, confirmed = text_lines(tree(obj["description"])), "JobPosting.description", True
                break
    if not text:
        asks = next(iter(root.select(["title"])), None)
        blocked = asks is not None and any(w in asks.text().casefold() for w in LOGIN)
        return title, None, None, [], "blocked" if blocked else "parse"
    if not confirmed:
        return title, None, None, [], "identity_mismatch"
    criteria = []
    for item in root.select(where.get("item", [])):
        label, value = first(item, "label"), first(item, "value")
        if label and value and value.text():
            criteria.append({"key": CRITERIA.get(label.text().casefold(), "other"), "label": label.text(), "value": value.text()})
    return title, text, locator, criteria, None


def parse_pages(pages: DataFrame, identity_pattern: str, *, id_col: str = "page_id", name_col: str | None = None, html_col: str = "html", urn: str = "urn:li:jobPosting:", where: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, title, text, locator, criteria, error_kind) of each page.

    A page must name itself (by its id, or what name_col holds): by a canonical link whose first group of identity_pattern is the name, by an urn, or by the JSON-LD posting that its text
    is taken from, else identity_mismatch.  The text is that of the first content element (where: selectors by part, POSTING by default), else of a
    JSON-LD posting of this id.  Without any the page is blocked, if its title asks for a login, or parse.  criteria are (key, label, value), with keys by label.
    """
    pattern, places = re.compile(identity_pattern), POSTING if where is None else where

    criteria = pa.list_(pa.struct([(c, pa.string()) for c in ("key", "label", "value")]))
    fields = [*((c, pa.string()) for c in ("title", "text", "locator")), ("criteria", criteria), ("error_kind", pa.string())]
    run = by_rows(lambda i, name, html: [(i, *_page(str(name), html, pattern, urn, places))], [id_col], fields)

    found = "title string, text string, locator string, criteria array<struct<key:string,label:string,value:string>>, error_kind string"
    return pages.select(id_col, F.col(name_col or id_col).alias("_name"), html_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, {found}")


def result_cards(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", where: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, pos, href, title, company, location) of the cards of a result page, in order: containers and fields by the first selector
    that finds any (CARDS by default), fields that are not found empty."""
    places = CARDS if where is None else where

    def field(card: Node, name: str) -> str:
        return next((t for s in places.get(name, []) for n in card.select([s]) if (t := n.text())), "")

    def found(i, html: str | None) -> Iterator[tuple]:
        for pos, card in enumerate(tree(html).select(places["card"]) if html else []):
            link = next((n.attrs["href"].strip() for s in places.get("link", []) for n in card.select([s]) if n.attrs.get("href")), card.attrs.get("href", ""))
            yield i, pos, link, field(card, "title") or (card.text() if "title" not in places else ""), field(card, "company"), field(card, "location")

    run = by_rows(found, [id_col], [("pos", pa.int64()), *((c, pa.string()) for c in ("href", "title", "company", "location"))])
    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, pos bigint, href string, title string, company string, location string")


def page_sequence(cards: DataFrame, *, short: int = 10, pages_at_most: int = 4) -> DataFrame:
    """(query, stop_offset, reason, new_ids) from cards (query, offset, id): where a walk over ordered pages stops.

    It stops at the first page that is empty, has the same ids as an earlier one, has no new id, is short, or is the last allowed.
    """
    q = Window.partitionBy("query").orderBy("offset")
    fresh = cards.withColumn("new", F.row_number().over(Window.partitionBy("query", "id").orderBy("offset")) == 1)
    page = fresh.groupBy("query", "offset").agg(F.count("id").alias("n"), F.count_if(F.col("new") & F.col("id").isNotNull()).alias("new_ids"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ","), 256).alias("ids"))
    page = page.withColumn("nth", F.row_number().over(q)).withColumn("again", F.row_number().over(Window.partitionBy("query", "ids").orderBy("offset")) > 1)
    why = F.when(F.col("n") == 0, "empty_page").when(F.col("again"), "repeated_page").when(F.col("new_ids") == 0, "no_new_jobs").when(F.col("n") < short, "short_page").when(F.col("nth") >= pages_at_most, "page_limit")
    page = page.withColumn("why", why)
    stop = page.filter("why IS NOT NULL").groupBy("query").agg(F.min(F.struct("offset", "why")).alias("s"))
    kept = page.join(stop.hint("shuffle_hash"), "query", "left").filter("s IS NULL OR offset <= s.offset")
    return kept.groupBy("query").agg(F.max("offset").alias("stop_offset"), F.coalesce(F.first("s.why"), F.lit("end")).alias("reason"), F.sum("new_ids").alias("new_ids"))


def reparse(snapshots: DataFrame, saved: DataFrame, version: str, identity_pattern: str, *, id_col: str = "page_id", body_col: str = "body", name_col: str | None = None, where: dict[str, list[str]] | None = None) -> DataFrame:
    """Results to append after stored pages (id, body: bytes, and name_col if given) are parsed again under a version: (id, source_sha256, version, title,
    text, locator, criteria, error_kind, sha256), those that `saved` (id, source_sha256, version, sha256) doesn't have.

    Bytes are read as UTF-8, bad ones replaced; null ones are an empty page.  Equal snapshots of an id are one.  A result meets the saved one of the same bytes and version; if
    its content (sha256 of all its fields) is another, the job fails: a parser that changed needs a new version.
    """
    names = [id_col, *([name_col] if name_col else [])]
    body = F.coalesce(F.col(body_col), F.lit(b""))
    s = snapshots.select(*names, F.sha2(body, 256).alias("source_sha256"), F.make_valid_utf8(body.cast("string")).alias("_html")).dropDuplicates([id_col, "source_sha256"])
    # the parser gets one row for each snapshot, under a key that leads back to it
    key = F.to_json(F.struct("source_sha256", F.col(id_col).cast("string").alias("id")))
    s = s.select(*(F.col(c) for c in names), "source_sha256", key.alias("_key"), F.col(name_col or id_col).cast("string").alias("_named"), "_html")
    found = parse_pages(s.select("_key", "_named", "_html"), identity_pattern, id_col="_key", name_col="_named", html_col="_html", where=where)
    path = scratch(snapshots.sparkSession, "reparsed")
    fields = ["title", "text", "locator", "criteria", "error_kind"]
    found.select("*", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias("sha256")).write.parquet(path)
    found = snapshots.sparkSession.read.parquet(path)
    out = s.select(id_col, "source_sha256", "_key").join(found.hint("merge"), "_key").select(id_col, "source_sha256", F.lit(version).alias("version"), *fields, "sha256")
    return save_versions(out, saved, [id_col, "source_sha256", "version"])
