"""Main text of web pages: site templates are removed by counting hashed element subtrees by host.

Pass 1 parses every page and hashes the subtree of each element (tag, class, id and the white-space-normal text and subtrees
below, the hash being that of the content, wherever it stands), within the article or not. Spark counts by host in how many
pages with different articles a subtree occurs: copies of one page count once, so they don't turn their own article into a
template. A subtree that recurs in at least RECURS pages of its host is a template, however large the host. Templates are
joined to the pages that have them by host and hash. Pass 2 parses the pages again and deletes their templates first. What
stands in fewer pages than that no count can tell from an article, so what its own markup names (tag, role or a whole word of
its class or id) as one of the kinds of block that aren't main text is deleted after that; the blocks left are joined.

Within an article element, running text (paragraphs, headings, quotes and what is within a line) is the author's even where it
recurs, so templates there are only other elements. Pages without an article element are cut by templates throughout.

Defined cases: null and empty html give the empty text; a null or odd url has the host ''; rows equal in key, url and html are
alike, and each gives its row; a null key is a key like others; subtrees that recur equally often are templates alike; pages of
any length are parsed whole, in linear time; an empty table gives an empty result; broken markup is read as far as it goes.
Extra columns are not carried, so their names can't clash.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.markup import BLOCK, Element, parse, walk
from tidemark.llm.shared import spread_join, written

RECURS = 3
#: Tags, roles and words of class and id that name menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
#: and reader comments (fixed word lists). A word counts as a whole: "related-work" isn't "related".
DROP_TAGS = frozenset("head title script style noscript template nav footer aside form button select option input textarea datalist iframe menu".split())
DROP_WORDS = frozenset(
    "menu nav navbar navigation main-menu main-nav site-nav breadcrumb breadcrumbs masthead site-header page-header footer site-footer page-footer sidebar side-bar "
    "notice notices cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr banner "
    "ad ads adv advert adverts advertisement advertisements advertising adsense ad-banner ad-slot ad-container sponsor sponsored promo promotion promoted "
    "newsletter newsletter-signup subscribe subscription search-form login signup share sharing share-buttons social-share social-links "
    "comment comments comment-list commentlist comments-area reader-comments user-comments replies disqus disqus_thread".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert menu menubar form".split())
MAIN_WORDS = frozenset("article articlebody post-content post-body entry-content article-body article-content story-body main-content".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th b i em strong a span code".split())
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
NEVER = frozenset("head script style template".split())


def _named(node: Element) -> set[str]:
    """The words of class and id."""
    own = node.attributes
    return set(f"{own.get('class', '')} {own.get('id', '')}".lower().split()) if "class" in own or "id" in own else set()


def is_article(node: Element) -> bool:
    if node.tag in ("article", "main") or node.attributes.get("role") in ("main", "article") or node.attributes.get("itemprop", "").lower() == "articlebody":
        return not _named(node) & {"comment", "comments", "reply", "replies", "related", "teaser", "sidebar", "ad", "ads", "promo", "sponsored"}
    return bool(_named(node) & MAIN_WORDS)


def _dropped(node: Element, in_article: bool, holders: set[int]) -> bool:
    """The markup says that this isn't article text. An element around the article isn't dropped for its names."""
    if node.tag in DROP_TAGS:
        return id(node) not in holders or node.tag in NEVER
    if id(node) in holders or node.tag in ("html", "body"):
        return False
    return node.tag == "header" and not in_article or node.attributes.get("role") in DROP_ROLES or bool(_named(node) & DROP_WORDS)


def articles(root: Element) -> tuple[list[Element], set[int]]:
    """(the outermost article elements, or main ones where there is none; ids of the elements around and of them)."""
    around = {id(root)}  # the elements that hold an article or main element
    for node, begins in walk(root):
        if begins and node.tag in ("article", "main") and is_article(node):
            up = node
            while id(up) not in around:
                around.add(id(up))
                up = up.parent
    found, depth = [], 0
    for node, begins in walk(root):
        if begins is None:
            continue
        if not begins:
            depth -= depth > 0
        elif depth:
            depth += 1
        elif is_article(node):
            found.append(node)
            depth = 1
        elif node.tag in DROP_TAGS or node.tag not in ("html", "body") and id(node) not in around and _named(node) & DROP_WORDS:
            depth = 1
    holders = set()
    for node in found:
        up = node
        while up is not None and id(up) not in holders:
            holders.add(id(up))
            up = up.parent
    return found, holders


def subtree_hashes(root: Element) -> dict[int, int]:
    """id of each element: the hash of its subtree."""
    hashes: dict[int, int] = {}
    stack: list[list[bytes]] = [[]]
    for node, begins in walk(root):
        if begins is None:
            text = " ".join(node.split())
            if text:
                stack[-1].append(text.encode("utf-8", "replace"))
        elif begins:
            stack.append([f"<{node.tag} {node.attributes.get('class', '')} {node.attributes.get('id', '')}>".encode("utf-8", "replace")])
        else:
            h = xxhash.xxh64_intdigest(b"\0".join(stack.pop()), 1)
            hashes[id(node)] = h - (1 << 64) if h >> 63 else h
            stack[-1].append(b"\1" + h.to_bytes(8, "big"))
    return hashes


def _candidates(root: Element) -> tuple[int, list[int]]:
    """(hash of the article's text, the hashes of the page's subtrees that may be templates)."""
    found, holders = articles(root)
    inside: set[int] = {id(n) for a in found for n, begins in walk(a) if begins}
    hashes = subtree_hashes(root)
    h = xxhash.xxh64_intdigest("\n\n".join(blocks(root, frozenset())).encode("utf-8", "replace"), 2)
    kept = {hashes[id(n)] for n, begins in walk(root) if begins and id(n) not in holders and n.tag not in ("html", "body", "head") and not (id(n) in inside and n.tag in PROSE)}
    return h - (1 << 64) if h >> 63 else h, sorted(kept)


def blocks(root: Element, templates: frozenset[int] | set[int]) -> list[str]:
    """The text blocks of the article, in page order."""
    found, holders = articles(root)
    hashes = subtree_hashes(root) if templates else {}
    inside = {id(n): True for a in found for n, begins in walk(a) if begins}
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    for top in found or [root]:
        skip = 0
        for node, begins in walk(top):
            if begins is None:
                if not skip:
                    line.append(node)
                continue
            if begins:
                if skip:
                    skip += 1
                    continue
                within = bool(found)
                template = hashes.get(id(node)) in templates and id(node) not in holders and not (id(node) in inside and node.tag in PROSE)
                if template or _dropped(node, within, holders):
                    skip = 1
                    if node.tag in BLOCK:
                        flush()
                    continue
                if node.tag == "br":
                    line.append(" ")
            elif skip:
                skip -= 1
                continue
            if node.tag in BLOCK:
                flush()
        flush()
    return out


def extract(source: str | None, templates=frozenset()) -> str:
    """The main text of one page, given its host's templates."""
    return "\n\n".join(blocks(parse(source), templates))


def _counted(batches):
    for batch in batches:
        contents, hashes = [], []
        for source in batch.column(2).to_pylist():
            content, own = _candidates(parse(source))
            contents.append(content)
            hashes.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(contents, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["page", "host", "content", "hashes"])


def _extracted(batches):
    for batch in batches:
        texts = [extract(source, frozenset(own or ())) for source, own in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["k", "url", "text"])


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract(F.col(url), HOST, 1), F.lit(""))))


def _page_number():
    return F.xxhash64("k", "url", "html")


def subtrees(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page (a hash of the row), host, content (a hash of the text without templates) and hashes (of its subtrees)."""
    own = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    own = with_host(own).select(_page_number().alias("page"), "host", "html")
    return own.mapInArrow(_counted, "page long, host string, content long, hashes array<long>")


def site_templates(found: DataFrame, recurs: int = RECURS) -> DataFrame:
    """host and h of the subtrees that stand in `recurs` pages of the host that differ in their articles."""
    seen = found.select("host", "content", F.explode("hashes").alias("h")).distinct()
    return seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= recurs).select("host", "h")


def page_templates(found: DataFrame, recurs: int = RECURS) -> DataFrame:
    """page and templates (the hashes of its subtrees that are templates of its host), for pages that have any."""
    known = site_templates(found, recurs).select(F.xxhash64("host", "h").alias("hh"), F.col("h").alias("t"), F.col("host").alias("th"))
    # Host and hash are one key, which a hot host's menu may hold many of.
    each = found.select("page", "host", F.explode("hashes").alias("h")).withColumn("hh", F.xxhash64("host", "h"))
    met = spread_join(each, written(known, "site-templates"), "hh", "inner").filter((F.col("h") == F.col("t")) & (F.col("host") == F.col("th")))
    return met.groupBy("page").agg(F.array_sort(F.collect_set("h")).alias("templates"))  # at most a page's subtrees


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", recurs: int = RECURS) -> DataFrame:
    """key, url and text of every page."""
    found = written(subtrees(pages, key, url, html), "subtrees")
    templates = written(page_templates(found, recurs), "page-templates")
    own = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).withColumn("page", _page_number())
    held = spread_join(own, templates, "page").select("k", "url", "html", "templates")
    kind = held.schema["k"].dataType.simpleString()
    return held.mapInArrow(_extracted, f"k {kind}, url string, text string").select(F.col("k").alias(key), F.col("url").alias(url), "text")


def op6_html(spark, sf_dir: str) -> DataFrame:
    text = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
