"""Main content of HTML pages.

A small tree is built with the standard library's tokenizer (void elements, implied ends of paragraphs and list items, raw text of
scripts and styles). The title is taken first, then the date, then scripts go, a container is chosen, noise inside it goes, and what
text is left is returned with the texts of images.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Containers in the order tried; elements, roles and classes that are no content; places of a date.
CONTAINERS = ["article", "[role=main]", "main", ".article-content", ".post-content", ".entry-content", ".article", ".post", ".entry", ".content"]
STRIPPED = {"script", "style", "noscript", "iframe", "template"}
NOISE_TAGS = {"nav", "header", "footer", "aside", "script", "style", "noscript", "iframe", "template"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary"}
NOISE_CLASSES = set(
    "nav navigation navbar nav-menu site-nav global-nav primary-nav secondary-nav footer-nav menu dropdown sub-menu submenu breadcrumb breadcrumbs pagination drawer offcanvas skip-link back-to-top scroll-to-top "
    "site-header site-footer global-footer sidebar aside ad advertisement ad-banner ad-slot ad-container ad-wrapper banner cookie-banner consent-banner cookie-notice cookie-consent promo promotion sponsored donate paywall overlay interstitial outbrain taboola recirc "
    "signup sign-up email-capture lead-capture modal popup notification tooltip lightbox age-gate share social social-share newsletter subscribe subscription widget comments comment related recommended related-posts "
    "author-bio post-meta entry-meta reading-time word-count byline dateline syndication toc table-of-contents disclaimer legal legal-notice copyright privacy privacy-policy terms terms-of-service carousel slider sr-only visually-hidden".split()
)
DATE_METAS = [("property", "article:published_time"), ("name", "pubdate"), ("name", "publishdate"), ("name", "date"), ("itemprop", "datePublished"), ("name", "DC.date.issued"), ("name", "citation_date")]
DATE_CLASSES = ["date", "published", "post-date", "entry-date", "article-date"]
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these kinds.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
RESULT = T.StructType([T.StructField("success", T.BooleanType()), *[T.StructField(n, T.StringType()) for n in ("content", "title", "publish_date", "error_code", "redirect_url")]])


_SPACES = re.compile("[\\t\\n\\v\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        """Elements below this one, in document order; pages may be nested as deep as they like."""
        work = [iter(self.children)]
        while work:
            child = next(work[-1], None)
            if child is None:
                work.pop()
            elif isinstance(child, Node):
                yield child
                work.append(iter(child.children))

    def text(self) -> str:
        out, work = [], [self]
        while work:
            at = work.pop()
            if isinstance(at, str):
                out.append(at)
            else:
                work.extend(reversed(at.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent:
            self.parent.children.remove(self)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body", "head"):
            self.root.attrs.update({k: v or "" for k, v in attrs} if tag == "html" else {})
            if tag != "html":
                self.at = Node(tag, {k: v or "" for k, v in attrs}, self.root)
                self.root.children.append(self.at)
            return
        ended = IMPLIED.get(tag, set())
        if self.at.tag in ended:
            self.at = self.at.parent
        if tag in CLOSES_P and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _select(root: Node, selector: str) -> Node | None:
    if selector[0] == ".":
        return next((n for n in root.walk() if selector[1:] in n.classes()), None)
    if selector[0] == "[":
        name, value = selector[1:-1].split("=")
        return next((n for n in root.walk() if n.attrs.get(name) == value), None)
    return next((n for n in root.walk() if n.tag == selector), None)


def _meta(root: Node, name: str, value: str) -> str | None:
    return next((n.attrs.get("content") for n in root.walk() if n.tag == "meta" and n.attrs.get(name) == value and n.attrs.get("content")), None)


def _noise(n: Node) -> bool:
    return (
        n.tag in NOISE_TAGS
        or n.attrs.get("role") in NOISE_ROLES
        or "share" in n.attrs.get("aria-label", "").lower()
        or "aria-hidden" in n.attrs
        or "hidden" in n.attrs
        or any(c in NOISE_CLASSES or re.match(r"(?:ad|sponsor)[-_]", c) for c in n.classes())
        or re.search(r"\bad\b|\bsponsor\b", n.attrs.get("id", "").lower(), re.ASCII) is not None
    )


def extract(html: str | None, least: int = 100) -> dict:
    """The page's result; ``error_code`` is EMPTY_HTML, META_REFRESH, REQUIRES_JS or CONTENT_TOO_SHORT where there is no content."""
    out = dict.fromkeys(("content", "title", "publish_date", "error_code", "redirect_url")) | {"success": False}
    if not html or not html.strip():
        return out | {"error_code": "EMPTY_HTML"}
    root = Tree(html).root
    for n in root.walk():
        if n.tag == "meta" and n.attrs.get("http-equiv", "").lower() == "refresh":
            if m := re.search(r"url\s*=\s*[\"']?(.+?)[\"']?\s*$", n.attrs.get("content", ""), re.IGNORECASE):
                return out | {"error_code": "META_REFRESH", "redirect_url": m[1]}
            break
    first = lambda tag: next((n.text().strip() for n in root.walk() if n.tag == tag), "")
    title = first("h1") or (_meta(root, "property", "og:title") or "").strip() or (_meta(root, "name", "twitter:title") or "").strip() or re.sub(r"\s+", " ", first("title"))
    date = next((found.strip() for k, v in DATE_METAS if (found := _meta(root, k, v))), None)
    if date is None:
        timed = next((n for n in root.walk() if n.tag == "time" and "datetime" in n.attrs), None)
        marked = next((n for c in DATE_CLASSES if (n := _select(root, "." + c)) and n.text()), None)
        date = timed.attrs["datetime"].strip() if timed else marked.text().strip() if marked else ""
    for n in [n for n in root.walk() if n.tag in STRIPPED]:
        n.remove()
    body = next((n for n in root.children if isinstance(n, Node) and n.tag == "body"), root)
    container = next((n for s in CONTAINERS if (n := _select(root, s)) and len(n.text().strip()) >= least), body)
    for n in [n for n in container.walk() if _noise(n)]:
        n.remove()
    alts = [f"[图] {n.attrs['alt'].strip()}" for n in container.walk() if n.tag == "img" and n.attrs.get("alt", "").strip()]
    text = container.text() + ("\n\n【配图说明】\n" + "\n".join(alts) if alts else "")
    text = _SPACES.sub(" ", text).strip(" ")
    size = len(text) + sum(c > "\uffff" for c in text)  # in UTF-16 units
    if size < 50 and sum(1 for _ in container.walk()) < 20:
        return out | {"title": title, "error_code": "REQUIRES_JS"}
    if size < least:
        return out | {"title": title, "error_code": "CONTENT_TOO_SHORT"}
    return out | {"success": True, "content": text, "title": title, "publish_date": date}


@F.pandas_udf(RESULT)
def extracted(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(p) for p in pages], columns=RESULT.names)


def extract_pages(pages: DataFrame, html: str) -> DataFrame:
    """Pages with their ``read`` result; blank ones are settled without the parser."""
    return pages.withColumn("read", extracted(F.col(html)))


def reader_text(text: str) -> tuple[str, str]:
    """(title, body) of a rendering proxy's answer: a first-level heading, or a title line before a rule."""
    text = text.strip()
    if m := re.match(r"#\s+(.+)", text):
        return m[1].strip(), text.partition("\n")[2].strip()
    parts = re.split(r"\n[-*]{3,}\n", text)
    if re.match(r"Title:\s*", text, re.IGNORECASE) and len(parts) > 1:
        return re.sub(r"^Title:\s*", "", parts[0], flags=re.IGNORECASE).strip(), "\n".join(parts[1:]).strip()
    return "", text
