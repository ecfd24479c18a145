"""A layout tree of a page: built with implied tags, shown by rules of visibility, rendered with its spacing, lists and table cells.

Two builders give the same tree. From HTML, elements end where the next one implies their end, and elements that browsers don't show or
that are no part of the text are invisible. From rendered text, every line has a tag (by its kind), and lines imply the sections that
hold them: a label of links opens an aside, flowing text ends it, a label of comments opens a section that nothing ends, what stands
above the headline is the masthead, and what stands below the last line of flowing text is the footer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..sources import html

#: Tags of lines.
KINDS = "blank h1 h2 p li blockquote figcaption cite nav aside comments teaser".split()
BLANK, HEADLINE, HEADING, PARAGRAPH, ITEM, QUOTE, CAPTION, REFERENCE, FURNITURE, ASIDE, COMMENTS, TEASER = range(len(KINDS))
#: Flowing text, which an aside can't hold.
FLOW = {PARAGRAPH, ITEM, QUOTE, CAPTION, REFERENCE}
#: Words of a quotation that may still stand in an aside.
SHORT_QUOTE = 12


class Section:
    """``parts`` holds line numbers and sections, in order."""

    __slots__ = ("tag", "parts")

    def __init__(self, tag: str):
        self.tag, self.parts = tag, []

    def lines(self) -> Iterator[int]:
        for part in self.parts:
            if isinstance(part, Section):
                yield from part.lines()
            else:
                yield part


def built(kinds: list[int], tokens: list[int]) -> Section:
    """The tree of lines: masthead, article (with its asides and comments) and footer; without a paragraph all is masthead."""
    page, masthead, article, footer = (Section(t) for t in ("page", "masthead", "article", "footer"))
    page.parts = [masthead, article, footer]
    first = next((k for k, kind in enumerate(kinds) if kind == PARAGRAPH), None)
    if first is None:
        masthead.parts = list(range(len(kinds)))
        return page
    top = next((k for k, kind in enumerate(kinds[:first]) if kind == HEADLINE), None)
    if top is None:
        top = next((k for k in range(first - 1, -1, -1) if kinds[k] == HEADING), first)
    masthead.parts = list(range(top))
    open_section = article
    last = top
    for k in range(top, len(kinds)):
        kind = kinds[k]
        if kind in (ASIDE, COMMENTS):
            # a menu above the text may hold the same words
            if k > first and open_section.tag != "comments":
                open_section = Section("comments" if kind == COMMENTS else "aside")
                article.parts.append(open_section)
        elif kind in FLOW and open_section.tag == "aside" and (kind != QUOTE or tokens[k] > SHORT_QUOTE):
            open_section = article
        open_section.parts.append(k)
        if open_section is article and kind in FLOW:
            last = k
    # the footer: whatever follows the last line of flowing text
    kept: list = []
    for part in article.parts:
        inside = isinstance(part, int) and part <= last
        (kept if inside or isinstance(part, Section) and part.parts and next(part.lines()) <= last else footer.parts).append(part)
    article.parts = kept
    return page


def visible(page: Section, kinds: list[int]) -> list[int]:
    """Numbers of the lines that are shown: the article's own flowing text, its headline, and subheadings that head some of it."""
    article = page.parts[1]
    if not article.parts:
        return []
    solid = [k for k, kind in enumerate(kinds) if kind not in (BLANK, FURNITURE)]
    place = {k: n for n, k in enumerate(solid)}
    shown = []
    for k in article.parts:
        if isinstance(k, Section):
            continue
        kind = kinds[k]
        if kind in FLOW or kind == HEADLINE or (kind == HEADING and not shown):
            shown.append(k)
        elif kind == HEADING:
            n = place[k]
            after = kinds[solid[n + 1]] if n + 1 < len(solid) else BLANK
            ahead = kinds[solid[n - 1]] if n else BLANK
            # a subheading stands alone above what it heads; headlines in a row are links
            linked = after in (TEASER, ASIDE, COMMENTS, BLANK) or ahead in (TEASER, ASIDE) or (after == HEADING and ahead == HEADING)
            if not linked:
                shown.append(k)
    return shown


# ---- rendering ----------------------------------------------------------------------------------------------------------------
def aligned(rows: list[list[str]]) -> list[str]:
    """Rows of cells as lines, cells padded to the widest of their column."""
    width = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
    return ["  ".join(c.ljust(width[k]) for k, c in enumerate(r)).rstrip() for r in rows]


def rendered(lines: list[str], numbers: list[int]) -> str:
    """The lines of these numbers (from 1), one blank line where one or more stood or something was left out; rows of cells between tabs are aligned."""
    out: list[str] = []
    table: list[list[str]] = []
    last = 0

    def flush() -> None:
        out.extend(aligned(table))
        table.clear()

    for n in sorted(numbers):
        line = lines[n - 1].rstrip()
        if last and n > last + 1:
            flush()
            out.append("")
        if "\t" in line:
            table.append([c.strip() for c in line.split("\t")])
        else:
            flush()
            out.append(line)
        last = n
    flush()
    return "\n".join(out)


# Elements that stand in lines of their own, and elements that are not shown.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tr ul".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
UNSEEN = set("head script style noscript iframe template title meta link svg canvas audio video object select button input textarea".split())
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)


def shown(node: html.Node) -> bool:
    """Whether a browser shows the element."""
    return node.tag not in UNSEEN and "hidden" not in node.attrs and node.attrs.get("aria-hidden") != "true" and _HIDDEN.search(node.attrs.get("style", "")) is None


def page_text(source: str | None) -> str:
    """All visible text of an HTML page: blocks in lines of their own, spaced ones after a blank line, list items with their marks, table
    cells aligned. Null and blank give an empty text."""
    if not source or not source.strip():
        return ""
    out: list[str] = [""]

    def line() -> None:
        if out[-1].strip():
            out.append("")
        else:
            out[-1] = ""

    def space() -> None:
        line()
        if len(out) > 1 and out[-2] != "":
            out.append("")

    def write(text: str) -> None:
        text = re.sub(r"\s+", " ", text)
        if not out[-1] or out[-1].endswith(" "):
            text = text.lstrip(" ")
        out[-1] += text

    # (node, what to do): a stack of its own, so that no page is nested too deep
    work: list[tuple] = [("enter", html.Tree(source).root, None)]
    while work:
        step, node, extra = work.pop()
        if step == "text":
            write(node)
        elif step == "leave":
            space() if node.tag in SPACED else line()
        elif node.tag == "table" and shown(node):
            space()
            rows = [[re.sub(r"\s+", " ", "".join(_words(c))).strip() for c in r.children if isinstance(c, html.Node) and c.tag in ("td", "th") and shown(c)] for r in node.walk() if r.tag == "tr" and shown(r)]
            for row in aligned([r for r in rows if r]):
                out[-1] = row
                out.append("")
            space()
        elif node.tag == "br":
            out.append("")
        elif node.tag == "pre" and shown(node):
            space()
            out.extend([*"".join(_words(node)).strip("\n").split("\n"), ""])
        elif shown(node):
            block = node.tag in BLOCKS
            if block:
                space() if node.tag in SPACED else line()
                work.append(("leave", node, None))
            if node.tag == "li":
                write(f"{extra}. " if extra else "- ")
            if node.tag == "img" and node.attrs.get("alt", "").strip():
                write(node.attrs["alt"])
            count = 0
            todo = []
            for child in node.children:
                if isinstance(child, str):
                    todo.append(("text", child, None))
                else:
                    count += child.tag == "li"
                    todo.append(("enter", child, count if node.tag == "ol" and child.tag == "li" else None))
            work.extend(reversed(todo))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in out)).strip("\n")


def _words(node: html.Node) -> Iterator[str]:
    work: list = [node]
    while work:
        at = work.pop()
        if isinstance(at, str):
            yield at
        elif shown(at):
            work.extend(reversed(at.children))
            if at.tag == "br":
                yield "\n"
