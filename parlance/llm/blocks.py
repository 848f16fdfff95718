"""Text blocks of an HTML page, with the elements they stand in. Linear in the page, whatever its mark-up."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

#: Elements that stand within a line of text; all others, unknown ones too, bound blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output picture progress q rp rt "
    "ruby s samp small source span strike strong sub sup time tt track u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is read up to their end tag, and isn't text of the page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
#: Elements whose text isn't text of the page either, though it has mark-up.
SILENT = frozenset("head button select svg canvas object audio video map datalist math".split())
#: Blocks that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main "
    "menu nav ol p pre search section summary table ul".split()
)
#: Elements that end an open one of the same kind, up to the elements given.
ENDS_OWN = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "body": (("head",), ()),
}
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
KEPT = frozenset(("class", "id", "role", "itemprop", "hidden", "aria-hidden", "style"))
END_OF = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


@dataclass
class Page:
    """Elements, parents before children (0 is the page itself), and blocks: element, text and characters of link text."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    attributes: list[dict[str, str]] = field(default_factory=lambda: [{}])
    element: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def decoded(text: str) -> str:
    """``text`` with its character references decoded."""
    if "&" not in text:
        return text
    try:
        return entities.unescape(text)
    except ValueError:  # a number of thousands of digits
        return entities.unescape(re.sub(r"&#[0-9]{8,}", "&#99999999", re.sub(r"&#0+(?=[0-9])", "&#", text)))


def attributes_of(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes in KEPT of a start tag, from the end of its name, and the place after the tag."""
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(html, at)
        if not m:
            end = html.find(">", at)
            return found, len(html) if end < 0 else end + 1
        name = m[1].lower()
        if name in KEPT and name not in found:
            value = m[2] or ""
            found[name] = decoded(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value)
        at = m.end()


def read(html: str, stands_alone) -> Page:
    """The page's blocks. ``stands_alone(attributes)`` tells inline elements that are to bound blocks too."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0
    link_at = 0  # depth at which a link was opened; 0: none
    silent = 0
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.element.append(stack[-1][1])
                page.text.append(text)
                page.linked.append(min(linked, len(text)))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal link_at, silent
        flush()
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        silent -= tag in SILENT
        if len(stack) < link_at:
            link_at = 0

    def end(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Close the innermost open one of ``tags``, unless one of ``within`` stands above it."""
        if any(open_tags.get(t) for t in tags):
            depth = len(stack) - 1
            while depth and stack[depth][0] not in tags:
                if stack[depth][0] in within:
                    return
                depth -= 1
            while depth and len(stack) > depth:
                pop()

    while at < n:
        mark = html.find("<", at)
        stop = n if mark < 0 else mark
        if stop > at and not silent:
            text = decoded(html[at:stop])
            pieces.append(text)
            linked += len(text.strip()) if link_at else 0
        if mark < 0:
            break
        after = html[mark + 1 : mark + 2]
        if after.isascii() and after.isalpha():
            m = NAME.match(html, mark + 1)
            tag = m[0].lower()
            own, at = attributes_of(html, m.end())
            if tag in RAW:
                found = END_OF[tag].search(html, at)
                at = n if not found else found.start()
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag == "a":
                link_at = len(stack)
            if tag in INLINE and (tag in VOID or not stands_alone(own)):
                continue
            flush()
            if tag in ENDS_P:
                end(("p",), ("table", "button", "object"))
            if tag in ENDS_OWN:
                end(*ENDS_OWN[tag])
            if tag in VOID:
                continue
            page.parent.append(stack[-1][1])
            page.tag.append(tag)
            page.attributes.append(own)
            stack.append((tag, len(page.tag) - 1))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            silent += tag in SILENT
        elif after == "/":
            m = NAME.match(html, mark + 2)
            close = html.find(">", mark)
            at = n if close < 0 else close + 1
            if m:
                tag = m[0].lower()
                if tag == "a":
                    link_at = 0
                if tag not in INLINE or open_tags.get(tag):
                    flush()
                    end((tag,))
        elif html.startswith("<!--", mark):
            close = html.find("-->", mark + 2)
            at = n if close < 0 else close + 3
        elif after in ("!", "?"):
            close = html.find(">", mark)
            at = n if close < 0 else close + 1
        else:
            if not silent:
                pieces.append("<")
            at = mark + 1
    while len(stack) > 1:
        pop()
    flush()
    return page
