"""Main text of HTML pages by minimum-cut labelling.

A page's text blocks are nodes. A classifier's log-odds of content are their terminal capacities: evidence of the elements
around a block (fixed weights) and of its text (length, link share, kind, sentence mark), whose weights are learned from
the pages themselves, blocks in elements of plain meaning being the labels. Neighbours in the page and blocks near each
other in the document tree are joined by smoothness edges, by way of a node for each container. The maximum flow then
separates content from boilerplate.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.blocks import Page, read
from parlance.llm.mincut import labelled
from parlance.llm.shared import map_rows, slices, whole_text

#: Log-odds of elements by tag, and of what elements are named.
TAGS = {
    "nav": -5.0, "footer": -5.0, "aside": -4.0, "form": -4.0, "dialog": -5.0, "menu": -4.0, "fieldset": -3.0, "search": -4.0, "header": -4.0, "address": -1.0,
    "article": 4.0, "main": 2.5, "h1": 1.5,
}
ROLES = {
    "navigation": -5.0, "banner": -4.0, "contentinfo": -5.0, "complementary": -4.0, "search": -4.0, "alert": -4.0, "alertdialog": -5.0, "dialog": -5.0,
    "form": -4.0, "menu": -4.0, "menubar": -4.0, "toolbar": -4.0, "status": -3.0, "article": 4.0, "main": 2.5,
}
BOILERPLATE_NAME = re.compile(
    r"(?:^|[^a-z])(?:ads?|adv|advert\w*|adsense|ad(?:slot|box|unit|block|wrap\w*|container)|alerts?|announce\w*|banners?|bottombar|breadcrumbs?|comments?|commentlist|"
    r"commenters?|consent|cookies?|copyright|dialog|disclaimers?|discuss\w*|disqus|donat\w*|feedback|footers?|footnav|forms?|gdpr|legal|login|masthead|"
    r"menus?|menubar|modal|nav(?:bar|igation|s|menu|list|links)?|newsletters?|notices?|notifications?|outbrain|overlay|pager|paginat\w*|paywall|popups?|popular|privacy|promo\w*|"
    r"recirc\w*|recommend\w*|register|related|replies|reply|respond|responses|search\w*|shar(?:e|ing)\w*|sidebars?|signin|signup|"
    r"skip\w*|skyscraper|social\w*|sponsor\w*|subscri\w*|taboola|teasers?|toc|toolbars?|topbar|tracking|trending|warnings?|widgets?)(?![a-z])"
)
HEADER_NAME = re.compile(r"(?:^|[^a-z])(?:headers?|masthead)(?![a-z])")
CONTENT_NAME = re.compile(r"(?:^|[^a-z])(?:articles?|articlebody|body|content|entry|main|markdown|posts?|prose|story|text)(?![a-z])")
COMMENT_NAME = re.compile(r"(?:^|[^a-z])(?:comments?(?!-(?:open|closed|enabled|on|off))|commentlist|disqus|discuss\w*|replies|responses)(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Words of short blocks that aren't part of an article, unless an article element holds them.
FORMULA_CHARS = 300
FORMULA = re.compile(
    r"^(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b|\b(?:accept|uses?) (?:all )?cookies\b|\bcookie policy\b|\bprivacy policy\b|\bterms of (?:use|service)\b|^advertisement\b|^sponsored\b|"
    r"\bsubscribe to our\b|^(?:sign|log) (?:in|up)\b|^(?:share this|related articles|leave a (?:comment|reply)|skip to (?:main )?content)\b",
    re.IGNORECASE,
)
#: What outer evidence still counts beside an element's own, and what evidence for content counts within strong boilerplate.
OUTER, WITHIN_BOILERPLATE, STRONG = 0.25, 0.1, -3.0

#: Values of the features of a block's text, with the log-odds they start from.
WORDS = {2: -0.5, 5: -0.3, 10: 0.0, 20: 0.6, 50: 1.0, math.inf: 1.3}
LINKS = {0.0: 0.3, 0.25: 0.1, 0.6: -0.8, 1.0: -1.5}
KINDS = {"p": 0.6, "li": 0.0, "heading": 0.3, "cell": 0.0, "other": -0.3}
MARKS = {True: 0.4, False: -0.1}
PRIOR = [*WORDS.values(), *LINKS.values(), *KINDS.values(), *MARKS.values()]
#: Blocks that the starting log-odds count for, and the bound of a learned one.
PRIOR_BLOCKS, MOST_TEXT = 1000, 1.5
KIND_OF = {"p": "p", "blockquote": "p", "pre": "p", "figcaption": "p", "li": "li", "dd": "li", "dt": "li", "td": "cell", "th": "cell"} | {f"h{i}": "heading" for i in range(1, 7)}

#: Smoothness: between neighbours of one container, within one region, across regions; block and container, container and the one around it.
SAME, NEAR, ACROSS, TO_CONTAINER, TO_OUTER = 0.8, 0.4, 0.05, 0.4, 0.2
#: Capacities are whole numbers of this many to one.
UNIT = 1000


def named(attributes: dict[str, str]) -> str:
    """Class, id and property names in lower case, their parts apart."""
    told = " ".join(attributes[k] for k in ("class", "id", "itemprop") if attributes.get(k))
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "-", told).lower() if told else ""


def stands_alone(attributes: dict[str, str]) -> bool:
    """Whether an inline element is boilerplate by its name, or hidden, so that its text is a block of its own."""
    return bool(attributes) and (hidden(attributes) or attributes.get("role", "").lower() in ROLES or bool(BOILERPLATE_NAME.search(named(attributes))))


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(attributes.get("style", "")))


def evidence(page: Page) -> tuple[list[float], list[int], list[int]]:
    """By element: its log-odds; the innermost element with evidence of its own; its plain label (1 content, -1 boilerplate, 0 untold)."""
    n = len(page.tag)
    size = [0] * n
    for e, text in zip(page.element, page.text):
        size[e] += len(text)
    for e in range(n - 1, 0, -1):
        size[page.parent[e]] += size[e]
    names = [named(a) for a in page.attributes]
    article = [t == "article" or a.get("role", "").lower() == "article" for t, a in zip(page.tag, page.attributes)]
    titled = [t == "h1" for t in page.tag]
    for e in range(n - 1, 0, -1):
        titled[page.parent[e]] |= titled[e]
    shut = [False] * n  # no place for the page's own article
    best = -1
    for e in range(1, n):
        shut[e] = shut[page.parent[e]] or page.tag[e] in ("nav", "footer", "aside") or (bool(COMMENT_NAME.search(names[e])) and not titled[e])
        wanted = article[e] or page.tag[e] == "main"
        if wanted and not shut[e] and (best < 0 or (article[e], size[e]) > (article[best], size[best])):
            best = e
    around = set()  # what holds the page's own article isn't boilerplate, whatever its name
    e = best
    while e > 0:
        around.add(e)
        e = page.parent[e]
    odds, region, plain, inside, strong = [0.0] * n, [0] * n, [0] * n, [False] * n, [False] * n
    for e in range(1, n):
        p, tag, own = page.parent[e], page.tag[e], page.attributes[e]
        inside[e] = inside[p] or (article[e] and not strong[p])
        w = TAGS.get(tag, 0.0)
        if inside[e] and (tag == "header" or HEADER_NAME.search(names[e])):
            w = -1.0
        elif tag != "header" and HEADER_NAME.search(names[e]):
            w -= 4.0
        if own:
            w += ROLES.get(own.get("role", "").lower(), 0.0)
            if names[e] and tag not in ("html", "body"):
                if BOILERPLATE_NAME.search(names[e]):
                    w -= 4.0
                elif CONTENT_NAME.search(names[e]):
                    w += 2.5
            if hidden(own):
                w -= 5.0
        if w < 0 and (e in around or (tag == "form" and 2 * size[e] > size[0])):
            w = max(TAGS.get(tag, 0.0), 0.0)
        w = max(-5.0, min(5.0, w))
        odds[e], region[e], strong[e], plain[e] = odds[p], region[p], strong[p], plain[p]
        if w < 0:
            odds[e], region[e], strong[e], plain[e] = min(odds[p], OUTER * odds[p] + w), e, strong[p] or w <= STRONG, -1 if w <= STRONG else plain[p]
        elif w > 0 and strong[p]:
            odds[e] = odds[p] + WITHIN_BOILERPLATE * w
        elif w > 0:
            odds[e], region[e] = max(odds[p], OUTER * odds[p] + w), e if tag != "h1" else region[p]
            plain[e] = 1 if w >= 4.0 and plain[p] >= 0 else plain[p]
    return odds, region, plain


def features(page: Page) -> list[tuple[int, int, int, int]]:
    """By block: the places in PRIOR of its length, link share, kind and last mark."""
    kinds, out = list(KINDS), []
    for e, text, linked in zip(page.element, page.text, page.linked):
        words, share = text.count(" ") + 1, linked / len(text)
        a = next(i for i, most in enumerate(WORDS) if words <= most)
        b = next((i for i, most in enumerate(LINKS) if share <= most), len(LINKS) - 1)
        c = kinds.index(KIND_OF.get(page.tag[e], "other"))
        d = 0 if text.rstrip("\"'”’»)")[-1:] in tuple(".!?…:;") else 1
        out.append((a, len(WORDS) + b, len(WORDS) + len(LINKS) + c, len(WORDS) + len(LINKS) + len(KINDS) + d))
    return out


def graph(page: Page, weights: list[float]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The gain of each node, blocks first, then containers; and the smoothness edges."""
    odds, region, _ = evidence(page)
    n = len(page.text)
    gain = []
    for e, text, at in zip(page.element, page.text, features(page)):
        own = sum(weights[i] for i in at)
        gain.append(round(UNIT * (odds[e] + max(-2.0, min(2.0, own)) - (3.0 if odds[e] < TAGS["article"] and len(text) <= FORMULA_CHARS and FORMULA.search(text) else 0.0))))
    holder = [page.parent[e] for e in page.element]
    edges = []
    for i in range(n - 1):
        a, b = page.element[i], page.element[i + 1]
        w = ACROSS if region[a] != region[b] else SAME if holder[i] == holder[i + 1] else NEAR
        edges.append((i, i + 1, round(UNIT * w)))
    node: dict[int, int] = {}
    todo = []
    for i, e in enumerate(holder):
        if e not in node:
            node[e] = n + len(node)
            todo.append(e)
        edges.append((i, node[e], round(UNIT * (TO_CONTAINER if region[page.element[i]] == region[e] else ACROSS))))
    while todo:
        e = todo.pop()
        if e:
            p = page.parent[e]
            if p not in node:
                node[p] = n + len(node)
                todo.append(p)
            edges.append((node[e], node[p], round(UNIT * (TO_OUTER if region[e] == region[p] else ACROSS))))
    return gain + [0] * len(node), edges


def main_text(html: str, weights: list[float] = PRIOR) -> tuple[str, int, int]:
    """The content blocks of a page joined by newlines, their number and that of all blocks."""
    page = read(html, stands_alone)
    kept = labelled(*graph(page, weights))
    text = [t for t, k in zip(page.text, kept) if k]
    return "\n".join(text), len(text), len(page.text)


def learned(pages: DataFrame, html_column: str = "html") -> list[float]:
    """Log-odds of the values in PRIOR, from all blocks of ``pages`` that stand in elements of plain meaning.

    Each task counts its blocks by value and label; a few dozen sums reach the driver. A value's learned log-odds weigh as
    many blocks as it was seen in, beside PRIOR_BLOCKS for the starting ones; with one label alone nothing is learned.
    """
    size = len(PRIOR)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0] * (2 * size)
        for batch in slices(batches):
            for html in batch.column(0).to_pylist():
                page = read(html, stands_alone)
                plain = evidence(page)[2]
                for e, at in zip(page.element, features(page)):
                    if plain[e]:
                        for i in at:
                            seen[i + size * (plain[e] < 0)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * size), pa.int64()), pa.array(seen, pa.int64())], names=["at", "n"])

    sums = pages.select(whole_text(html_column)).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    seen = {r["at"]: r["n"] for r in sums.collect()}
    out, first = [], 0
    for values in (WORDS, LINKS, KINDS, MARKS):
        at = range(first, first + len(values))
        first += len(values)
        good, bad = sum(seen.get(i, 0) for i in at), sum(seen.get(i + size, 0) for i in at)
        for i in at:
            a, b = seen.get(i, 0), seen.get(i + size, 0)
            found = math.log((a + 1) / (good + len(values))) - math.log((b + 1) / (bad + len(values)))
            share = (a + b) / (a + b + PRIOR_BLOCKS) if good and bad else 0.0
            out.append(max(-MOST_TEXT, min(MOST_TEXT, share * found + (1 - share) * PRIOR[i])))
    return out


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", weights: list[float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_kept and n_blocks of each row, from its whole html.

    Null and empty html gives an empty text, and so does a page without content. White space within a block is one space,
    ``br`` too. Cut-off and malformed mark-up is read as far as it goes; a lone ``<`` is text. Repeated rows and ids, and null
    ids or urls, each have their row. Other columns are ignored. ``weights`` are those of :func:`learned`, by default of
    ``pages`` themselves, which are read a second time then.
    """
    weights = learned(pages, html_column) if weights is None else weights

    def scan(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for ids, urls, htmls in batches:
            told = [main_text(h, weights) for h in htmls]
            yield [(i, u, t, len(t), k, n) for i, u, (t, k, n) in zip(ids, urls, told)]

    slim = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), whole_text(html_column).alias("html"))
    return map_rows(slim, scan, "page_id long, url string, text string, n_chars long, n_kept long, n_blocks long")
