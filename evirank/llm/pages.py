"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block element in page order. Parts that are never article text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) become stretches of empty lines, and so does all
that lies outside article elements, where these hold at least ENOUGH of the rest; articles named as comments, adverts and the like do not count. Text lengths are summed over sliding windows of WINDOW lines; a
stretch begins where the sums surge from nothing and ends where they dive back to nothing. Stretches whose largest window reaches SURGE characters
are kept with their short lines; if none does, the one with the most text is kept.

Defined results: null or empty html gives the empty text; a page without markup is one line; broken markup never
fails; character references are decoded after the markup is read; equal pages give equal texts; extra columns are dropped.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 40
ENOUGH = 0.25  # share of the text outside unwanted elements that marks of an article must hold to be followed
OUTSIDE, ARTICLE, DOUBTFUL = range(3)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.DOTALL)
_RAW = frozenset("script style textarea title noscript template iframe svg math canvas object xmp noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _RAW}
_NEVER = frozenset("nav footer aside form select button dialog menu audio video map head datalist fieldset".split())
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr caption section article main blockquote pre figure figcaption hr address header footer nav aside form body html details summary center".split())
_SPACE = frozenset("br td th wbr img option".split())
_FRAME = frozenset("nav header footer aside".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_ROLES = re.compile(r"\brole\s*=\s*[\"']?(navigation|banner|contentinfo|complementary|search|dialog|alertdialog|alert|menu|menubar|toolbar|form)\b", re.IGNORECASE)
_NAMES = re.compile(r"(?<![\w-])(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true|(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)
#: Parts of class and id names of elements that are not article text. Fixed values.
_ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu sidebar footer breadcrumb breadcrumbs comment comments disqus "
    "respond replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "recommendations widget widgets pagination pager search toolbar masthead copyright disclaimer".split()
)
_HEADER = frozenset(("header", "topbar"))
#: Parts of names that say nothing about what an element holds. Fixed values.
_PLAIN = frozenset("box block container wrapper wrap inner outer area section unit slot bar list item top bottom left right main js is has widget content text form button buttons".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ARTICLE = re.compile(r"<(?:article|main)[\s>]|role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", re.IGNORECASE)


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in _NEVER or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes) or _ROLES.search(attributes):
        return True
    for groups in _NAMES.findall(attributes):
        if inside:  # there a name counts only if all of it says so: "ad-box" may be an advert, "related-work" is a section
            if any((own := {p.lower() for p in _PART.findall(token)}) and own <= _ASIDE | _PLAIN and own & _ASIDE for token in " ".join(groups).split()):
                return True
        elif {p.lower() for p in _PART.findall(" ".join(groups))} & (_ASIDE | _HEADER):
            return True
    return False


def _named_aside(attributes: str) -> bool:
    return any({p.lower() for p in _PART.findall(" ".join(groups))} & _ASIDE for groups in _NAMES.findall(attributes))


def lines_of(page: str) -> list[tuple[str, bool]]:
    """(raw text, wanted) of each block in page order.

    An unwanted element gives lines that are empty and not wanted: as many as a window has where it frames the page, so that every
    window falls to nothing there, else one, which a window spans.
    """
    out: list[tuple[str, int, bool]] = []  # raw text, OUTSIDE, ARTICLE or DOUBTFUL, whether it is a gap
    text: list[str] = []
    articles: list[tuple[str, bool]] = []  # open article elements and whether their names speak against them
    ends: dict[str, dict[int, int]] = {}
    endless: set[str] = set()
    last = page.rfind(">") + 1  # no tag ends after it
    at, tags = 0, _TAG.scanner(page, 0, last)

    def where() -> int:
        return (DOUBTFUL if any(d for _, d in articles) else ARTICLE) if articles else OUTSIDE

    def end_block() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            if not joined.isspace():
                out.append((joined, where(), False))

    while m := tags.search():
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing, attributes = m[1], m[3]
        if attributes.count('"') % 2 and (quote := page.find('"', at)) >= 0 and (end := page.find(">", quote)) >= 0:
            attributes += page[at - 1 : end]  # the sign stood in a quoted value
            at = end + 1
            tags = _TAG.scanner(page, at, last)
        if closing:
            if name in _BLOCK:
                end_block()
            elif name in _SPACE:
                text.append(" ")
            if any(n == name for n, _ in articles):
                while articles.pop()[0] != name:
                    pass
            continue
        if name in _RAW and not attributes.endswith("/"):
            end = None if name in endless else _RAW_END[name].search(page, at)
            if not end:
                endless.add(name)
            if end or name in ("script", "style"):
                at = end.end() if end else len(page)
                tags = _TAG.scanner(page, at, last)
            text.append(" ")
            continue
        if name not in _VOID and not attributes.endswith("/") and _unwanted(name, attributes, bool(articles)):
            if name not in ends:
                ends[name] = _element_ends(page, name)
            end = ends[name].get(m.start())
            if end is not None:
                end_block()
                out += [("", where(), True)] * (WINDOW if name in _FRAME else 1)
                at = end
                tags = _TAG.scanner(page, at, last)
                continue
        if name in _BLOCK:
            end_block()
        elif name in _SPACE:
            text.append(" ")
        if name in ("article", "main") or (attributes and _ARTICLE.search(attributes)):
            if name not in _VOID:
                articles.append((name, name == "article" and _named_aside(attributes)))
        elif any(n == name for n, _ in articles):
            articles.append((name, False))  # nested elements of the same name close first
    if at < len(page):
        text.append(page[at:])
    end_block()
    size = [0, 0, 0]
    for raw, part, _ in out:
        size[part] += len(raw) - raw.count(" ")
    if size[ARTICLE] and size[ARTICLE] >= ENOUGH * (size[ARTICLE] + size[OUTSIDE]):
        kept = (ARTICLE,)
    else:  # a teaser or comments do not stand for the page
        kept = (OUTSIDE, ARTICLE) if size[OUTSIDE] or size[ARTICLE] else (DOUBTFUL,)
    return [(raw, part in kept and not gap) for raw, part, gap in out if not (gap and kept == (ARTICLE,) and part == ARTICLE)]


def _element_ends(page: str, name: str) -> dict[int, int]:
    """Where each element of this name ends, by the place of its start tag; never closed ones are left out.

    A paragraph ends where the next begins; a footer or sidebar that is never closed ends with the page.
    """
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<(/?){re.escape(name)}(?=[\s/>])[^>]*>", page, re.IGNORECASE | re.DOTALL):
        if m[1] is None:
            continue
        if m[1]:
            if opened:
                ends[opened.pop()] = m.end()
            continue
        if name == "p" and opened:
            ends[opened.pop()] = m.start()
        opened.append(m.start())
    if name in ("footer", "aside"):
        ends |= dict.fromkeys(opened, len(page))
    return ends


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = [(" ".join(html.unescape(raw).split()) if wanted else "", wanted) for raw, wanted in lines_of(page or "")]
    spread = [*[""] * window, *(text for text, _ in lines), *[""] * window]
    length = np.fromiter(map(len, spread), np.int64, len(spread))
    total = np.concatenate([[0], np.cumsum(length)])
    sums = total[window:] - total[:-window]  # of lines i to i + window - 1
    edge = np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]]))
    rises, falls = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stretches = [(a, b + window - 1, int(sums[a:b].max()), int(length[a : b + window - 1].sum())) for a, b in zip(rises, falls, strict=True)]
    if not stretches:
        return ""
    kept = [s for s in stretches if s[2] >= surge] or [max(stretches, key=lambda s: s[3])]
    return "\n".join(x for a, b, _, _ in kept for x in spread[a:b] if x)


_SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches):
        for batch in batches:
            text = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, _SCHEMA)
