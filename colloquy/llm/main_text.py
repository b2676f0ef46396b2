"""Main text of web pages by line-block distribution.

A page's markup is stripped to lines, one for each block element with text; page
furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments)
leaves one empty line each, and links in a line count nothing. Text lengths are
summed over a sliding window of lines. Lines between two places where the sum dives
to zero are kept, from the first with text to the last, if the sum surges above a
threshold in them, wherever on the page they are.
What a page marks as its article (article or main elements) is kept besides, from
end to end, if it has any text outside links; so short lines are not lost there.

Lines are joined by one blank, white space in a line is one blank, character
references are decoded. Pages are handled row by row, without a shuffle.

Defined results: a null or empty page, and one without text, gives an empty text;
unclosed elements and tags cut off by the page's end end there; rows that repeat
are each extracted; columns other than those asked for are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe svg math object head title canvas audio video textarea select"
FURNITURE = frozenset("nav header footer aside form menu button dialog fieldset label legend input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class and id names that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices "
    "notification popup modal overlay comment comments disqus replies share sharing social related recommended "
    "newsletter subscribe signup login search widget toolbar pagination pager copyright".split()
)
NEGATIONS = frozenset("no not has with without".split())
CONTAINERS = frozenset(("article", "main"))
# Never furniture, whatever their class says; they also end furniture left open before them.
FRAMES = frozenset(("html", "body", "article", "main"))
# Elements that the next of their kind ends.
IMPLIED = frozenset("p li dd dt td th tr option".split())

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)", re.S)
_RAW = re.compile(rf"<({'|'.join(RAW.split())})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][^\s/><]*)[^<>]*(?:>|(?=<)|\Z)""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_WORD = re.compile(r"[a-z0-9]+")

WINDOW = 3
SURGE = 60


@dataclass
class Line:
    text: str
    container: int  # 0 outside any
    plain: int  # characters outside links


def is_furniture(name: str, attributes: str) -> bool:
    if name in FRAMES:
        return False
    if name in FURNITURE:
        return True
    if not attributes or attributes.isspace():
        return False
    for key, value in _NAMED.findall(attributes):
        value = value.strip("\"'").lower()
        if key.lower() == "role":
            if value in ROLES:
                return True
            continue
        for mark in value.split():
            words = _WORD.findall(mark)
            if not NEGATIONS.intersection(words) and MARKS.intersection(words):
                return True
    return bool(_HIDDEN.search(attributes))


def lines_of(page: str) -> list[Line]:
    """The page's lines with text in order; furniture leaves empty ones."""
    page = _RAW.sub("\n", _COMMENT.sub("", page))
    lines: list[Line] = []
    parts: list[str] = []
    plain = links = container = containers = 0
    open_containers: list[int] = []
    dropped, depth = "", 0  # the furniture element inside which the scan is

    def end_line():
        nonlocal parts, plain
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, container, plain))
        parts, plain = [], 0

    def add(text):
        nonlocal plain
        if not dropped and text:
            parts.append(text)
            if not links:
                plain += len(text.strip())

    at = 0
    for tag in _TAG.finditer(page):
        add(page[at : tag.start()])
        at = tag.end()
        closing, name = tag[1] or tag[4], (tag[2] or tag[5]).lower()
        attributes = tag[3] or ""
        if dropped:
            over = name in FRAMES or (
                not closing and depth == 1 and dropped in IMPLIED and (name == dropped or (dropped == "p" and name in BLOCKS and name != "br"))
            )
            if not over:
                if name == dropped and name not in VOID:
                    depth += -1 if closing else 1
                    if depth == 0:
                        dropped = ""
                continue
            dropped = ""
        if name == "a":
            links = 0 if closing else 1
        if name not in BLOCKS:
            if not closing and name not in VOID and is_furniture(name, attributes):
                dropped, depth = name, 1
            continue
        end_line()
        links = 0
        if name in CONTAINERS:
            # Containers in a container are part of it.
            if not closing:
                if not open_containers:
                    containers += 1
                open_containers.append(containers)
            elif open_containers:
                open_containers.pop()
            container = open_containers[-1] if open_containers else 0
        elif not closing and name not in VOID and is_furniture(name, attributes):
            lines.append(Line("", container, 0))
            dropped, depth = name, 1
    add(page[at:] if not _cut_off(page, at) else page[at : page.rfind("<")])
    end_line()
    return lines


def _cut_off(page: str, at: int) -> bool:
    """Whether the text after the last tag ends in the beginning of another."""
    place = page.rfind("<", at)
    return place >= 0 and re.fullmatch(r"</?(?:[a-zA-Z][^<>]*)?", page[place:], re.S) is not None


def kept_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[Line]:
    """The lines between dives if there is a surge, and all lines of articles with text."""
    n = len(lines)
    plain = np.array([x.plain for x in lines] + [0] * window, np.int64)
    sums = np.convolve(plain, np.ones(window, np.int64))[window - 1 : window - 1 + n]
    keep = np.zeros(n, bool)
    containers = np.array([x.container for x in lines], np.int64)
    # Runs of lines with text, between which a window sum is zero.
    texts = np.flatnonzero(plain)
    for run in np.split(texts, np.flatnonzero(np.diff(texts) > window) + 1):
        if len(run) and sums[run].max() >= surge:
            keep[run[0] : run[-1] + 1] = True
    # What the page marks is text however short it is, unless it is links alone.
    sizes = np.bincount(containers, weights=plain[:n], minlength=1)
    sizes[0] = 0
    keep |= sizes[containers] > 0
    if not keep.any():
        keep = plain[:n] > 0
    return [line for line, k in zip(lines, keep) if k and line.text]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    if not page:
        return ""
    return " ".join(line.text for line in kept_lines(lines_of(page), window, surge))


def extract(
    pages: DataFrame,
    *,
    keep: tuple[str, ...] = ("page_id", "url"),
    markup: str = "html",
    text: str = "text",
    n_chars: str = "n_chars",
    window: int = WINDOW,
    surge: int = SURGE,
) -> DataFrame:
    """The kept columns, the main text and its length in code points."""
    rows = pages.select(*keep, pages[markup].alias("_markup"))
    schema = T.StructType(
        [*rows.schema.fields[: len(keep)], T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())]
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page.as_py(), window, surge) for page in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                schema.names,
            )

    return rows.mapInArrow(run, schema)
