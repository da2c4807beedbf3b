"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's parser streams events; each block of text is a line with its characters and the tags seen since the
line before. A line's ratio of text to tags is weighed by where it stands: nothing inside menus, adverts, footers and the
like, more inside an article. The ratios are smoothed with a Gaussian; lines above the page's own threshold, the standard
deviation of the smoothed ratios, form clusters, and so does the highest line. The page's regions that hold a cluster are its content, and all their
lines stay, so a short paragraph between long ones is not lost.

Articles come before other regions only if they hold most of the text. Forms, articles with a mark and elements whose mark is
but a part of a compound name (`no-sidebar`) are doubtful: they count as content if they hold most of the text around them and
no article stands beside them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements whose text is never content.
OUTSIDE = frozenset(
    "aside button canvas datalist dialog footer head iframe input menu nav noscript object option script select style "
    "svg template textarea title".split()
)
REGIONS = frozenset("article main section div body td".split())
#: Words of a class, id or role that mark an element as no content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer form hidden login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices overlay pagination popup promo promoted recommended related replies search share sharing sidebar "
    "signup social sponsor sponsored subscribe teaser toolbar warning widget alert alertdialog dialog discussion respond".split()
)
#: How much more a line inside an article counts, and the standard deviation of the smoothing in lines.
ARTICLE_WEIGHT, SMOOTHING = 4.0, 1.0
_PARTS = re.compile(r"[a-z]+")


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """2: no content. 1: doubtful. 0: no mark. A name all of marks (`nav`, `cookie-notice`) is sure, one with a mark is not."""
    found = int(tag == "form")
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 2
        if name in ("class", "id", "role") and value and tag not in ("html", "body"):
            for token in value.lower().split():
                parts = _PARTS.findall(token)
                if parts and MARKS.issuperset(parts):
                    found = 1 if tag in ("article", "main") else 2
                elif not MARKS.isdisjoint(parts):
                    found = max(found, 1)
                if found == 2:
                    return 2
    return found


class _Lines(HTMLParser):
    """Collects lines (text, tags, region, weight, doubtful element) of one page, and each doubtful element's outer one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, float, int]] = []
        self.outer: list[int] = [0]  # element 0 is the page
        self._text: list[str] = []
        self._tags = 0
        self._stack: list[tuple[str, int, float, int]] = [("", 0, 1.0, 0)]  # tag, region, weight, doubtful element
        self._regions = 0

    def _flush(self) -> None:
        if self._text:
            if text := " ".join("".join(self._text).split()):
                _, region, weight, doubt = self._stack[-1]
                self.lines.append((text, self._tags, region, weight, doubt))
                self._tags = 0
            self._text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
            self._end_implied(tag)
        elif tag == "br":
            self._text.append(" ")
        self._tags += 1
        if tag in VOID:
            return
        _, region, weight, doubt = self._stack[-1]
        mark = _marked(tag, attrs)
        if mark == 1 and weight:
            self._flush()
            self.outer.append(doubt)
            doubt = len(self.outer) - 1
        if tag in OUTSIDE or (tag == "header" and weight <= 1) or mark == 2:
            if tag not in BLOCKS and weight:
                self._flush()
            weight = 0.0
        elif tag in ("article", "main"):
            self._regions += 1
            region, weight = -self._regions if weight else region, weight and ARTICLE_WEIGHT
        elif (tag in REGIONS or mark == 1) and region >= 0:
            self._regions += 1
            region = self._regions
        self._stack.append((tag, region, weight, doubt))

    def _end_implied(self, tag: str) -> None:
        """A block ends an open paragraph, an item ends the item before."""
        for k in range(len(self._stack) - 1, 0, -1):
            own = self._stack[k][0]
            if own == "p" or (own == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th")):
                del self._stack[k:]
                return
            if own in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                if tag in BLOCKS or self._stack[k][2:] != self._stack[k - 1][2:]:
                    self._flush()
                del self._stack[k:]
                break
        else:
            if tag in BLOCKS:
                self._flush()
        self._tags += 1

    def handle_data(self, data: str) -> None:
        self._text.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def smoothed(values: np.ndarray, sigma: float = SMOOTHING) -> np.ndarray:
    """Gaussian average over neighbouring lines; at the ends, over those that there are."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(values) / full(np.ones(len(values)))


def _without_doubt(lines: list[tuple[str, int, int, float, int]], outer: list[int]) -> list[tuple[str, int, int, float]]:
    """Lines (text, tags, region, weight); those of doubtful elements that are no content have weight 0."""
    if len(outer) == 1:
        return [line[:4] for line in lines]
    size, article = [0] * len(outer), [0] * len(outer)
    for text, _, region, weight, k in lines:
        if weight:
            size[k] += len(text)
            article[k] += len(text) if region < 0 else 0
    for k in range(len(outer) - 1, 0, -1):  # an outer element comes before those in it
        size[outer[k]] += size[k]
        article[outer[k]] += article[k]
    fine = [True] * len(outer)
    for k in range(1, len(outer)):
        own = 2 * size[k] > size[outer[k]] and article[outer[k]] == article[k]
        fine[k] = fine[outer[k]] and own
    return [(text, tags, region, weight if fine[k] else 0.0) for text, tags, region, weight, k in lines]


def _mostly_articles(lines: list[tuple[str, int, int, float]]) -> bool:
    """Whether articles hold at least half of the text in lines whose plain ratio of text to tags is high."""
    weight = np.array([float(w > 0) for *_, w in lines])
    size = np.array([len(text) for text, *_ in lines])
    ratio = size / np.maximum(1, [tags for _, tags, _, _ in lines]) * weight
    high = (weight > 0) & (smoothed(ratio) >= smoothed(ratio).std()) & (ratio >= ratio.std())
    article = np.array([r < 0 for _, _, r, _ in lines])
    return 2 * size[high & article].sum() >= size[high].sum()


def main_text(html: str) -> str:
    """Blocks of a page's content joined by newlines; white space in a block is one space. No content gives ""."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = _without_doubt(parser.lines, parser.outer)
    if not any(weight for *_, weight in lines):
        return ""
    size = np.array([len(text) for text, *_ in lines])
    region = np.array([r for _, _, r, _ in lines])
    weight = np.array([w for *_, w in lines])
    in_article = region < 0
    if size[in_article & (weight > 0)].sum() < size[~in_article & (weight > 0)].sum() and not _mostly_articles(lines):
        weight = np.where(in_article, 0.0, weight)
    ratio = size / np.maximum(1, [tags for _, tags, _, _ in lines]) * weight
    smooth = np.where(weight > 0, smoothed(ratio), 0.0)
    threshold = smooth.std()
    high = (weight > 0) & (smooth >= threshold) & (ratio >= threshold)
    high[np.argmax(ratio)] = True
    clusters = set(region[high].tolist())
    if articles := {r for r in clusters if r < 0}:
        clusters = articles
    return "\n".join(line[0] for line, w in zip(lines, weight, strict=True) if w and line[2] in clusters)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep` and the main text of every page, from its whole html. Null html counts as empty.

    Pages are taken one by one, so repeated rows give repeated results and nothing is gathered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html or "") for html in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    fields = [T.StructField(f"k{i}", pages.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField("text", T.StringType())]
    chosen = pages.select(F.col(html_col).alias("html"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    return chosen.mapInArrow(run, T.StructType(fields)).toDF(*keep, text_col)
