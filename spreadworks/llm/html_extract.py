"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser gives one line per block of text (what lies
between two block-level tags).  A line's ratio is its text length over the tags that
opened in it; text under elements that are marked up as something else than content
(navigation, header, footer, aside, form, script, adverts, notices, comments and the
like) is a line of its own with ratio 0, also within a paragraph: what stands before and
after it is one line.  A class or id marks only if it says nothing else: beside words of
place or form (post-footer, share-buttons) it does, beside words of content it does not
(side-effects, social-history); nor does it mark what holds an article, main or most of
the page's text, or one that tells a layout or state (with-sidebar, comments-open).  A form around the page marks nothing
then, nor does a lone word like "comment" on a paragraph or "social" on a section of
prose.  A
header inside an article or main is its own title and stays.  The ratios are smoothed by
a Gaussian over neighbouring lines and split into two clusters by a threshold (two means
in one dimension).  The lines of the
upper cluster select the content region: the innermost element that holds at least
80 % of their text, widened to the article or main element around it.  All content
lines of the region are the text, short ones included.  Without an article or main
element around it, the text is all content lines of the region but link-dense ones, the
other lines of the upper cluster or with a ratio of its own above the threshold, and
whatever borders on these (title, byline, ending) up to the next line that is outside or
link-dense.

Defined results: a null or empty page, or one without content, gives an empty string;
broken, unclosed or nested markup is read as far as it goes; very long pages are read
whole; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

SIGMA, SHARE, LINKED = 1.0, 0.8, 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre script search section select "
    "style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Of these, those that show nothing: a line of text goes on after them.
SILENT = frozenset("noscript script style template title".split())
BREAKS = BLOCK - SILENT
#: Elements whose text is no content, wherever they stand.
OUTSIDE = frozenset("head title script style noscript template nav header footer aside menu button select textarea iframe svg dialog search canvas object audio video".split())
#: Roles, and words of a class or id, that mark an element as something else than content.
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar toolbar tooltip status".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup paywall "
    "sidebar sidebars side widget widgets rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer header masthead topbar comment comments commentlist reply replies respond responses disqus discussion "
    "share sharing social related recommended login search skip".split()
)
#: Marks that an author may give to a paragraph or section of the text: they do not count on a paragraph, nor on an element of prose.
WEAK = frozenset("comment notice notices promotion side social related recommended share sharing discussion response responses reply replies search".split())
#: Characters outside of links that make an element prose.
PROSE = 200
KEEP = frozenset("html body main".split())
#: A class like with-sidebar or comments-open says how something else is laid out.
PREFIXES = frozenset("with without has have no not non is hide show".split())
SUFFIXES = frozenset("open closed enabled disabled".split())
#: Words of place or form: beside them (and beside numbers) a mark still marks.
NEUTRAL = frozenset(
    "site page post posts entry entries article articles blog story stories main primary secondary global top bottom left right center inner outer "
    "first last before after below above in inline box block container wrapper wrap inside area region section zone slot unit bar panel strip row col column "
    "grid list lists item items link links button buttons icon icons group holder content body text title heading tools toolbar tags meta "
    "author user users reader readers customer thread threads feed stream view count counts form field input area sticky fixed floating mobile desktop big small large wide "
    "google dfp leaderboard skyscraper rectangle label placeholder native header footer email mail sign up us on more latest popular recent your our new js".split()
)
#: Marks that beside one of these words (or on a section, if None) name a part of a text.
PARTS = {"related": frozenset("work works research literature".split()), **dict.fromkeys(("response", "responses", "reply", "replies"), frozenset("body text content".split())), "discussion": None}
#: An element with a mark is content all the same if it holds this share of the page's text (if it is nothing but marks: SHARE).
MOST = 0.5
REGION = frozenset("article main".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Opening any of these ends an open paragraph, as browsers do.
ENDS_P = BLOCK - {"button", "caption", "head", "html", "body", "legend", "noscript", "option", "script", "select", "style", "tbody", "td", "template", "textarea", "tfoot", "th", "thead", "title", "tr", "iframe"}


class Lines(HTMLParser):
    """Collects the chunks of text: (line, text, tags, linked characters, outside, path); path: numbers of the open elements.

    A line is what lies between two breaks.  Its chunks are kept apart where an element outside or marked opens or closes within it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.chunks: list[tuple[int, str, int, int, bool, tuple]] = []
        self.open: list[tuple[str, int, bool]] = []
        self.marks: dict[int, tuple[float, bool]] = {}  # elements that a class, an id or being a form marks; see decided
        self.names: list[str] = []
        self.data: list[str] = []
        self.line = self.tags = self.linked = self.links = 0

    def end_chunk(self) -> None:
        if self.data:
            outside = bool(self.open) and self.open[-1][2]
            self.chunks.append((self.line, "".join(self.data), self.tags, self.linked, outside, tuple(n for _, n, _ in self.open)))
            self.data = []
            self.tags = self.linked = 0

    def end_line(self) -> None:
        self.end_chunk()
        if not (self.open and self.open[-1][2]):  # blocks within what is outside break no line around it
            self.line += 1
            self.tags = self.linked = 0

    @staticmethod
    def outside(tag: str, attrs: list) -> bool:
        """No content, whatever the element holds."""
        if tag in OUTSIDE:
            return True
        if tag in KEEP:
            return False
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if value:
                if name == "role" and value.lower() in ROLES:
                    return True
                if name == "style" and "display:none" in value.replace(" ", "").lower():
                    return True
        return False

    @staticmethod
    def marked(tag: str, attrs: list) -> tuple[float, bool]:
        """(0, ..) if nothing marks the element; else the share of the page's text beyond which the mark does not count, and whether all its marks are weak."""
        found, weak = (MOST, False) if tag == "form" else (0.0, True)
        if tag in KEEP:
            return 0.0, True
        for name, value in attrs:
            for token in value.split() if value and name in ("class", "id") else ():
                words = [w.lower() for w in _WORDS.findall(token)]
                if len(words) > 1 and (words[0] in PREFIXES or words[-1] in SUFFIXES):
                    continue
                others = {w for w in set(words) - MARKS if not w.isdigit()}
                if others - NEUTRAL:  # it names something else: side-effects, social-history
                    continue
                for w in MARKS.intersection(words):
                    part = PARTS.get(w, frozenset())
                    alone = w in WEAK and not others and len(words) == 1
                    if not (tag == "section" if part is None else part & set(words)) and not (alone and tag == "p"):
                        found = max(found, MOST if others else SHARE)
                        weak = weak and alone and tag == "section"
        return found, weak

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.end_line()
            if tag in ENDS_P:
                self.end_p()
        self.tags += 1
        if tag == "br":
            self.data.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        outside = bool(self.open) and self.open[-1][2]
        if not outside and not (tag == "header" and any(t in REGION for t, _, _ in self.open)):
            outside = self.outside(tag, attrs)
        mark = (0.0, True) if outside else self.marked(tag, attrs)
        if tag in BLOCK or outside or mark[0]:
            self.end_chunk()
            if mark[0]:
                self.marks[len(self.names)] = mark
            self.open.append((tag, len(self.names), outside))
            self.names.append(tag)

    def end_p(self) -> None:
        """A block ends an open paragraph, but not from within an inline element that is outside or marked."""
        for name, n, outside in reversed(self.open):
            if name == "p":
                self.close_to("p")
                return
            if name in BLOCK or outside or n in self.marks:
                return

    def close_to(self, tag: str, stop=frozenset()) -> None:
        """Close the innermost open element of this name and all inside it, if one is open (before any of stop)."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.end_chunk()
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:  # a slash means nothing on HTML's block elements
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.end_line()
        if tag == "a":
            self.links = max(0, self.links - 1)
        # a formatting tag does not close blocks opened since
        self.close_to(tag, frozenset() if tag in BLOCK else BLOCK)

    def handle_data(self, data):
        self.data.append(data)
        if self.links:
            self.linked += len(data)


def text_to_tags(line: tuple) -> float:
    """Text length over the tags that opened in the line; 0 outside of content."""
    text, tags, _, outside, _ = line
    return 0.0 if outside else len(text) / max(1, tags)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbouring lines."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def threshold(values: np.ndarray) -> float:
    """Midpoint of two clusters, by two means in one dimension."""
    low, high = values.min(), values.max()
    for _ in range(20):
        cut = (low + high) / 2
        a, b = values[values <= cut], values[values > cut]
        if not len(a) or not len(b) or (a.mean() == low and b.mean() == high):
            break
        low, high = a.mean(), b.mean()
    return (low + high) / 2


def decided(parser: Lines) -> list[tuple[str, int, int, bool, tuple]]:
    """(text, tags, linked characters, outside, path) of the parser's lines: a line's content is joined without what lies outside.

    A mark does not count on an article, on what holds an article (without marks of its own)
    or main, or, if no such element has text elsewhere, on what holds most of the page's text.
    A weak mark does not count on a section of prose either.
    """
    marks, names = parser.marks, parser.names
    size, prose = dict.fromkeys(marks, 0), dict.fromkeys(marks, 0)
    regions = dict.fromkeys(marks, 0)  # text in articles or main
    total = total_regions = 0
    holds = set()
    for _, text, _, linked, outside, path in parser.chunks if marks else ():
        if outside:
            continue
        n_text = len(text.strip())
        total += n_text
        region = [n for n in path if names[n] in REGION and n not in marks]
        total_regions += n_text if region else 0
        for n in path:
            if n in marks:
                size[n] += n_text
                prose[n] += max(0, n_text - linked)
                if region:
                    regions[n] += n_text
                    if n < region[-1]:
                        holds.add(n)
    gone = {
        n
        for n, (most, weak) in marks.items()
        if names[n] != "article" and n not in holds and (regions[n] < total_regions or size[n] <= most * total) and not (weak and prose[n] >= PROSE)
    }
    lines = []
    for _, group in groupby(parser.chunks, key=itemgetter(0)):
        parts = [(*x[1:4], x[4] or not gone.isdisjoint(x[5]), x[5]) for x in group]
        for outside in (True, False):  # what lies outside is a line of its own
            mine = [x for x in parts if x[3] == outside]
            text = " ".join("".join(x[0] for x in mine).split())
            if text:
                lines.append((text, sum(x[1] for x in mine), sum(x[2] for x in mine), outside, min((x[4] for x in mine if x[0].strip()), key=len)))
    return lines


def main_text(html: str | None) -> str:
    """The content lines of a page, joined by one space."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = decided(parser)
    content = [i for i, x in enumerate(lines) if not x[3]]
    if not content:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    ratio = np.array([text_to_tags(x) for x in lines])
    even = smoothed(ratio)
    cut = threshold(even)
    chosen = [i for i in content if even[i] >= cut] or content
    mass: dict[int, float] = {}
    for i in chosen:
        for n in lines[i][4]:
            mass[n] = mass.get(n, 0) + size[i]
    total = sum(size[i] for i in chosen)
    holds = [n for n in mass if mass[n] >= SHARE * total]
    inner = max(holds, default=-1)  # elements are numbered as they open: the innermost has the largest number
    around = [n for i in chosen if inner in lines[i][4] for n in lines[i][4] if parser.names[n] in REGION]
    if inner >= 0 and around:
        outer = [n for n in around if n <= inner]
        if outer:
            top = min(outer)
            return " ".join(lines[i][0] for i in content if top in lines[i][4])
        regions = set(around)  # several articles in one element; an article that is a small part of it is no region
        held = sum(size[i] for i in chosen if regions & set(lines[i][4]))
        if 2 * held >= total or any(parser.names[n] == "main" for n in regions):
            return " ".join(lines[i][0] for i in content if regions & set(lines[i][4]))
    picked = {*chosen, *(i for i in content if ratio[i] >= cut)}  # a lone paragraph is smoothed away
    plain = [not x[3] and x[2] < LINKED * size[i] for i, x in enumerate(lines)]
    kept = {i for i in content if i in picked or (plain[i] and inner in lines[i][4])}
    for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):  # what borders on it, up to a line that is outside or link-dense
        step = -1 if order.step > 0 else 1
        for i in order:
            if plain[i] and i + step in kept:
                kept.add(i)
    return " ".join(lines[i][0] for i in sorted(kept))


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """pages with a column of main texts in place of the html; other columns stay as they are."""
    prepare(pages.sparkSession)
    others = [F.col(f"`{c}`") for c in pages.columns if c not in (name, html_col)]
    schema = pages.select(*others, F.lit("").alias(name)).schema
    rows = pages.select(*others, F.col(f"`{html_col}`").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], name])

    return rows.mapInArrow(run, schema)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
