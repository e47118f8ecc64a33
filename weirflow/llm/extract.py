"""Main text of web pages by tag-path ratios.

Every block of text has a path of block tags from the root; marked elements (a word of boilerplate in class, id or role) have
paths of their own. Text length, punctuation and text in links are summed up per path; their ratios to the number of
blocks are smoothed over the blocks in page order and fused, and a threshold on the fused ratio selects content paths. Marks
only lower a path's ratio, less so on paragraphs, and not at all on the page's frame, on headings and on what holds most of the page's text.

What stands in the container of the content paths is the main text, headings and short paragraphs included; there too, marked
paths and lists of links stay only if their ratio reaches the threshold. Elements that are no article by their name (navigation,
forms, scripts, ...) take no part.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.shared import small_batches, text_column

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
#: Elements whose content is not text.
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
#: Elements that are no content.
OUT = frozenset("nav footer aside form button select option dialog menu label input fieldset head".split())
#: Elements inside a line; they are no part of a path and break no block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark boilerplate.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dropdown footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets complementary contentinfo replies respond".split()
)
#: Elements that marks never touch: the page's frame and headings; blocks of text, whose own ratio speaks.
FRAME = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
TEXT = frozenset("p blockquote pre".split())
#: What an open element of this kind is closed by.
_CLOSES = {"p": {"p", "div", "ul", "ol", "table", "section", "article", "aside", "header", "footer", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dl", "main", "figure", "hr", "address"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？]")
#: Blocks on each side that a ratio is smoothed over; share of the best that a content path reaches; what marks leave of a ratio, and of that of a block of text.
REACH, SHARE, LOWERED, LOWERED_TEXT = 2, 0.2, 0.02, 0.3


@dataclass
class Paths:
    """The paths of a page as a tree: each has a parent with a lesser number; 0 is the root."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    #: Number of the innermost marked element of the path, 0 if there is none.
    mark: list[int] = field(default_factory=lambda: [0])
    #: The marked elements: the next one outside, and the tag.
    outside: list[int] = field(default_factory=lambda: [0])
    marked_tag: list[str] = field(default_factory=lambda: [""])
    _known: dict = field(default_factory=dict)

    def below(self, path: int, tag: str, marked: bool) -> int:
        """The path of a child; a marked element has one of its own."""
        if not marked and (found := self._known.get((path, tag))):
            return found
        number = len(self.parent)
        self.parent.append(path)
        self.tag.append(tag)
        mark = self.mark[path]
        if marked:
            self.outside.append(mark)
            self.marked_tag.append(tag)
            mark = len(self.outside) - 1
        else:
            self._known[path, tag] = number
        self.mark.append(mark)
        return number


@dataclass
class Block:
    """A block's text, its path, and how many of its characters are in links."""

    path: int
    text: str
    linked: int = 0


def _marked(values: list[str]) -> bool:
    return any(word in MARKED for v in values for word in re.split(r"[\s_\-]+", v.lower()))


def tags(page: str) -> Iterator[tuple[str, str, bool, list[str]]]:
    """``(text before, tag, closing, values of class, id and role)`` of a page, one after another; the last has no tag.

    In time proportional to the page: no place is looked at more than a few times. A tag or comment that does not end takes the rest.
    """
    at, n, start = 0, len(page), 0
    while True:
        i = page.find("<", at)
        if i < 0 or i + 1 >= n:
            yield page[start:], "", False, []
            return
        c = page[i + 1]
        if c in "!?":
            end = page.find("-->", i + 4) + 2 if page.startswith("<!--", i) else page.find(">", i)
            yield page[start:i], "", False, []
            if end < i:
                return
            at = start = end + 1
            continue
        closing = c == "/"
        m = _NAME.match(page, i + 1 + closing)
        if not m:
            at = i + 1
            continue
        tag, k, values = m[0].lower(), m.end(), []
        while not closing and (a := _ATTRIBUTE.match(page, k)):
            if a[1].lower() in ("class", "id", "role") and a[2]:
                values.append(a[2].strip("\"'"))
            k = a.end()
        k = page.find(">", k)
        yield page[start:i], tag, closing, values
        if k < 0:
            return
        at = start = k + 1
        if not closing and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s>/])", re.I).search(page, at)
            if not end or (end := page.find(">", end.end())) < 0:
                return
            at = start = end + 1


def blocks(page: str) -> tuple[list[Block], Paths]:
    """The blocks of a page that are in no element without content, in order, references decoded, white space single."""
    paths, out = Paths(), []
    stack: list[tuple[str, bool, int]] = []
    opened: Counter = Counter()
    parts: list[tuple[str, bool]] = []
    barred = links = 0
    muted: list[str] = []

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                out.append(Block(stack[-1][2] if stack else 0, text, min(len(text), len(" ".join("".join(p for p, linked in parts if linked).split())))))
            parts.clear()

    def close():
        nonlocal barred
        tag, bad, _ = stack.pop()
        opened[tag] -= 1
        barred -= bad

    for text, tag, closing, values in tags(page):
        if text and not barred and not muted:
            parts.append((text, links > 0))
        if not tag or tag in RAW:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append((" ", False))
            continue
        if tag in INLINE:
            links = max(0, links + (-1 if closing else 1)) if tag == "a" else links
            # an advert inside a line has no ratio of its own
            if closing and muted and muted[-1] == tag:
                muted.pop()
            elif not closing and (tag in muted or _marked(values)):
                muted.append(tag)
            continue
        flush()
        links, muted = 0, []
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        while stack and tag in _CLOSES.get(stack[-1][0], ()):
            close()
        bad = tag in OUT or tag == "header" and not opened["article"] and not opened["main"]
        stack.append((tag, bad, paths.below(stack[-1][2] if stack else 0, tag, tag not in FRAME and _marked(values))))
        opened[tag] += 1
        barred += bad
    flush()
    return out, paths


def _prior(found: list[Block], paths: Paths) -> list[float]:
    """What every path's ratio is multiplied by for the marked elements that it is in; what holds most of the page's text counts as unmarked."""
    size = [0] * len(paths.outside)
    for b in found:
        size[paths.mark[b.path]] += len(b.text)
    total = sum(size)
    for m in range(len(size) - 1, 0, -1):
        if paths.outside[m]:
            size[paths.outside[m]] += size[m]
    left = [1.0] * len(size)
    for m in range(1, len(size)):
        own = 1.0 if 2 * size[m] > total else LOWERED_TEXT if paths.marked_tag[m] in TEXT else LOWERED
        left[m] = min(left[paths.outside[m]], own)
    return [left[m] for m in paths.mark]


def ratios(found: list[Block], paths: Paths) -> dict[int, float]:
    """The fused ratio of every path that has a block."""
    length, marks, linked, count = Counter(), Counter(), Counter(), Counter()
    for b in found:
        length[b.path] += len(b.text)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        linked[b.path] += b.linked
        count[b.path] += 1
    prior = _prior(found, paths)
    ratio = {p: length[p] / n * (1 + math.log1p(marks[p] / n)) * (1 - linked[p] / length[p]) * prior[p] for p, n in count.items()}
    raw = [ratio[b.path] for b in found]
    total = [0.0]
    for r in raw:
        total.append(total[-1] + r)
    fused: dict[int, float] = dict.fromkeys(count, 0.0)
    for i, b in enumerate(found):
        lo, hi = max(i - REACH, 0), min(i + REACH + 1, len(raw))
        fused[b.path] += math.sqrt(max(total[hi] - total[lo], 0.0) / (hi - lo) * raw[i]) / count[b.path]
    return fused


def chosen(found: list[Block], paths: Paths) -> list[bool]:
    """Which blocks are main text."""
    fused = ratios(found, paths)
    least = SHARE * max(fused.values())
    content = [p for p in fused if fused[p] >= least]
    inner = [0] * len(paths.parent)
    for p in range(1, len(inner)):
        inner[p] = p if paths.tag[p] in ("article", "main") else inner[paths.parent[p]]
    roots = {inner[p] for p in content if inner[p]} or {paths.parent[p] for p in content}
    inside = [0 in roots] * len(inner)
    for p in range(1, len(inner)):
        inside[p] = p in roots or inside[paths.parent[p]]
    length, linked = Counter(), Counter()
    for b in found:
        length[b.path] += len(b.text)
        linked[b.path] += b.linked
    prior = _prior(found, paths)
    plain = {p: prior[p] == 1 and 2 * linked[p] <= length[p] for p in fused}
    own = set(content)
    return [inside[b.path] and (b.path in own or plain[b.path]) for b in found]


def main_text(page: str | None) -> str:
    """The main text of a page; '' for NULL, empty and textless pages."""
    found, paths = blocks(page or "")
    return " ".join(b.text for b, on in zip(found, chosen(found, paths), strict=True) if on) if found else ""


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url, text)`` per row.

    NULL and empty pages have an empty text; repeated rows are extracted alike; paths of equal ratio are treated alike; an empty
    table gives an empty result; other columns are ignored. Time and memory are in proportion to a page, however long it is,
    deep it is nested or many of its tags do not end.
    """
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], names=[id_col, "url", "text"])

    return df.select(f"`{id_col}`", text_column(df, url_col).cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(run, f"`{id_col}` {kind}, url string, text string")


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
