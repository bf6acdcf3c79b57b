"""Main content of web pages.

Each page's markup is read as a tree of containers. Every block of text passes
points for its length and its commas, discounted by the share of it that is link
text, to its container, half of them to the one above, a quarter to the next; the best
container and the siblings that look like it are the first guess at the main
content. That guess, made for every page, says of each line that recurs over the
pages whether it usually lies in main content or beside it. The second reading
scores the containers again without the points of lines that usually lie beside,
keeps the best and the siblings that hold prose, code or tables, and reads pages
without markup by their lines alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment or declaration, a tag with its attributes, or text up to the next tag.
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|([^<]+|<)", re.S)
_UNSEEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)")
_CLASS = re.compile(r"(?i)\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_INLINE = {"a", "b", "i", "em", "strong", "span", "code", "small", "u", "font", "sup", "sub", "label", "img", "br", "wbr", "input", "abbr", "td", "th"}
_VOID = {"br", "img", "input", "meta", "link", "hr", "wbr"}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+(?=\W|$)")
_SENTENCE = re.compile(r"[.!?:;。](?:[\"'»)\]]*)$")
_CODE = re.compile(r"^(?:[A-Z]{4,}(?: [A-Z]+\([^)]*\))+|select\b.*|dcl-\w+ .*|C +\w+ +[A-Z]{3,}.*|.*[;{}]$)")
#: A line is recurring if at least this share of the pages, and this many, have it.
SHARE, AT_LEAST = 0.002, 4
LONG_LINE = 400  # characters from which a line is named by its hash
NEARBY = 12  # blocks within which a text that recurs on the page is looked for


@dataclass
class Block:
    text: str
    box: int
    tag: str
    link: float


class _Page:
    """Blocks of visible text in order, and the boxes that hold them."""

    def __init__(self) -> None:
        self.tags, self.classes, self.parents = ["body"], [""], [-1]
        self.stack = [0]
        self.hidden = 0
        self.links = 0
        self.tables = 0
        self.buffer: list[str] = []
        self.linked = 0
        self.lines: list[tuple[str, int, float]] = []
        self.in_title = False
        self.title = ""

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.buffer)).strip()
        if text:
            self.lines.append((text, self.stack[-1], min(1.0, self.linked / len(text))))
        self.buffer, self.linked = [], 0

    def _inline(self, tag: str) -> bool:
        return tag in _INLINE and not (tag in ("td", "th") and not self.tables)

    def read(self, html: str) -> None:
        for m in _MARKUP.finditer(_UNSEEN.sub(" ", html)):
            tag = m[2]
            if tag is None:
                if m[4] is not None:
                    self.handle_data(unescape(m[4]) if "&" in m[4] else m[4])
            elif m[1]:
                self.handle_endtag(tag.lower())
            else:
                self.handle_starttag(tag.lower(), m[3])
        self.flush()

    def handle_starttag(self, tag: str, attributes: str) -> None:
        if tag in ("head", "title"):
            self.hidden += 1
            self.in_title = tag == "title"
        elif tag == "a":
            self.links += 1
        elif tag == "br":
            self.flush()
        elif tag in ("body", "html", "meta", "link"):
            if tag == "body":
                self.hidden = 0
        elif tag not in _VOID and not self._inline(tag):
            self.flush()
            if tag == "table":
                self.tables += 1
            # a paragraph ends where the next block begins, a list item where the next item does
            top = self.tags[self.stack[-1]]
            if len(self.stack) > 1 and (top in ("p", "h1", "h2", "h3", "pre") or top == tag == "li"):
                self.stack.pop()
                if tag == "li" and self.tags[self.stack[-1]] == "li":
                    self.stack.pop()
            self.tags.append(tag)
            c = _CLASS.search(attributes) if attributes else None
            self.classes.append((c[1] or c[2] or c[3] or "") if c else "")
            self.parents.append(self.stack[-1])
            self.stack.append(len(self.tags) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("head", "title"):
            self.hidden = max(0, self.hidden - 1)
            self.in_title = False
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif not self._inline(tag) and tag not in _VOID:
            self.flush()
            if tag == "table":
                self.tables = max(0, self.tables - 1)
            for k in range(len(self.stack) - 1, 0, -1):
                if self.tags[self.stack[k]] == tag:
                    del self.stack[k:]
                    break

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title = _SPACE.sub(" ", data).strip()
        if not self.hidden:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data.strip())


_LEAVES = {"p", "li", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "tbody", "dt", "dd", "blockquote"}


def blocks(html: str) -> tuple[list[Block], _Page]:
    page = _Page()
    page.read(html)
    children = [0] * len(page.tags)
    for parent in page.parents[1:]:
        children[parent] += 1
    out = []
    for text, node, link in page.lines:
        tag, box = page.tags[node], node
        # up from the block itself to the box it stands in
        while page.parents[box] > 0 and (page.tags[box] in _LEAVES or (box == node and not children[box] and page.tags[box] in ("div", "span"))):
            box = page.parents[box]
        out.append(Block(text, box, tag, link))
    return out, page


def folded(line: str) -> str:
    """What recurring lines share: no digits, host names or case. A very long line is
    named by its hash."""
    line = _DIGITS.sub("0", _HOST.sub("@", line.strip().lower()))
    return line if len(line) <= LONG_LINE else f"#{xxhash.xxh3_128_hexdigest(line.encode('utf-8', 'surrogatepass'))}"


def is_prose(text: str) -> bool:
    return len(text) >= 40 and text.count(" ") >= 5 and bool(_SENTENCE.search(text))


def is_content(b: Block) -> bool:
    """Prose, code, a table row or a list item that is no link, as main content has them."""
    if b.link > 0.5:
        return False
    t = b.text
    return is_prose(t) or b.tag == "pre" or (b.tag == "li" and not b.link) or (b.tag in ("tr", "table", "tbody") and " | " in t) or bool(_CODE.match(t))


def points(b: Block) -> float:
    return (1 + b.text.count(",") + min(len(b.text) / 100, 3)) * (1 - b.link) if len(b.text) >= 25 else 0.0


def best_boxes(found: list[Block], page: _Page, beside: set[int]) -> tuple[int | None, dict[int, float], dict[int, list[int]]]:
    """Best box, points of all boxes, blocks of all boxes; blocks in ``beside`` give no points."""
    score: dict[int, float] = {}
    members: dict[int, list[int]] = {}
    length: dict[int, list[float]] = {}
    for i, b in enumerate(found):
        members.setdefault(b.box, []).append(i)
        own = length.setdefault(b.box, [0.0, 0.0])
        own[0] += len(b.text)
        own[1] += len(b.text) * b.link
        if i not in beside:
            if page.title and b.text == page.title and not b.link:
                score[b.box] = score.get(b.box, 0.0) + 5.0
            score[b.box] = score.get(b.box, 0.0) + points(b) * (2.0 if is_content(b) else 0.5)
            above, share = page.parents[b.box], points(b) / 2
            while above > 0 and share > 0.01:  # half as much with every level
                score[above] = score.get(above, 0.0) + share
                above, share = page.parents[above], share / 2
    for box, (total, linked) in length.items():
        score[box] = score.get(box, 0.0) * (1 - linked / max(1.0, total))
    own_boxes = {k: v for k, v in score.items() if k in members}
    best = max(own_boxes, key=lambda k: own_boxes[k]) if own_boxes else None
    return best, score, members


def first_guess(html: str | None) -> list[tuple[str, bool]]:
    """(line, lies in the best box or one of its kind)."""
    if not html:
        return []
    found, page = blocks(html)
    best, score, members = best_boxes(found, page, set())
    if best is None or not any(is_content(found[i]) for i in members[best]):
        return [(b.text, False) for b in found]
    kind = (page.tags[best], page.classes[best], page.parents[best])
    return [(b.text, b.box == best or (bool(kind[1]) and (page.tags[b.box], page.classes[b.box], page.parents[b.box]) == kind)) for b in found]


def _plain_lines(lines: list[str], title: str | None, usual: dict[str, bool]) -> list[bool]:
    """Which lines are main content, of a page without markup."""
    known = [usual.get(folded(t)) for t in lines]
    body = [k is not False and (is_prose(t) or bool(_CODE.match(t.strip())) or (" | " in t and k is not False and (k or is_prose(t)))) for t, k in zip(lines, known)]
    titled = next((k for k, t in enumerate(lines) if title and t.strip() == title.strip()), None)
    if not any(body):
        # a title with a list below it
        main = [False] * len(lines)
        for k in range(titled if titled is not None else len(lines), len(lines)):
            if known[k] is False:
                break
            main[k] = True
        return main if sum(main) > 1 else [False] * len(lines)
    first, last = body.index(True), len(body) - 1 - body[::-1].index(True)
    main = list(body)
    for i in range(first, last + 1):
        # headings and short lines between content lines
        if known[i] is True:
            main[i] = True
    i = first - 1
    while i >= 0 and known[i] is True:
        main[i] = True
        i -= 1
    if i >= 0 and known[i] is None and " > " not in lines[i] and len(lines[i]) < 120:
        main[i] = True  # the title stands right before the first heading or content line
    if title:
        same = [k for k, t in enumerate(lines) if t.strip() == title.strip() and k <= first]
        if same:
            main[same[-1]] = True
    return main


def main_lines(html: str | None, text: str | None, title: str | None, usual: dict[str, bool]) -> list[bool]:
    """For each line of ``text`` whether it is main content. ``usual`` says of
    recurring folded lines whether they usually are."""
    if text is None:
        return []
    lines = text.split("\n")
    if not html:
        return _plain_lines(lines, title, usual)
    found, page = blocks(html)
    beside = {i for i, b in enumerate(found) if usual.get(folded(b.text)) is False and not (b.text == page.title and not b.link)}
    best, score, members = best_boxes(found, page, beside)
    keep: set[int] = set()
    if best is not None and any(is_content(found[i]) and i not in beside for i in members[best]):
        kind = (page.tags[best], page.classes[best], page.parents[best])
        for box, inside in members.items():
            if box == best:
                keep |= set(inside) - beside
                continue
            same = (page.tags[box], page.classes[box], page.parents[box]) == kind and bool(kind[1] or kind[0] in ("article", "main"))
            rest = [i for i in inside if i not in beside]
            good = [i for i in rest if is_content(found[i]) or usual.get(folded(found[i].text)) is True]
            linked = sum(len(found[i].text) * found[i].link for i in inside) / max(1, sum(len(found[i].text) for i in inside))
            opening = inside and inside[0] in beside
            if rest and linked < 0.3 and not opening and (same or 2 * len(good) >= len(rest)):
                keep |= set(rest)
    # the blocks are the lines, in order; a line that no block gives is judged by itself.
    # A text that stands once among all blocks is found wherever it is, others nearby
    out, at = [], 0
    where: dict[str, list[int]] = {}
    for k, b in enumerate(found):
        where.setdefault(b.text, []).append(k)
    for line in lines:
        want = _SPACE.sub(" ", line).strip()
        spots = where.get(want, ())
        place = next((k for k in spots if k >= at and (k < at + NEARBY or len(spots) == 1)), None)
        if place is None:
            out.append(bool(keep) and usual.get(folded(line)) is not False and (is_prose(want) or bool(_CODE.match(want))))
        else:
            out.append(place in keep)
            at = place + 1
    return out


def line_usage(pages: DataFrame, html: str = "html") -> DataFrame:
    """(line, n, main): folded lines by how often they occur and how often in the
    first guess. Pages without markup say nothing here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            count: dict[str, list[int]] = {}
            for h in f["html"].tolist():
                for line, main in {(folded(t), m) for t, m in first_guess(h)}:
                    c = count.setdefault(line, [0, 0])
                    c[0] += 1
                    c[1] += main
            yield pd.DataFrame([(k, *v) for k, v in count.items()], columns=["line", "n", "main"])

    return pages.select(F.col(html).alias("html")).where("html is not null").mapInPandas(run, "line string, n long, main long").groupBy("line").agg(F.sum("n").alias("n"), F.sum("main").alias("main"))


def places(rows: Iterable[tuple[str, int, int]]) -> dict[str, bool]:
    """Lines that clearly belong to one side; the others are left to the page."""
    return {line: 10 * main >= 7 * n for line, n, main in rows if not 0.35 * n < main < 0.7 * n}


def usual_places(pages: DataFrame, html: str = "html", share: float = SHARE) -> dict[str, bool]:
    """Recurring lines and whether they usually lie in main content.

    At most (lines of a page) / share lines can recur, whatever the number of
    pages, so the result is small enough for the driver and for a broadcast.
    """
    total = pages.count()
    rows = line_usage(pages, html).where(F.col("n") >= max(AT_LEAST, int(share * total))).collect()
    return places((r["line"], r["n"], r["main"]) for r in rows)


def label_lines(pages: DataFrame, key: str, html: str, text: str, title: str) -> DataFrame:
    """(key, line_no, main, line) of every line of every page.

    A page whose text is null has no lines; one without markup is read by its
    lines; broken markup is read as far as it goes. Repeated pages are each
    labelled; extra columns are not read.
    """
    usual = pages.sparkSession.sparkContext.broadcast(usual_places(pages, html))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, numbers, main, lines = [], [], [], []
            for k, h, t, c in zip(f["k"].tolist(), f["html"].tolist(), f["text"].tolist(), f["title"].tolist()):
                labels = main_lines(h, t, c, usual.value)
                keys += [k] * len(labels)
                numbers += range(1, len(labels) + 1)
                main += labels
                lines += t.split("\n") if labels else []
            yield pd.DataFrame({"k": keys, "line_no": numbers, "main": main, "line": lines})

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("k"), F.col(html).alias("html"), F.col(text).alias("text"), F.col(title).alias("title"))
    return rows.mapInPandas(run, f"k {kind}, line_no int, main boolean, line string").withColumnRenamed("k", key)
