"""Structured text, questions and links of HTML pages.

A page is read into a small tree: void tags open nothing, an end tag closes up to
its own element if that is open and is ignored otherwise, items and cells close
the ones before them. Everything else is a walk over that tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.operators import qabank
from quarrylake.sources.store import cut, licensed

VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "iframe", "frame", "nav"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CRUMBS = {"help_breadcrumbs", "breadcrumb", "familylinks"}
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_CLOSE_P = {"p", "div", "section", "article", "ul", "ol", "table", "pre", "blockquote", "form", "header", "footer", "nav", "aside", "main", "dl", *HEADINGS}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        """All elements below this one, in order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, dropped: set[str] | frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in dropped:
                stack += reversed(n.children)
        return "".join(out)

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def within(self, tags: set[str]) -> bool:
        n = self.parent
        while n is not None:
            if n.tag in tags:
                return True
            n = n.parent
        return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSE_P and self.open[-1].tag == "p":
            self.open.pop()
        if tag in _ENDS:
            ended, outer = _ENDS[tag]
            k = len(self.open) - 1
            while k > 0 and self.open[k].tag not in outer:
                if self.open[k].tag in ended:
                    # the outermost that ends within the nearest list or table
                    last = k
                    while k > 1 and self.open[k - 1].tag not in outer:
                        k -= 1
                        if self.open[k].tag in ended:
                            last = k
                    del self.open[last:]
                    break
                k -= 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def tidy(s: str) -> str:
    """CR to LF, blanks one space, none around LF, at most one empty line."""
    s = re.sub(r"[\t\f\v ]+", " ", s.replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", s)).strip()


#: What is rewritten at which depth of structure: text of a heading knows line breaks
#: only, that of an item headings as well, and so on up to tables.
_DEPTH = {**dict.fromkeys(HEADINGS, 1), "li": 2, "pre": 3, "code": 4, "table": 5}


def structured(node: Node, depth: int = 5, dropped: set[str] = DROPPED) -> str:
    """Text with headings between blank lines, ``- `` items, kept preformatted text,
    code between blanks and table rows as cells joined by `` | ``."""
    out: list[str] = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
            continue
        if c.tag in dropped:
            continue
        level = _DEPTH.get(c.tag, 9)
        if c.tag == "br":
            out.append("\n")
        elif level > depth:
            out.append(structured(c, depth, dropped))
        elif c.tag in HEADINGS:
            t = tidy(structured(c, 0, dropped))
            out.append(f"\n\n{t}\n\n" if t else "")
        elif c.tag == "li":
            t = tidy(structured(c, 1, dropped))
            out.append(f"\n- {t}\n" if t else "")
        elif c.tag == "pre":
            t = structured(c, 2, dropped).replace("\r", "\n").rstrip()
            out.append(f"\n\n{t}\n\n" if t else "")
        elif c.tag == "code":
            t = structured(c, 3, dropped).strip()
            out.append(f" {t} " if t else "")
        else:
            rows = []
            for tr in c.walk():
                if tr.tag == "tr":
                    cells = [tidy(structured(x, 4, dropped)) for x in tr.walk() if x.tag in ("td", "th")]
                    rows.append(" | ".join(x for x in cells if x))
            rows = [r for r in rows if r]
            out.append("\n\n" + "\n".join(rows) + "\n\n" if rows else structured(c, depth, dropped))
    return "".join(out)


def read_page(html: str | None) -> tuple[str, str, str, str, list[str], str]:
    """(title, product, version, language, breadcrumbs, text) of a page."""
    root = parse(html)
    kept = [n for n in root.walk() if n.tag not in DROPPED and not n.within(DROPPED)]
    meta: dict[str, str] = {}
    first: dict[str, str] = {}
    for n in kept:
        if n.tag == "meta" and n.attrs.get("name"):
            meta.setdefault(n.attrs["name"], n.attrs.get("content", ""))
        elif n.tag in ("h1", "h2", "title", "html"):
            first.setdefault(n.tag, n.attrs.get("lang", "") if n.tag == "html" else n.text(DROPPED))
    pick = lambda *names: next((tidy(v) for v in names if v and tidy(v)), "")
    title = pick(meta.get("DC.title"), meta.get("dcterms.title"), first.get("h1"), first.get("h2"), first.get("title"))
    links = (tidy(n.text(DROPPED)) for n in kept if n.tag == "a" and _in_crumbs(n))
    crumbs = [x for x in links if x][:12]
    body = next((n for n in kept if n.tag == "body"), root)
    hidden = DROPPED if body is not root else DROPPED | {"head", "title"}
    text = tidy("\n\n".join(x for x in (title, " > ".join(crumbs), tidy(structured(body, 5, hidden))) if x))
    return title, pick(meta.get("prodname"), meta.get("DC.subject")), pick(meta.get("version"), meta.get("DC.version")), pick(meta.get("DC.language"), first.get("html"), "en-us"), crumbs, text


def _in_crumbs(n: Node) -> bool:
    p = n.parent
    while p is not None:
        if CRUMBS & p.classes():
            return True
        p = p.parent
    return False


def extract(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, product, version, language, breadcrumbs, text) of each page that has markup."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *read_page(h)) for k, h in zip(f["k"], f["h"])], columns=["k", "title", "product", "version", "language", "breadcrumbs", "text"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("k"), F.col(html).alias("h"))
    return rows.mapInPandas(run, f"k {kind}, title string, product string, version string, language string, breadcrumbs array<string>, text string").withColumnRenamed("k", key)


_UNSEEN = {"script", "style", "svg", "noscript"}
_BLOCKS = {"p", "div", "section", "article", "li", "tr", "blockquote", "pre", "table", *HEADINGS}


def plain_text(html: str | None) -> str:
    """Text of a fragment on cleaned lines, code and preformatted text on lines of their own."""
    return qabank.clean_block(_with_breaks(parse(html), {"pre", "code"}, ""))


def fragment_text(html: str | None) -> str:
    """Text of a fragment on cleaned lines, a line for every block."""
    return qabank.clean_block(_with_breaks(parse(html), _BLOCKS, "\n"))


def _with_breaks(node: Node, blocks: set[str], br: str) -> str:
    out: list[str] = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append(br)
        elif c.tag not in _UNSEEN:
            inner = _with_breaks(c, blocks, br)
            out.append(f"\n{inner}\n" if c.tag in blocks else inner)
    return "".join(out)


# ---- questions and answers --------------------------------------------------------

_CHROME = {"script", "style", "svg", "nav", "footer", "noscript"}


def _without_forms(node: Node) -> list:
    """Children, those of a form in its place."""
    out: list = []
    for c in node.children:
        out += _without_forms(c) if isinstance(c, Node) and c.tag == "form" else [c]
    return out


def heading_questions(html: str | None) -> list[tuple[str, str]]:
    """(question, answer) of every heading that asks: what follows it up to the next
    heading is the answer, headings that only announce an answer are passed over."""
    out = []

    def visit(node: Node) -> None:
        items = [c for c in _without_forms(node) if isinstance(c, Node) and c.tag not in _CHROME]
        for at, n in enumerate(items):
            if n.tag in ("h2", "h3", "h4"):
                question = qabank.normalize_question(n.text(_CHROME))
                if qabank.looks_like_question(question):
                    parts = []
                    for later in items[at + 1 :]:
                        if later.tag in ("h1", "h2", "h3", "h4"):
                            if qabank.is_answer_heading(later.text(_CHROME)) and not qabank.looks_like_question(later.text(_CHROME)):
                                continue
                            break
                        t = qabank.clean_block(later.text(_CHROME))
                        if t and not qabank.is_boilerplate(t):
                            parts.append(t)
                    out.append((question, qabank.clean_answer("\n".join(parts))))
            visit(n)

    visit(parse(html))
    return out


def page_questions(html: str | None) -> list[tuple[str, str]]:
    """Questions of headings, then those of the page's text that were not among them."""
    found = heading_questions(html)
    seen = {qabank.question_key(q) for q, _ in found}
    body = parse(html)
    text = qabank.clean_block(_with_breaks(body, _BLOCKS, "\n"))
    for _, q, a in qabank.parse_items(text):
        key = qabank.question_key(q)
        if key and key not in seen:
            seen.add(key)
            found.append((q, a))
    return found


def voted_answers(html: str | None, least_yes: int = 1, least_net: int = 1, most: int = 1) -> list[tuple[str, str, str, int, int]]:
    """(question, answer, author, yes, no) of a page of one question whose answers
    were voted on; the best ``most`` by net votes, yes votes and length."""
    root = parse(html)
    hidden = {*_CHROME, "form"}
    asked = root.first(lambda n: n.tag == "p" and "question" in n.classes())
    described = root.first(lambda n: n.tag == "meta" and n.attrs.get("name") == "description")
    title = root.first(lambda n: n.tag == "title")
    raw = (asked.text(hidden) if asked else "") or (described.attrs.get("content", "") if described else "") or (title.text() if title else "")
    question = qabank.normalize_question(raw)
    if not qabank.looks_like_question(question):
        return []
    found = []
    for panel in root.walk():
        if panel.tag != "div" or not {"panel", "panel-default"} <= panel.classes() or panel.within(hidden):
            continue
        body = panel.first(lambda n: "panel-body" in n.classes())
        name = body.first(lambda n: n.tag == "p" and "name" in n.classes()) if body else None
        if name is None:
            continue
        author = re.sub(r"(?i)^Answer\s*/\s*", "", qabank.clean_inline(name.text(hidden)))
        removed = {id(n) for n in body.walk() if n.tag == "p" and "name" in n.classes() or n.tag == "table" and "marking" in n.classes() or n.tag in ("input", "button")}
        answer = re.sub(r"(?i)\bIs This Answer Correct\b.*\Z", "", qabank.clean_answer(_text_without(body, removed, hidden))).strip()
        votes = {word: int(m[1]) if (m := re.search(rf"(?i)(\d+)\s*{word}\b", panel.text(hidden))) else 0 for word in ("Yes", "No")}
        if len(answer) >= 12 and not qabank.is_boilerplate(answer) and votes["Yes"] >= least_yes and votes["Yes"] - votes["No"] >= least_net:
            found.append((question, answer, author, votes["Yes"], votes["No"]))
    found.sort(key=lambda x: (x[4] - x[3], -x[3], -len(x[1])))
    return found[:most]


def _text_without(node: Node, removed: set[int], hidden: set[str]) -> str:
    return "".join(c if isinstance(c, str) else "" if id(c) in removed or c.tag in hidden else _text_without(c, removed, hidden) for c in node.children)


def questions(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ordinal, question, answer, quality, error): the questions of every page. A
    page that cannot be read gives one row with the error and stops no other page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for k, h in zip(f["k"], f["h"]):
                try:
                    rows += [(k, i, q, a, qabank.quality_of(a, f"{q}\n{a}"), None) for i, (q, a) in enumerate(page_questions(h), 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((k, 0, None, None, None, qabank.clean_inline(str(e).split("\n")[0])[:260]))
            yield pd.DataFrame(rows, columns=["k", "ordinal", "question", "answer", "quality", "error"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("k"), F.col(html).alias("h"))
    return rows.mapInPandas(run, f"k {kind}, ordinal int, question string, answer string, quality string, error string").withColumnRenamed("k", key)


def source_questions(pages: DataFrame, registry: DataFrame, key: str, html: str, source: str, allow_unknown: bool = False) -> DataFrame:
    """``questions`` of the pages of all registered sources whose licence allows use, with
    the source; a page that cannot be read stops no other."""
    allowed = licensed(registry, allow_unknown).select(F.col("id").alias("_source"))
    chosen = pages.join(allowed, F.col(source) == F.col("_source"), "left_semi")
    return questions(chosen, key, html).join(chosen.select(key, source), key)


# ---- links ---------------------------------------------------------------------------


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href): distinct link targets of each page, found inside the JVM."""
    found = [F.regexp_extract_all(F.col(html), F.lit(rf"(?i)<a\b[^>]*\bhref\s*=\s*{q}([^{q}]+){q}"), F.lit(1)) for q in ('"', "'")]
    return pages.where(F.col(html).isNotNull()).select(F.col(key), F.explode(F.array_distinct(F.concat(*found))).alias("href"))


def reachable(edges: DataFrame, seeds: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(page, depth): pages reached from the seeds (page) over links (source, target),
    each at its least depth; one join a level, until a level brings nothing new."""
    found = frontier = cut(seeds.select("page").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while most_depth is None or depth < most_depth:
        depth += 1
        new = edges.join(frontier.select(F.col("page").alias("source")), "source", "left_semi").select(F.col("target").alias("page")).distinct()
        frontier = cut(new.join(found.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found
