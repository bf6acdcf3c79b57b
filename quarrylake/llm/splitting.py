"""Splitting long texts by a hierarchy of separators.

A text is cut at paragraphs; only parts that are still too long are cut at lines,
then sentences, words and at last characters. The parts are packed greedily up to
the limit, and each piece begins with up to ``overlap`` characters of the piece
before, taken from a word start. Work is local to a row: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = " \t\r\n"
LEVELS = ("paragraph", "line", "sentence", "word", "none")
#: Where each level may cut: after the match.
CUTS = (
    re.compile(r"\r?\n(?:[ \t]*\r?\n)+"),
    re.compile(r"\r?\n"),
    re.compile(r"\r?\n|(?<=[.!?])[ \t]+"),
    re.compile(r"[ \t\r\n]+"),
)


def trimmed_length(text: str, start: int, end: int) -> int:
    return len(text[start:end].strip(BLANK))


def _cut(text: str, start: int, end: int, level: int) -> Iterator[tuple[int, int]]:
    at = start
    for m in CUTS[level].finditer(text, start, end):
        if m.end() > at and m.end() < end:
            yield at, m.end()
            at = m.end()
    yield at, end


def atoms(text: str, limit: int) -> tuple[list[tuple[int, int]], int]:
    """Consecutive spans that cover the text, each at most ``limit`` long without
    outer blanks, and the deepest level that was cut (-1: none)."""
    deepest = -1
    out: list[tuple[int, int]] = []
    stack = [(0, len(text), 0)]
    while stack:
        s, e, level = stack.pop()
        if trimmed_length(text, s, e) <= limit:
            out.append((s, e))
            continue
        deepest = max(deepest, level)
        if level == len(CUTS):
            out += [(p, min(p + limit, e)) for p in range(s, e, limit)]
            continue
        stack += [(a, b, level + 1) for a, b in reversed(list(_cut(text, s, e, level)))]
    return out, deepest


def split_text(text: str, limit: int = 1800, overlap: int = 150) -> tuple[list[tuple[int, int, int]], str | None]:
    """Pieces (start, end, shared) of the text, where the first ``shared``
    characters repeat the end of the piece before, and the boundary level."""
    parts, deepest = atoms(text, limit)
    pieces: list[tuple[int, int, int]] = []
    i = 0
    while i < len(parts):
        own = parts[i][0]
        start = own
        if pieces:
            room = limit - (parts[i][1] - own)
            back = max(pieces[-1][0], own - max(0, min(overlap, room)))
            if back < own:
                if back > 0 and text[back - 1] not in BLANK:
                    m = CUTS[3].search(text, back, own)
                    back = m.end() if m else (back if deepest == len(CUTS) else own)
                start = back
        j = i
        while j + 1 < len(parts) and trimmed_length(text, start, parts[j + 1][1]) <= limit:
            j += 1
        pieces.append((start, parts[j][1], own - start))
        i = j + 1
    return pieces, (LEVELS[deepest] if deepest >= 0 else None)


def split_items(df: DataFrame, item_kind: str, item_id: str, body: str, limit: int = 1800, overlap: int = 150) -> DataFrame:
    """(item_kind, item_id, boundary, piece_index, start_pos, end_pos, shared,
    piece): every piece of every item longer than ``limit``.

    ``boundary`` is the coarsest level whose cuts alone leave no piece above the
    limit. Null and blank texts and those within the limit yield no row (they are
    their own only piece). Long texts are filtered inside the JVM, so Python sees
    only those. Repeated rows are split each; extra columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for item, text in zip(f["id"].tolist(), f["body"].tolist()):
                pieces, boundary = split_text(text, limit, overlap)
                rows += [(item_kind, item, boundary, i, s, e, k, text[s:e]) for i, (s, e, k) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "boundary", "piece_index", "start_pos", "end_pos", "shared", "piece"])

    long_ones = df.select(F.col(item_id).alias("id"), F.col(body).alias("body")).where(F.length(F.btrim(F.col("body"), F.lit(BLANK))) > limit)
    kind = df.schema[item_id].dataType.simpleString()
    return long_ones.mapInPandas(run, f"item_kind string, item_id {kind}, boundary string, piece_index int, start_pos int, end_pos int, shared int, piece string")
