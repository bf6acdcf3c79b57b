"""Sections and chunks of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T

#: Blocks may start at lines like these (fixed values).
_BLOCK_WORDS = re.compile(r"(command|keyword|example|syntax|messages?|reference|guide|concepts?|programming)$", re.I)
_BLOCK_CAPS = re.compile(r"^[A-Z0-9_/%*()\[\] .,-]{4,}$")
_ENTRY = re.compile(r"\([^)A-Za-z0-9]*[A-Za-z0-9][^)]{1,120}\)\s+(command|keyword|function|view|table|operation|API)$", re.I)
_TERM = re.compile(r"^[A-Z][A-Z0-9_/%$#@*-]{1,15}$")
HEADING_CAPS = r"^[A-Z0-9_/%*()\[\] .,:;-]{4,}$"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line) of every line, trimmed."""
    return docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "raw")).select(key, (F.col("pos") + 1).alias("line_no"), F.btrim("raw", F.lit(" \t\r")).alias("line"))


def sections(docs: DataFrame, key: str, text: str, most: int = 80) -> DataFrame:
    """(key, section_index, section_kind, title, body, start_line, end_line).

    A heading is a line of at most 140 characters that names a kind of section, or
    one in capitals other than the first line; what stands before the first heading
    is left out. A text without headings is one 'description'. Everything stays
    inside the row of the document: an array of lines, its headings, and a slice
    between each heading and the next, so nothing is shuffled.
    """
    trim = lambda x: F.btrim(x, F.lit(" \t\r"))
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("t"), F.split(F.col(text), r"\r?\n").alias("lines"))
    n = F.size("lines")
    kinds = F.transform("lines", lambda x, i: F.struct((i + 1).alias("no"), trim(x).alias("title"), F.when(F.length(trim(x)) <= 140, T.section_kind(trim(x))).alias("kind")))
    # the kind of a line too long for a heading is not looked for
    heads = F.filter(kinds, lambda h: (h["title"] != "") & (F.length(h["title"]) <= 140) & ((h["kind"] != "generic") | (h["title"].rlike(HEADING_CAPS) & (h["no"] > 1))))
    found = lines.withColumn("heads", heads)
    spans = F.transform(
        "heads",
        lambda h, i: F.struct(
            i.cast("int").alias("section_index"), h["kind"].alias("section_kind"), h["title"].alias("title"), h["no"].cast("int").alias("start_line"),
            F.coalesce(F.try_element_at("heads", (i + 2).cast("int"))["no"] - 1, n).cast("int").alias("end_line"),
        ),
    )
    none = F.array(F.struct(F.lit(0).alias("section_index"), F.lit("description").alias("section_kind"), F.lit("Content").alias("title"), F.lit(0).alias("start_line"), n.cast("int").alias("end_line")))
    flat = found.select(key, "lines", F.inline(F.when(F.size("heads") == 0, none).otherwise(F.slice(spans, 1, most))))
    body = F.btrim(F.array_join(F.slice("lines", F.col("start_line") + 1, F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0))), "\n"), F.lit(" \t\r\n"))
    return flat.select(key, "section_index", "section_kind", "title", F.when(body == "", F.col("title")).otherwise(body).alias("body"), F.greatest("start_line", F.lit(1)).alias("start_line"), "end_line")


def structural_blocks(text: str) -> list[str]:
    blocks: list[str] = []
    now: list[str] = []
    for line in (x.strip() for x in text.split("\n")):
        heading = 0 < len(line) <= 120 and (_BLOCK_WORDS.search(line) or _BLOCK_CAPS.match(line))
        if now and (not line or heading):
            blocks.append("\n".join(now))
            now = []
        if line:
            now.append(line)
    if now:
        blocks.append("\n".join(now))
    return blocks or [text]


def cut_line(line: str, limit: int) -> Iterator[str]:
    """Cut at the last blank that is late enough, else at the limit."""
    while len(line) > limit:
        at = line.rfind(" ", 0, limit + 1)  # ends of sentences and clauses are blanks as well
        at = at + 1 if at >= int(limit * 0.6) else limit
        yield line[:at].strip()
        line = line[at:].lstrip()
    if line:
        yield line


def greedy_join(units: list[str], glue: str, limit: int) -> list[str]:
    out: list[str] = []
    for u in units:
        if out and len(out[-1]) + len(glue) + len(u) <= limit:
            out[-1] += glue + u
        else:
            out.append(u)
    return out


def read_sections(docs: DataFrame, found: DataFrame, key: str, text: str, most: int = 4000) -> DataFrame:
    """(key, section_index, section_kind, title, body, start_line, end_line): the sections
    found, and for a document without any its first ``most`` characters as one."""
    alone = docs.join(found.select(key).distinct(), key, "left_anti").where(F.btrim(F.col(text), F.lit(" \t\r\n")) != "")
    whole = alone.select(
        key, F.lit(0).alias("section_index"), F.lit("generic").alias("section_kind"), F.lit("Content").alias("title"),
        F.substring(text, 1, most).alias("body"), F.lit(1).alias("start_line"), F.size(F.split(text, "\n")).alias("end_line"),
    )
    return found.select(whole.columns).unionByName(whole)


def split_chunks(text: str, limit: int = 1800) -> list[str]:
    """Blocks packed greedily up to the limit; an empty text is one empty chunk."""
    clean = text.strip()
    if not clean:
        return [""]
    blocks: list[str] = []
    for block in structural_blocks(clean):
        if len(block) <= limit:
            blocks.append(block)
        else:
            blocks += greedy_join([u for line in re.split(r"\n+", block) for u in cut_line(line.strip(), limit)], "\n", limit)
    return greedy_join(blocks, "\n\n", limit)


def atomic_entries(text: str) -> list[str]:
    """Index lines that stand for themselves, and terms with the meaning on the next line."""
    lines = [x.strip() for x in re.split(r"\r?\n", text)]
    entries = [x for x in lines if 8 <= len(x) <= 220 and ">" not in x and _ENTRY.search(x)]
    meaning = lambda x: 3 <= len(x) <= 140 and ">" not in x and re.search("[a-z]", x)
    return entries + [f"{a} {b}" for a, b in zip(lines, lines[1:]) if _TERM.match(a) and meaning(b)]


def chunks(docs: DataFrame, key: str, text: str, limit: int = 1800, atomic: bool | Column = False) -> DataFrame:
    """(key, chunk_index, body, token_hint): packed chunks, and single entries of
    documents for which ``atomic`` holds (a value or a column, see ``has_entries``);
    chunks that differ only in blanks or case are kept once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t, single in zip(f["k"], f["t"], f["single"]):
                bodies = split_chunks(t or "", limit) + (atomic_entries(t or "") if single else [])
                seen: dict[str, str] = {}
                for b in bodies:
                    if b.strip():
                        seen.setdefault(re.sub(r"\s+", " ", b.strip()).lower(), b.strip())
                rows += [(k, i, b, -(-len(b) // 4)) for i, b in enumerate(seen.values() or [""])]
            yield pd.DataFrame(rows, columns=["k", "chunk_index", "body", "token_hint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.lit(atomic) if isinstance(atomic, bool) else F.coalesce(atomic, F.lit(False))).alias("single")).mapInPandas(run, f"k {kind}, chunk_index int, body string, token_hint int").withColumnRenamed("k", key)


def passage_windows(docs: DataFrame, key: str, text: str, least: int = 20, longest: int = 700, most: int = 8) -> DataFrame:
    """(key, window_no, window): sentences of at least ``least`` characters, two by two."""
    marked = F.regexp_replace(T.normalize_passage(F.col(text)), r"([.!?]) +", "$1\n")
    sentences = F.filter(F.transform(F.split(marked, "\n"), lambda x: F.btrim(x)), lambda s: F.length(s) >= least)
    base = docs.where(F.col(text).isNotNull()).select(F.col(key), sentences.alias("s")).where(F.size("s") > 0)
    starts = F.sequence(F.lit(1), F.size("s"), F.lit(2))
    windows = F.transform(starts, lambda i: F.substring(F.array_join(F.slice(F.col("s"), i, 2), " "), 1, longest))
    return base.select(key, F.posexplode(F.slice(F.array_distinct(windows), 1, most)).alias("window_no", "window"))


def query_perspectives(df: DataFrame, key: str, text: str, least: int = 24, most: int = 4) -> DataFrame:
    """(key, perspective, query): the whole question and its sentences."""
    clean = F.btrim(F.regexp_replace(F.col(text), r"[ \t\r\n]+", " "))
    sentences = F.filter(F.split(F.regexp_replace(clean, r"([.!?]) +", "$1\n"), "\n"), lambda s: (F.length(s) >= least) & (F.length(s) < F.length(clean)))
    views = F.slice(F.array_distinct(F.concat(F.array(clean), sentences)), 1, most)
    return df.where(F.coalesce(clean, F.lit("")) != "").select(F.col(key), F.posexplode(views).alias("perspective", "query"))


def assist_perspectives(df: DataFrame, key: str, question: str, language: str, code: str, most: int = 4) -> DataFrame:
    """(key, perspective, query): the question with its code, the same with a hint of the
    language, the question and its sentences, the code; each once."""
    clean = F.btrim(F.col(question))
    sentences = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(clean, r"[ \t\r\n]+", " "), r"([.!?]) +", "$1\n"), "\n"), lambda x: F.btrim(x)), lambda s: (F.length(s) >= 24) & (F.length(s) < F.length(clean)))
    views = F.concat(F.array(T.compose(F.col(question), code=F.col(code)), T.compose(F.col(question), F.col(language), F.col(code)), clean), sentences, F.array(F.btrim(F.col(code))))
    views = F.slice(F.array_distinct(F.filter(views, lambda v: F.coalesce(v, F.lit("")) != "")), 1, most)
    return df.where(F.coalesce(clean, F.lit("")) != "").select(F.col(key), F.posexplode(views).alias("perspective", "query"))


def neighbours_by_topic(docs: DataFrame, topic: str, key: str, most: int = 5) -> DataFrame:
    """(key, related, rank): other documents of the same topic, by key.

    Within a topic only the ``most`` + 1 smallest keys can be listed, so each row is
    joined with those alone and a large topic is not joined with itself.
    """
    heads = docs.where(F.coalesce(F.col(topic), F.lit("")) != "").select(topic, F.col(key).alias("related")).distinct()
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy(topic).orderBy("related"))).where(F.col("n") <= most + 1)
    base = docs.select(topic, key).distinct()
    pairs = base.join(heads, topic).where(F.col(key) != F.col("related"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key, topic).orderBy("related"))).where(F.col("rank") <= most).select(key, "related", "rank")
