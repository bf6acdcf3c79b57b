"""Questions and answers: parsing, terms, choosing and pairing."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import questions as Q
from quarrylake.functions import text as T
from quarrylake.operators.dedupe import first_per_key

# ---- the rules of functions.questions for parsers, on strings -----------------------

_START, _NAME, _ACTION = (re.compile(p) for p in (Q.QUESTION_START, Q.TECHNICAL_NAME, Q.ACTION))
_SIGN = re.compile(r"(?i)%[A-Z][A-Z0-9_-]*|\*[A-Z][A-Z0-9_]*")
_HEADING, _OPTION, _BOILER = (re.compile(p) for p in (Q.ANSWER_HEADING, Q.OPTION_LINE, Q.BOILERPLATE))
_CONCISE = [re.compile(p) for p in Q.CONCISE]
_MARK = r"(?:Ans|Answer)(?:\s*\d{1,4})?\s*[:\-]+"
_STARTS = (re.compile(r"(?i)^(?:Q(?:uestion)?\s*)?(\d{1,4})[.):]\s+(.+)$"), re.compile(r"(?i)^Q(?:uestion)?(?:\s*(\d{1,4}))?\s*[:\-]\s+(.+)$"), re.compile(r"(?i)^(Q(?=[A-Z0-9]*\d)[A-Z0-9]{2,})\s+(.+)$"))
_CODE = r"[A-Z0-9]{1,3}\d{3,5}"
_IMPERATIVE = re.compile(r"(?i)^((?:What|How|Why|When|Where|Which|Can|Do|Does|Is|Are|Will|Would|Explain|Describe|Define|List|Name|Differentiate|Difference)\b.{8,220}?)(?=\s+(?:[A-Z][a-z]{2,}|\*?[A-Z0-9]{2,}|[0-9]))(.+)$")
_AFTER = re.compile(r"(?i)^(?:Related Posts|Posted Under|No comments|Subscribe to|Copyright|Contact Us|About Us)\b")


def clean_inline(s: str) -> str:
    s = re.sub("[​﻿]", "", s)
    return re.sub(r"\s+", " ", re.sub("[‘’]", "'", re.sub("[“”]", '"', s))).strip()


def clean_block(s: str) -> str:
    lines = map(clean_inline, s.replace("\r", "\n").split("\n"))
    return "\n".join(x for x in lines if x)


def clean_answer(s: str) -> str:
    s = re.sub(rf"(?i)^{_MARK}\s*", "", clean_block(s))
    s = re.sub(r"(?i)\bPost\s+a\s+Comment\b.*\Z", "", s)
    return re.sub(r"(?i)\bComments?\b\s*\Z", "", s).strip()


def normalize_question(s: str) -> str:
    s = clean_inline(s)
    for p in (r"(?i)^(?:Q(?:uestion)?\s*)?\d{1,4}[.):]\s*", r"(?i)^Q(?:uestion)?(?:\s*\d{1,4})?\s*[:\-]\s*", r"(?i)^Q[A-Z0-9]{2,}[:.)]?\s+", rf"(?i)\b{_MARK}.*$"):
        s = re.sub(p, "", s)
    return re.sub(r"\s+", " ", s).strip()


def question_key(s: str) -> str:
    """Letters and digits without case and accents: what makes two questions the same."""
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c)[0] != "M").lower()
    return re.sub("[^a-z0-9]+", " ", s).strip()


def looks_like_question(s: str) -> bool:
    s = clean_inline(s)
    return len(s) >= 8 and ("?" in s or bool(_START.search(s)) or bool((_NAME.search(s) or _SIGN.search(s)) and _ACTION.search(s)))


def is_answer_heading(s: str) -> bool:
    return bool(_HEADING.search(clean_inline(s)))


def is_boilerplate(s: str) -> bool:
    return bool(_BOILER.search(clean_inline(s)))


def is_concise(s: str) -> bool:
    s = re.sub(r"[.;,]+$", "", clean_inline(s))
    return bool(s) and any(p.search(s) for p in _CONCISE)


def is_usable(s: str) -> bool:
    return len(clean_inline(s)) >= 12 or is_concise(s)


def is_answer_line(s: str) -> bool:
    s = clean_inline(s)
    if not s or _OPTION.search(s):
        return False
    return bool(re.search(r"(?i)^(ans|answer)\b", s) or (re.search("[,.;:]", s) and len(s) > 5) or re.search(r"%[A-Z]|\*[A-Z]|\b[A-Z]{3,}\b", s)) or len(s.split(" ")) >= 3


def quality_of(answer: str, raw: str) -> str:
    s = clean_inline(answer)
    if not s:
        return "question-only"
    if re.search(r"(?i)^([A-E](?:\s*,\s*[A-E])*)$", s) or re.search(r"(?i)\bAnswer\s*:\s*[A-E]\b", raw):
        return "multiple-choice"
    return "answered" if is_concise(s) or len(s) >= 12 else "partial"


# ---- parsers -------------------------------------------------------------------------


def _lines(text: str) -> list[str]:
    return [x for x in map(clean_inline, text.replace("\r", "\n").split("\n")) if x and not is_boilerplate(x)]


def _question_start(line: str) -> tuple[str, str] | None:
    for p in _STARTS:
        if m := p.match(line):
            rest = clean_inline(m[2])
            if len(rest) >= 4 and (p is _STARTS[2] or not _OPTION.search(rest)):
                return m[1] or "", rest
    return None


def _divide(ordinal: str, lines: list[str]) -> tuple[str, str, str]:
    """Question and answer of the lines that belong to one number."""
    joined = clean_block("\n".join(lines))
    if m := re.search(rf"(?i)\b{_MARK}", joined):
        return ordinal, normalize_question(joined[: m.start()]) or normalize_question(lines[0]), clean_answer(joined[m.end() :])
    if "?" in lines[0] and any(map(is_answer_line, lines[1:])):
        return ordinal, normalize_question(lines[0]), clean_answer(" ".join(lines[1:]))
    at = joined.find("?")
    if 8 <= at <= 280:
        question, answer = normalize_question(joined[: at + 1]), clean_answer(joined[at + 1 :])
        if looks_like_question(question) and is_usable(answer):
            return ordinal, question, answer
    return ordinal, normalize_question(joined), ""


def parse_numbered(text: str) -> list[tuple[str, str, str]]:
    """(ordinal, question, answer) of numbered or marked questions and what follows each."""
    # numbers in the middle of a line begin a line of their own if a question follows
    text = re.sub(r"(?i)\s+(?=(?:Q(?:uestion)?\s*)?\d{1,4}[.):]\s+[^.\n]{4,220}\?)", "\n", text.replace("\r", "\n"))
    items: list[tuple[str, list[str]]] = []
    for line in _lines(re.sub(r"(?i)\s+(?=Q\d{1,4}[.):]?\s+[^.\n]{4,220}\?)", "\n", text)):
        if start := _question_start(line):
            items.append((start[0], [start[1]]))
        elif items and not re.fullmatch("(?i)[A-E]", line):
            items[-1][1].append(line)
    return [x for x in (_divide(o, lines) for o, lines in items if len(clean_block("\n".join(lines))) >= 8) if len(x[1]) >= 8]


def parse_marked(text: str) -> list[tuple[str, str, str]]:
    """Questions followed within four lines by a line that begins an answer; the answer
    goes on to the next question."""
    lines, out = _lines(text), []
    for at, line in enumerate(lines):
        question = normalize_question(line)
        if not looks_like_question(question):
            continue
        begin = None
        for k in range(at + 1, min(len(lines), at + 5)):
            if re.match(r"(?i)(?:Ans|Answer)\b", lines[k]):
                begin = k
                break
            if looks_like_question(lines[k]):
                break
        if begin is None:
            continue
        parts = [clean_answer(re.sub(r"(?i)^(?:Ans|Answer)\b\s*[:\-]?\s*", "", lines[begin]))]
        for later in lines[begin + 1 :]:
            if looks_like_question(later) or _AFTER.match(later):
                break
            if not is_answer_heading(later):
                parts.append(later)
        answer = clean_answer("\n".join(x for x in parts if x))
        if is_usable(answer):
            out.append((str(len(out) + 1), question, answer))
    return out


def parse_coded(text: str) -> list[tuple[str, str, str]]:
    """Questions and answers that codes such as QL40158 and AL40158 set apart."""
    whole = clean_inline(re.sub(rf"\b([QA]{_CODE})\b", r" \1 ", clean_block(text)))
    found, out = list(re.finditer(rf"(?i)\b(Q{_CODE})\b", whole)), []
    for m, end in zip(found, [*(x.start() for x in found[1:]), len(whole)]):
        part = clean_inline(whole[m.end() : end])
        code = re.search(rf"(?i)\bA{_CODE}\b", part)
        if not code:
            continue
        before, after = clean_inline(part[: code.start()]), clean_inline(part[code.end() :])
        both = clean_inline(f"{before} {after}")
        at = both.find("?")
        if before and looks_like_question(before):
            pair = (before, after)
        elif 8 <= at <= 320:
            pair = (both[: at + 1], both[at + 1 :])
        elif split := _IMPERATIVE.match(both):
            pair = (split[1], split[2])
        else:
            continue
        question, answer = normalize_question(pair[0]), clean_answer(pair[1])
        if looks_like_question(question) and len(answer) >= 2 and not is_boilerplate(answer):
            out.append((m[1], question, answer))
    return out


def parse_items(text: str) -> list[tuple[str, str, str]]:
    """Coded, then marked, then numbered questions, each question once."""
    seen: dict[str, tuple[str, str, str]] = {}
    for item in (*parse_coded(text), *parse_marked(text), *parse_numbered(text)):
        key = question_key(item[1])
        if key:
            seen.setdefault(key, item)
    return list(seen.values())


def text_questions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, question, answer, quality) of every question in the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, o, q, a, quality_of(a, f"{q}\n{a}")) for k, t in zip(f["k"], f["t"]) for o, q, a in parse_items(t)]
            yield pd.DataFrame(rows, columns=["k", "ordinal", "question", "answer", "quality"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, ordinal string, question string, answer string, quality string").withColumnRenamed("k", key)


def make_cases(found: DataFrame, prefix: str = "qb") -> DataFrame:
    """Found (source, ordinal, question, answer) as rows of a bank: id, question, language,
    expected answer, terms of answer and evidence, quality."""
    q, a = T.normalize_question(F.col("question")), T.clean_answer(F.coalesce("answer", F.lit("")))
    base = found.select("source", "ordinal", q.alias("question"), a.alias("answer"))
    said = F.when(F.col("answer") != "", F.col("answer")).otherwise(F.col("question"))
    both = F.concat_ws("\n", "question", "answer")
    terms = Q.evaluation_terms(said, F.col("question"), 16)
    evidence = F.slice(T.unique_strings(F.concat(Q.evaluation_terms(both, F.col("question"), 18), terms)), 1, 22)
    name = F.regexp_replace(F.concat_ws("-", F.lit(prefix), T.slug(F.col("source")), F.col("ordinal").cast("string"), T.slug(F.col("question"), 70)), "-+$", "")
    return base.select(name.alias("id"), "source", "question", Q.language_of(both).alias("lang"), said.alias("expected_answer_summary"), terms.alias("answer_must_contain_any"), evidence.alias("evidence_must_contain_any"), Q.answer_quality(F.col("answer"), both).alias("extraction_quality"))


# ---- choosing --------------------------------------------------------------------------


def question_dedupe(bank: DataFrame, question: str, answer: str, order: str) -> DataFrame:
    """One row for each folded question and answer, the first by ``order``; rows without either stay out."""
    keyed = bank.withColumn("_q", T.fold(F.col(question))).withColumn("_a", T.fold(F.col(answer))).where("_q <> '' and _a <> ''")
    return first_per_key(keyed, ["_q", "_a"], [order]).drop("_q", "_a")


def merge_questions(primary: DataFrame, secondary: DataFrame, question: str, order: str) -> DataFrame:
    """Rows of both lists, each question (letters and digits, folded) once: the first of
    the primary list, else the first of the secondary one."""
    both = primary.withColumn("_list", F.lit(0)).unionByName(secondary.withColumn("_list", F.lit(1)))
    keyed = both.withColumn("_key", F.btrim(F.regexp_replace(T.without_accents(F.col(question)), "[^a-z0-9]+", " "))).where("_key <> ''")
    return first_per_key(keyed, ["_key"], ["_list", order]).drop("_key", "_list")


def ranked_answers(bank: DataFrame, question_id: str, score: str, yes: str, answer: str, order: str, most: int = 2) -> DataFrame:
    """Adds ``place``: by score, then approvals, then length, best ``most`` of a question."""
    w = Window.partitionBy(question_id).orderBy(F.desc_nulls_last(score), F.desc_nulls_last(yes), F.length(answer).desc_nulls_last(), order)
    return bank.where(F.col(question_id).isNotNull()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def by_policy(bank: DataFrame, accepted: str, score: str, least: int) -> DataFrame:
    """Accepted answers, and others of at least the score."""
    return bank.where(F.coalesce(F.col(accepted), F.lit(False)) | (F.coalesce(F.col(score), F.lit(-1)) >= least))


def terms(df: DataFrame, key: str, primary: str, question: str, most: int = 12) -> DataFrame:
    """(key, terms) of an answer and its question."""
    return df.select(F.col(key), Q.evaluation_terms(F.col(primary), F.col(question), most).alias("terms"))


def usable_cases(bank: DataFrame, quality: str, question: str, answer: str) -> DataFrame:
    """Cases to learn from: answered or partly, long enough, and not asking back."""
    ok = F.col(quality).isin("answered", "partial") & (F.length(F.btrim(question)) >= 8) & (F.length(F.btrim(answer)) >= 24)
    return bank.where(ok & ~Q.is_unanswered_prompt(F.col(answer)))


def section_pairs(sections: DataFrame, records: DataFrame) -> DataFrame:
    """(section_id, query, passage): training pairs of a document's title with a
    section's heading, and the section's text, cut to 4,000 characters."""
    first = first_per_key(records.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"), "record_no"), ["document_id"], ["record_no"])
    rows = sections.join(first, "document_id").select("section_id", F.concat_ws(" ", "doc_title", "title").alias("query"), F.substring(F.btrim("body"), 1, 4000).alias("passage"))
    return rows.where((F.length("query") >= 8) & (F.length("passage") >= 24))


def lead_chunks(records: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(document_id, title, body, vector): documents with their first chunk and their vector."""
    first = first_per_key(records.select(F.col("id").alias("document_id"), "title", "record_no"), ["document_id"], ["record_no"]).drop("record_no")
    lead = first_per_key(chunks.where("chunk_index = 0").select("document_id", "chunk_id", "body"), ["document_id"], ["chunk_id"])
    return first.join(lead, "document_id").join(vectors, "document_id")
