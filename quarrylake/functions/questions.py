"""Columns that judge questions and answers of a bank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylake.functions import text as T

# How questions begin; names and actions of technical titles without a question mark.
QUESTION_START = r"(?i)^(what|how|why|when|where|which|can|do|does|is|are|will|would|explain|describe|define|list|name|compare|differentiate|difference)\b"
TECHNICAL_NAME = r"(?i)\b(AS\/?400|iSeries|System\s+i|RPGLE|RPG\/400|RPG400|SQLRPGLE|DB2-400|CLLE|CL\/400|DDS|QSYS|QSYS2|SNDDST|SNDPGMMSG|QCMDEXC|SBMJOB|WRKACTJOB|WRKJOB|DSPFFD|DSPFD|STRDBG|STRSRVJOB|MONMSG|OVRDBF|DCLF|RCVF|CHAIN|SETLL|READE?|READP)\b"
ACTION = r"(?i)\b(error|issue|problem|compile|compiling|convert|conversion|retrieve|read|write|update|lock|locked|job|queue|spool|subfile|program|procedure|service|module|file|table|library|command|message|timestamp|date|time|send|mail|email|call|access|open|close|debug|submit|copy|move|delete|display|view|monitor|handle|pass|allocate|declare|create|change|set|get|select|insert|run|execute|join|override|format|field|record|parameter|api|trying|need|want)\b"
ANSWER_HEADING = r"(?i)^(?:Ans|Answer)(?:\s*\d{1,4})?\s*[:\-]?$"
OPTION_LINE = r"^[A-E][.)]\s+|^\([A-Ea-e]\)\s+"
BOILERPLATE = r"(?i)^(home|sign in|register|comments?|post comments?|older post|newer post|about me|popular posts|follow us|copyright|save|share|menu)$|subscribe to|powered by|site map"
# Languages by what a question mentions, in order.
LANGUAGES = [
    ("SQLRPGLE", r"\bSQLRPGLE\b|embedded\s+sql|sqlcode|sqlstate|\bdb2\b|\bselect\b|\binsert\b|\bupdate\b|\bdelete\b"),
    ("DDS", r"\bDDS\b|subfile|\bSFL[A-Z0-9]*\b|physical\s+file|logical\s+file|display\s+file|printer\s+file|\bPF\b|\bLF\b"),
    ("CLLE", r"\bCLLE\b|\bCLP?\b|MONMSG|SBMJOB|RTVJOBA|DCLF|RCVF|OVRDBF|DLTOVR|\bCMD\b|command"),
    ("RPGLE", r"\bRPGLE\b|\bRPG\b|ILE\s+RPG|opcode|\bCHAIN\b|\bREADE?\b|\bSETLL\b|\bEVAL\b|%[A-Z0-9_-]+"),
]
# Answers that are complete though short.
CONCISE = [
    r"(?i)^(?:yes|no|true|false)$", r"^\d+(?:\.\d+)?$", r"^['\"]?[-+*/=<>]+'?\"?$", r"(?i)^%[A-Z][A-Z0-9_-]*$", r"(?i)^\*[A-Z][A-Z0-9_]*$",
    r"(?i)^[A-Z][A-Z0-9_#@$-]{2,}$", r"(?i)^(?:CL|RPG\/400|CL\/400|DB2\/400)$", r"^[A-Z0-9_#@$%*/+-]{2,}(?:\/[A-Z0-9_#@$%*/+-]{2,})+$",
]
# A question that breaks off, offers of training, answers that only ask back.
BROKEN_OFF = r"(?i)which are mandatory and which\s*$"
HANGING = r"(?i)\b(which|what|where|when|why|how|and|or|with|without|from|for|to)\s*$"
TRAINING_OFFER = r"\b(virtual academy|training provider|course availability|completion certificate|certifications?|certified|enroll|instructor[- ]?led|bootcamp|global training)\b"
ASKING_BACK = ["can you relate it", "what would you look for", "how would you assess", "what makes a good answer", "listen for", "look for"]
NOT_GIVEN = ["click here for the answer", "answer not available", "refer to the following", "please explain"]
# Phrases that count as terms, and words that do not.
PHRASES = [
    "access path", "activation group", "batch job", "binding directory", "commitment control", "data area", "data queue", "display file", "externally described file", "job queue", "journal receiver", "library list",
    "logical file", "message queue", "module object", "packed decimal", "physical file", "record format", "record lock", "service program", "source physical file", "subfile control", "subfile record", "system value",
]
STOPWORDS = [
    "about", "after", "again", "also", "and", "answer", "because", "before", "between", "but", "can", "cannot", "command",
    "could", "define", "describe", "difference", "does", "each", "explain", "file", "following", "from", "have", "how", "into",
    "list", "many", "much", "only", "program", "question", "should", "that", "the", "their", "there", "these", "this", "through",
    "used", "using", "what", "when", "where", "which", "with", "within", "without", "would", "your", "para", "una", "uno", "los", "las",
]


def _any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def looks_like_question(c: Column) -> Column:
    """At least eight characters with a question mark, a question's beginning, or a technical name and an action."""

    def asks(t: Column) -> Column:
        technical = (t.rlike(TECHNICAL_NAME) | t.rlike(r"(?i)%[A-Z][A-Z0-9_-]*|\*[A-Z][A-Z0-9_]*")) & t.rlike(ACTION)
        return (F.length(t) >= 8) & (t.contains("?") | t.rlike(QUESTION_START) | technical)

    return T.let(T.clean_inline(F.coalesce(c, F.lit(""))), asks)


def is_option_line(c: Column) -> Column:
    return c.rlike(OPTION_LINE)


def is_answer_heading(c: Column) -> Column:
    return T.clean_inline(c).rlike(ANSWER_HEADING)


def is_answer_line(c: Column) -> Column:
    """A line that could be an answer: marked, punctuated, with a name, or of three words."""
    t = T.clean_inline(F.coalesce(c, F.lit("")))
    said = t.rlike(r"(?i)^(ans|answer)\b") | (t.rlike(r"[,.;:]") & (F.length(t) > 5)) | t.rlike(r"%[A-Z]|\*[A-Z]|\b[A-Z]{3,}\b") | (F.size(F.split(t, " ")) >= 3)
    return (t != "") & ~is_option_line(t) & said


def is_boilerplate(c: Column) -> Column:
    return T.clean_inline(c).rlike(BOILERPLATE)


def is_concise(c: Column) -> Column:
    """A short but complete technical answer: yes, a number, an operator, a name, a path."""
    t = F.regexp_replace(T.clean_inline(F.coalesce(c, F.lit(""))), r"[.;,]+$", "")
    return (t != "") & _any(t, CONCISE)


def is_usable_answer(c: Column) -> Column:
    t = T.clean_inline(F.coalesce(c, F.lit("")))
    return (t != "") & ((F.length(t) >= 12) | is_concise(t))


def answer_quality(answer: Column, raw: Column) -> Column:
    """question-only, multiple-choice, answered or partial."""
    t = T.clean_inline(F.coalesce(answer, F.lit("")))
    choice = t.rlike(r"(?i)^([A-E](?:\s*,\s*[A-E])*)$") | F.coalesce(raw, F.lit("")).rlike(r"(?i)\bAnswer\s*:\s*[A-E]\b")
    return F.when(t == "", "question-only").when(choice, "multiple-choice").when(is_concise(t), "answered").when(F.length(t) < 12, "partial").otherwise("answered")


def language_of(c: Column, default: str = "general") -> Column:
    """The programming language a question is about."""
    return T.first_rule(F.coalesce(c, F.lit("")), LANGUAGES, default)


def is_relevant(title: Column, body: Column, tags: Column, domain: str) -> Column:
    """Whether title, body or tags mention the domain (a pattern of folded words)."""
    return T.without_accents(F.concat_ws("\n", title, body, F.array_join(tags, " "))).rlike(domain)


def breaks_off(question: Column) -> Column:
    """A question cut off before its end."""
    t = T.clean_inline(F.coalesce(question, F.lit("")))
    return (t != "") & (t.rlike(BROKEN_OFF) | (t.rlike(HANGING) & (F.length(t) < 180)))


def is_noise(question: Column, answer: Column, unrelated: list[str], signal: str = TECHNICAL_NAME) -> Column:
    """Offers of training, questions that break off, and pairs with words of unrelated
    fields (``unrelated``): two of them, one beside three 'read more', or one without
    a technical name (``signal``)."""
    both = F.concat_ws("\n", question, answer)
    folded = T.without_accents(both)
    n = sum((F.contains(folded, F.lit(u)).cast("int") for u in unrelated), F.lit(0))
    more = F.regexp_count(folded, F.lit(r"\bread more\b"))
    technical = both.rlike(signal) | both.rlike(r"(?i)\b(?:CPF|MCH|RNF|SQL)\d{4,5}\b") | both.rlike(r"(?i)%[A-Z][A-Z0-9_-]*|\*[A-Z][A-Z0-9_]*")
    return folded.rlike(TRAINING_OFFER) | breaks_off(question) | (n >= 2) | ((more >= 3) & (n >= 1)) | (~technical & (n >= 1))


def is_unanswered_prompt(answer: Column, fragments: list[str] | None = None) -> Column:
    """An answer that asks back or says that it is elsewhere."""
    folded = T.fold(F.coalesce(answer, F.lit("")))
    out = folded.endswith("?")
    for f in fragments or [*ASKING_BACK, *NOT_GIVEN]:
        out = out | folded.contains(f)
    return out


def evaluation_terms(primary: Column, question: Column, most: int = 12) -> Column:
    """Phrases that occur, then technical names, then words of four letters that are
    no stop words, each once; without any the first eight words of the question."""
    both = F.concat_ws("\n", F.coalesce(primary, F.lit("")), F.coalesce(question, F.lit("")))
    phrases = T.let(T.without_accents(both), lambda folded: F.filter(F.array(*[F.lit(p) for p in PHRASES]), lambda p: F.contains(folded, p)))
    names = F.regexp_extract_all(both, F.lit(r"%[A-Z][A-Z0-9_-]*|\*[A-Z][A-Z0-9_]*|\b[A-Z]{2,}[A-Z0-9_#@$-]+"), F.lit(0))
    names = F.filter(names, lambda w: (F.length(w) > 1) & (F.upper(w) != "AS400"))
    words = F.filter(F.split(F.regexp_replace(both, "[%*#@$]", " "), "[^A-Za-z0-9_-]+"), lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(STOPWORDS) & ~w.rlike(r"^\d+$"))
    terms = F.slice(F.filter(T.unique_strings(F.concat(phrases, names, words)), lambda w: F.length(w) >= 3), 1, most)
    first = F.array_join(F.slice(F.split(T.clean_inline(F.coalesce(question, F.lit(""))), " "), 1, 8), " ")
    other = F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>"))
    return T.let(terms, lambda t: F.when(F.size(t) > 0, t).otherwise(other))
