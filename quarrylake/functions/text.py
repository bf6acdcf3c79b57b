"""Text columns. Every function takes and returns a Column and keeps null as null."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters, written out because regex dialects disagree on ``\\s``.
WS = r"[ \t\n\r\f\x{0B}\x{A0}\x{FEFF}]"



def _decomposed() -> tuple[str, str]:
    """Characters whose canonical decomposition is one character and marks, and these characters."""
    whole, plain = [], []
    for c in map(chr, range(0xC0, 0x2000)):
        first, *marks = unicodedata.normalize("NFD", c)
        if marks and all(unicodedata.category(m)[0] == "M" for m in marks) and unicodedata.category(first)[0] != "M":
            whole.append(c)
            plain.append(first)
    return "".join(whole), "".join(plain)


ACCENTED, PLAIN = _decomposed()


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: an expression that names a long one
    several times would hold it as often, and nested ones grow without bound."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def collapse_whitespace(c: Column) -> Column:
    """CR becomes LF, blanks one space, none around LF, at most one empty line."""
    c = F.regexp_replace(c, r"\r", "\n")
    c = F.regexp_replace(c, r"[\t\f\x{0B} ]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.btrim(c, F.lit(" \n\t\r"))


def clean_inline(c: Column) -> Column:
    """One line: no zero-width characters, straight quotes, single blanks."""
    c = F.regexp_replace(c, r"[\x{200B}\x{FEFF}]", "")
    c = F.regexp_replace(F.regexp_replace(c, "[“”]", '"'), "[‘’]", "'")
    return F.btrim(F.regexp_replace(c, f"{WS}+", " "))


def clean_block(c: Column) -> Column:
    """Lines cleaned like ``clean_inline``, none empty."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r", "\n"), r"[\t\x{A0}]+", " ")
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), clean_inline), lambda x: x != ""), "\n")


def clean_answer(c: Column) -> Column:
    """A cleaned block without the answer's marker and without links to comments at its end."""
    c = F.regexp_replace(clean_block(c), r"(?i)^(?:Ans|Answer)(?:\s*\d{1,4})?\s*[:\-]+\s*", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\bPost\s+a\s+Comment\b.*\z", ""), r"(?i)\bComments?\b\s*\z", "")
    return F.btrim(c, F.lit(" \n\t"))


def clean_label(c: Column) -> Column:
    """Without tags, on one line; null is empty."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", ""), f"{WS}+", " "))


def one_line(c: Column) -> Column:
    """Single blanks; null is empty."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def without_accents(c: Column) -> Column:
    """Lower case, canonically decomposed, without marks."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\p{M}+", "")


def fold_words(c: Column) -> Column:
    """Compatibility-decomposed and case-folded, every run of other characters than
    letters, digits and underscores one blank."""

    @F.pandas_udf("string")
    def words(s: pd.Series) -> pd.Series:
        folded = s.fillna("").str.normalize("NFKC").str.casefold().str.replace(r"\W+", " ", regex=True).str.strip()
        return folded.where(s.notna(), None)

    return words(c)


def fold(c: Column) -> Column:
    """Lower case without accents, single blanks."""
    c = without_accents(c)
    return F.btrim(F.regexp_replace(c, f"{WS}+", " "))


def slug(c: Column, length: int = 90, default: str = "item") -> Column:
    s = F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, length), F.lit("")), F.lit(default))


def snippet(c: Column, length: int = 240) -> Column:
    """The first ``length`` characters on one line, with an ellipsis if cut."""
    clean = F.btrim(F.translate(c, "\r\n\t", "   "))
    cut = F.btrim(F.substring(clean, 1, length))
    return F.when(F.length(cut) < F.length(clean), F.concat(cut, F.lit("…"))).otherwise(cut)


def decode_entities(c: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def safe_file_name(c: Column) -> Column:
    c = F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-")
    return F.substring(F.regexp_replace(c, r"-+", "-"), 1, 180)


def normalize_version(c: Column, prefix: str = r"(?i)^(?:release|version|v)\s*") -> Column:
    """Trimmed, without a leading product or release word; blank is null."""
    return F.nullif(F.btrim(F.regexp_replace(F.btrim(c), prefix, "")), F.lit(""))


def normalize_url(c: Column) -> Column:
    """Without fragment, view parameter and trailing slashes, in lower case."""
    c = F.regexp_replace(c, r"#.*$", "")
    c = F.regexp_replace(c, r"(?i)[?&]view=kc.*$", "")
    return F.lower(F.regexp_replace(c, r"/+$", ""))


def normalize_question(c: Column) -> Column:
    """Without question numbers and markers and without an inline answer."""
    c = clean_inline(c)
    c = F.regexp_replace(c, r"(?i)^(?:Q(?:uestion)? *)?\d{1,4}[.):] *", "")
    c = F.regexp_replace(c, r"(?i)^(?:Q(?:uestion)?)(?: *\d{1,4})? *[:\-] *", "")
    c = F.regexp_replace(c, r"(?i)^Q[A-Z0-9]{2,}[:.)]? +", "")
    c = F.regexp_replace(c, r"(?i)\b(?:Ans|Answer)(?: *\d{1,4})? *[:\-]+.*$", "")
    return F.btrim(F.regexp_replace(c, " +", " "))


def portable_path(sha: Column, row_id: Column, folder: str = "normalized", suffix: str = ".txt") -> Column:
    """A file name from the first 24 hexadecimal digits of the hash, else of the id."""
    digits = F.regexp_replace(F.coalesce(F.nullif(sha, F.lit("")), row_id), "[^a-fA-F0-9]", "")
    return F.concat(F.lit(folder + "/"), F.substring(digits, 1, 24), F.lit(suffix))


def is_safe_relative(path: Column) -> Column:
    return ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\x{00}")


def stable_id(question: Column, answer: Column, prefix: str = "qa-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(question, F.lit("\n"), answer), 256), 1, 24))


def stable_document_id(version: Column, key: Column, sha: Column, prefix: str = "doc") -> Column:
    """prefix-version-key-hash: the key as a file name of at most 72 characters, eight digits of the hash."""
    name = F.substring(F.lower(safe_file_name(F.coalesce(F.nullif(key, F.lit("")), F.lit("topic")))), 1, 72)
    return F.concat_ws("-", F.lit(prefix), F.regexp_replace(version, r"[^A-Za-z0-9_]", ""), name, F.substring(sha, 1, 8))


def topic_path(href: Column, mark: str = "../topic/") -> Column:
    """What follows the mark, without fragment, query and leading slashes; '' without the mark."""
    at = F.instr(href, mark)
    rest = F.regexp_replace(F.substring(href, at + F.lit(len(mark)), F.length(href)), r"^\.\./", "")
    rest = F.regexp_replace(F.substring_index(F.substring_index(rest, "#", 1), "?", 1), "^/+", "")
    return F.when(at > 0, rest).otherwise("")


def content_urls(base: str, href: Column, topic: Column, version: Column) -> Column:
    """Distinct addresses to try for a page, the one by its path before the one by its topic."""
    asked = "parsebody=true&lang=en"
    by_path = F.when(F.coalesce(href, F.lit("")) != "", F.concat(F.lit(f"{base}/content/"), href, F.lit(f"?{asked}")))
    by_topic = F.when(F.coalesce(topic, F.lit("")) != "", F.concat(F.lit(f"{base}/content/"), version, F.lit("?topic="), F.replace(F.url_encode(topic), F.lit("+"), F.lit("%20")), F.lit(f"&{asked}")))
    return F.array_distinct(F.array_compact(F.array(by_path, by_topic)))


def string_list(c: Column) -> Column:
    """A JSON array of strings; anything else is an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def split_list(c: Column, mark: str = ",") -> Column:
    """Distinct trimmed non-empty parts."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), mark), lambda x: F.btrim(x)), lambda x: x != ""))


def in_chunks(items: Column, size: int) -> Column:
    """An array cut into arrays of at most ``size``."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, size))


def day_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy.MM.dd")


def compose(question: Column, language: Column | None = None, code: Column | None = None) -> Column:
    """The question with a hint of the language and the code, those that are there."""
    part = lambda c, head: F.when(F.btrim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(head), F.btrim(c)))
    return F.concat_ws("\n\n", part(question, ""), *([part(language, "Language or environment hint: ")] if language is not None else []), *([part(code, "Code context:\n")] if code is not None else []))


def token_hint(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("int")


def fingerprint(c: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(F.btrim(c), 256), 1, length)


def pair_signature(q: Column, a: Column) -> Column:
    return F.sha2(F.concat(fold(q), F.lit("\n"), fold(a)), 256)


def distinct_ignoring_case(strings: Column) -> Column:
    """Each string once whatever its case, in the spelling that comes first."""
    folded = F.array_distinct(F.transform(strings, lambda x: F.collate(x, "UTF8_LCASE")))
    return F.transform(folded, lambda x: F.collate(x, "UTF8_BINARY"))


def unique_readable(strings: Column) -> Column:
    """On one line each, none empty, each once whatever its case."""
    return distinct_ignoring_case(F.filter(F.transform(strings, one_line), lambda x: x != ""))


def unique_strings(strings: Column) -> Column:
    """Cleaned, without a leading dash, each once whatever its case and accents."""
    clean = F.filter(F.transform(strings, lambda x: F.regexp_replace(clean_inline(x), "^[-–•]+ *", "")), lambda x: x != "")
    both = F.transform(clean, lambda x: F.struct(x.alias("x"), without_accents(x).alias("folded")))
    first = lambda b: F.filter(b, lambda y, i: F.array_position(b["folded"], y["folded"]) == i + 1)
    return F.transform(let(both, first), lambda y: y["x"])


def join_unique(fragments: Column, length: int) -> Column:
    """Distinct fragments joined by a blank, cut to ``length`` with an ellipsis."""
    joined = F.array_join(unique_readable(fragments), " ")
    return let(joined, lambda j: F.when(F.length(j) > length, F.concat(F.btrim(F.substring(j, 1, length)), F.lit("…"))).otherwise(j))


def combine_evidence(lead: Column, detail: Column, length: int = 1600) -> Column:
    """Lead and detail of one document; the lead alone if it holds the detail."""

    def combined(x: Column) -> Column:
        a, b = x["a"], x["b"]
        holds = (F.coalesce(b, F.lit("")) == "") | F.contains(F.lower(a), F.lower(b))
        return F.when(holds, a).otherwise(join_unique(F.array(a, b), length))

    return let(F.struct(lead.alias("a"), detail.alias("b")), combined)


def normalize_passage(c: Column, note: str = "Last Updated:", parent: str = "parent topic:") -> Column:
    """Paragraphs on one line each, without trails, date and parent lines, each once, joined by a blank."""
    parts = F.split(F.regexp_replace(c, r"\r", ""), r"\n{2,}")
    parts = F.transform(parts, lambda p: F.btrim(F.regexp_replace(p, f"{WS}+", " ")))
    parts = F.filter(parts, lambda p: (p != "") & (F.size(F.split(p, " > ")) < 3) & ~(p.contains(note) & (F.length(p) <= 240)) & ~F.lower(p).startswith(parent))
    return F.array_join(distinct_ignoring_case(parts), " ")


# Names of secrets whose values are hidden.
SECRETS = r"(password|passwd|pwd|token|secret|api[_-]?key)"


def redact(c: Column, mark: str = "[REDACTED]", length: int = 180) -> Column:
    """Keys, authorisation headers and named secrets are hidden; one line, cut to ``length``."""
    c = F.regexp_replace(c, r"(?is)-----BEGIN [^\r\n-]*PRIVATE KEY-----.*?-----END [^\r\n-]*PRIVATE KEY-----", "[PRIVATE KEY]")
    c = F.regexp_replace(c, r"(?i)\bAuthorization *: *(?:Bearer|Basic) +[^ \t\r\n,;]+", f"Authorization: {mark}")
    c = F.regexp_replace(c, rf"(?i)([\"']?{SECRETS}[\"']? *: *)[\"'][^\"']*[\"']", f'$1"{mark}"')
    c = F.regexp_replace(c, rf"(?i)\b{SECRETS} *[:=] *[^ \t\r\n,;]+", f"$1={mark}")
    c = F.regexp_replace(c, rf"(?i)\b{SECRETS} *\( *(?:'[^']*'|\"[^\"]*\") *\)", f"$1({mark})")
    c = F.btrim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))
    return F.when(F.length(c) <= length, c).otherwise(F.concat(F.substring(c, 1, length), F.lit("…")))


# Kinds of sections by the words of their headings, in order.
SECTION_KINDS = [
    ("syntax", "syntax|free-form|fixed-form|formato|sintaxis"),
    ("parameters", "parameter|operand|factor|par[aá]metro"),
    ("description", "description|usage|purpose|descripci[oó]n"),
    ("examples", "example|ejemplo|sample"),
    ("restrictions", "restriction|restricci[oó]n"),
    ("notes", "note|consideration|consideraci[oó]n"),
    ("messages", "message|mensaje|rnf|sql[0-9]"),
    ("recovery", "recovery|recover|cause|response|acci[oó]n"),
    ("related", "related|see also|referencia|api"),
]


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern occurs in the text, ignoring case."""
    out = None
    for name, pattern in rules:
        hit = c.rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def category(title: Column, breadcrumbs: Column, url: Column, body: Column | None = None, default: str = "general") -> Column:
    """The subject by the first rule that fits title, trail, address or the first 3,000 characters of the text."""
    hay = F.concat_ws(" ", title, F.array_join(breadcrumbs, " "), url, *([F.substring(body, 1, 3000)] if body is not None else []))
    return first_rule(fold(hay), CATEGORY_RULES, default)


def section_kind(title: Column) -> Column:
    return first_rule(title, SECTION_KINDS, "generic")


# Subject categories by words of title, path and text, in order; the labels are a parameter.
CATEGORY_RULES = [
    ("messages", r"\brnf[0-9]{4}\b|\brnf\b|rpg.*compiler.*message|compiler.*message.*rpg"),
    ("sql", r"\b(sqlrpgle|embedded sql|sql reference|db2|structured query language|sql)\b"),
    ("cl", r"\b(clle|control language|cl\b command|comandos cl)"),
    ("dds", r"\bdds\b|physical file|logical file|display file|printer file"),
    ("cobol", r"\bcobol\b"),
    ("c-cpp", r"\bc/c\+\+|ile c|ile c\+\+"),
    ("rpg", r"\brpg\b|rpgle|ile rpg|rpg iv|crtrpgmod|crtbndrpg"),
    ("commands", r"command|comando|crtpgm|crtsrvpgm|crtmod"),
]


# Titles of landing pages, words of index pages and of reference titles.
LANDING = r"^(welcome|home)$"
INDEX = r"\b(what'?s new|contents|table of contents|appendix|appendixes|index|overview)\b"
REFERENCE = r"\b(reference|programmer'?s guide|language reference|messages and codes|keyword finder)\b"
# Words of titles and trails of documents whose single lines are entries of their own.
ENTRY_WORDS = r"\b(finder|commands?|abbreviations?|keywords?|catalog|catalogue|messages?|apis?)\b"


def has_entries(kind: Column, title: Column, key: Column, breadcrumbs: Column) -> Column:
    """Whether single lines of the document stand for themselves."""
    path = F.lower(F.concat_ws(" ", title, key, F.array_join(breadcrumbs, " ")))
    return F.coalesce(kind.isin("index", "reference"), F.lit(False)) | path.rlike(ENTRY_WORDS)


def document_kind(title: Column, breadcrumbs: Column, length: Column, landing: str = LANDING) -> Column:
    """stub, landing, index, reference or topic; what names a landing page is a parameter."""
    t = F.lower(F.coalesce(title, F.lit("")))
    both = F.concat_ws(" ", t, F.lower(F.array_join(F.coalesce(breadcrumbs, F.array().cast("array<string>")), " ")))
    return (
        F.when((length > 0) & (length < 300), "stub")
        .when(t.rlike(landing), "landing")
        .when(both.rlike(INDEX), "index")
        .when(t.rlike(REFERENCE), "reference")
        .otherwise("topic")
    )


# Beginnings of command names, upper-case words that are no commands, and words left out of a title's slug.
COMMAND_PREFIXES = (
    "add", "alw", "ap", "call", "chg", "chk", "clr", "cpy", "crt", "dcl", "dlt", "dmp", "dsp", "ed", "end", "go", "grt",
    "hold", "mon", "ovr", "prt", "rcv", "rel", "rmv", "rnm", "rst", "rtv", "run", "sav", "sbm", "snd", "str", "tfr", "wrk",
)
GENERIC_TERMS = ("API", "CL", "COBOL", "DDS", "IBM", "ILE", "JCL", "RDI", "RPG", "SQL", "XML", "JSON", "HTML", "PDF", "PF", "LF")
TITLE_WORDS = r"\b(description of the|using the|command|keyword|operation code|built-in function|send a message to the joblog)\b"
# Forms of a built-in function, a message id and a hyphenated operation.
BUILT_IN = r"(?i)(%[A-Z][A-Z0-9_-]+)"
MESSAGE_ID = r"(?i)\b(RNF[0-9]{4}|CPF[0-9]{4}|MCH[0-9]{4}|SQL[0-9]{4,5})\b"
OPERATION = r"\b([A-Z]{2,}-[A-Z0-9-]+)\b"


def topic_key(title: Column, breadcrumbs: Column, category: Column) -> Column:
    """category:name, where the name is a built-in function, a message id, a
    hyphenated operation, a command in a command's context, else a slug of the title."""
    crumbs = F.array_join(F.coalesce(breadcrumbs, F.array().cast("array<string>")), " ")
    hay = F.concat_ws(" ", F.coalesce(title, F.lit("")), crumbs, F.coalesce(category, F.lit("")))
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    built_in = found(title, BUILT_IN)
    message = found(hay, MESSAGE_ID)
    operation = found(title, OPERATION)
    names = F.filter(F.regexp_extract_all(hay, F.lit(r"\b([A-Z][A-Z0-9]{1,11})\b"), F.lit(1)), lambda n: ~n.isin(*GENERIC_TERMS) & F.lower(n).rlike(f"^({'|'.join(COMMAND_PREFIXES)})[a-z0-9]+$"))
    command = F.when(hay.rlike(r"(?i)\bcommands?\b"), F.try_element_at(names, F.lit(1)))
    plain = F.regexp_replace(fold(title), TITLE_WORDS, " ")
    plain = F.btrim(F.regexp_replace(F.regexp_replace(plain, r"[()%]", " "), " +", " "))
    named = F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 80)
    return F.concat(F.coalesce(category, F.lit("")), F.lit(":"), F.lower(F.coalesce(built_in, message, operation, command, named, F.lit("topic"))))


def compact(c: Column, length: int = 1600) -> Column:
    """A normalised passage without numbers of fragments, each fragment once, cut after
    the last sentence that ends late enough."""
    whole = F.array_join(unique_readable(F.split(normalize_passage(c), r" +\d+\) +")), " ")

    def undoubled(words: Column) -> Column:
        twice = (F.size(words) == 2) & (F.lower(F.get(words, F.lit(0))) == F.lower(F.get(words, F.lit(1))))
        return F.when(twice, F.get(words, F.lit(0))).otherwise(F.array_join(words, " "))

    def clipped(cut: Column) -> Column:
        # where the last '. ', '; ' or ': ' stands, from the end
        marks = F.transform(F.array(*[F.lit(m) for m in (" .", " ;", " :")]), lambda m: F.nullif(F.call_function("position", m, F.reverse(cut)), F.lit(0)))
        at = F.length(cut) - F.coalesce(F.array_min(marks), F.lit(10**6))
        kept = let(at, lambda k: F.when(k >= int(length * 0.55) + 1, F.substring(cut, F.lit(1), k.cast("int"))).otherwise(cut))
        return F.concat(F.btrim(kept), F.lit("…"))

    return let(let(F.split(whole, " "), undoubled), lambda n: F.when(F.length(n) <= length, n).otherwise(let(F.substring(n, 1, length), clipped)))


def titled(title: Column, body: Column) -> Column:
    """'title: body', without the title where the body already begins with it."""

    def joined(x: Column) -> Column:
        t, b = x["t"], x["b"]
        return F.when((F.coalesce(t, F.lit("")) != "") & ~F.startswith(F.lower(b), F.lower(t)), F.concat(t, F.lit(": "), b)).otherwise(b)

    return let(F.struct(title.alias("t"), body.alias("b")), joined)


def release_in(*columns: Column, default: Column | None = None) -> Column:
    """The first release number from 7.3 to 7.6 in the texts, else the default."""
    found = F.nullif(F.regexp_extract(F.concat_ws(" ", *columns), r"\b(7\.[3456])\b", 1), F.lit(""))
    return F.coalesce(found, default) if default is not None else found


def is_loopback(url: Column) -> Column:
    """Whether a URL points to this machine."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.rlike(r"^(localhost|127(\.\d{1,3}){3}|\[?::1\]?|0\.0\.0\.0)$"), F.lit(False))


def has_loopback(record: Column) -> Column:
    """Whether any value of a JSON text under a key ending in url or endpoint, at any depth, points to this machine."""
    urls = F.regexp_extract_all(record, F.lit(r'(?i)"[^"]*(?:url|endpoint)"\s*:\s*"([^"]*)"'), F.lit(1))
    return F.coalesce(F.exists(urls, is_loopback), F.lit(False))


def is_shell(html: Column, title: str, mark: str, first: int = 2500) -> Column:
    """A page that has only the frame of the site: its general title and the mark of the frame near the top."""
    top = F.lower(F.substring(html, 1, first))
    return F.coalesce(F.contains(top, F.lit(f"<title>{title}</title>".lower())) & F.contains(top, F.lit(mark)), F.lit(False))


def is_thin(text: Column, title: Column, general_title: str, least: int = 120) -> Column:
    """A page too short to keep, or one that has only the general title of the site."""
    return (F.length(F.coalesce(text, F.lit(""))) < least) | (fold(F.coalesce(title, F.lit(""))) == general_title.lower())
