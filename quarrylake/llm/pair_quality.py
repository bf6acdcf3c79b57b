"""Defective question-answer pairs.

A multi-label linear classifier over hashed n-grams of the answer and features of
the pair. It is fitted on a bounded sample of the bank: the rows as they are count
as sound, and from them broken ones are made, by emptying, cutting off, copying
the question, refusing, and swapping in answers of another language. Rows of the
sample that the first model finds broken are then left out or relabelled and the
model is fitted once more; thresholds are calibrated on a held-out part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import WordHashes
from quarrylake.llm.linear import Linear, Rows, bounded_sample, calibrated, fit

DEFECTS = ("empty", "truncated", "refusal", "copies_question", "other_language")
BITS = 15
SAMPLE = 6000

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_MARKUP = re.compile(r"<[^<>]*>|&\w+;|&#\d+;")
_NAME = re.compile(r"\d|^[A-Z]{3,}|\w[A-Z]{2}")
_END = re.compile(r"[.!?。](?:[\"'»)\]]*)\s*$")
_OPEN_ITEM = re.compile(r"\n\s*(?:\d{1,3}[.)]|[-*•])\s*$|```[^`]*$")
_CUT_MARK = re.compile(r"(?:\[[^\[\]]{2,20}\]|\.\.\.|…)\s*$")

# Frequent words that tell the languages of the bank apart.
STOPWORDS = {
    "en": "the of and to is in that it for with be are was on as by this not or can from when what which must after before how does only have has an at if you do",
    "es": "el la los las de que y en un una es por con para no se del al lo como más su está cuando qué sin antes hasta debe puede dónde cómo este",
    "fr": "le la les des de et en un une est que pour dans pas du au ne ce qui sur avec par il vous nous où comment quelle peut doit être sans après jusqu",
    "de": "der die das und ist nicht ein eine zu den mit von für auf dem des im wird sich sie wie oder wenn bei nach auch kann muss darf werden wo welcher ohne",
}
_LANGS = tuple(STOPWORDS)
_STOP: dict[str, list[tuple[int, float]]] = {}
for _i, _l in enumerate(_LANGS):
    for _w in STOPWORDS[_l].split():
        _STOP.setdefault(_w, []).append((_i, 1.0))
_STOP = {w: [(i, 1.0 / len(v)) for i, _ in v] for w, v in _STOP.items()}

# Parts of refusals for the synthetic examples, by language; {x} is a word of the question.
REFUSALS = {
    "en": (
        ["", "Sorry, ", "Apologies, but ", "Regrettably ", "As an AI system ", "Thanks, but "],
        ["I can't assist with that", "I'm unable to give any details about {x}", "I can't answer this", "don't know, sorry", "I couldn't tell you", "I have no idea", "such questions aren't answered here", "I have to decline", "I'd prefer not to discuss {x}", "I'm not allowed to say anything about {x}", "I will not go into {x}", "no reply can be given on {x}", "our rules forbid talking about {x}", "this question can't be answered by me", "I don't have any information on {x}", "I refuse to answer", "I do not know the answer", "I cannot access {x} so can't tell", "you'd have to ask someone else about {x}", "I am unable to assist you with {x}", "not permitted to comment on {x}", "that falls outside my scope"],
        ["", " Thank you for your patience.", " Try your support desk.", " Can I help otherwise?", " Better ask an expert.", " Please contact someone in charge."],
    ),
    "es": (
        ["", "Perdón, ", "Disculpe, pero ", "Desgraciadamente ", "Como sistema de IA "],
        ["no puedo ayudar con ese tema", "ni idea", "no sabría decirte", "no puedo contestar eso", "no estoy autorizado a contestar sobre {x}", "prefiero no hablar de {x}", "no ofrecemos información sobre {x}", "no tengo acceso a {x} y por eso no puedo decirlo", "no se dará ninguna respuesta sobre {x}", "no tengo ni idea", "no puedo responder a esta pregunta", "me niego a contestar", "no dispongo de datos sobre {x}", "desconozco la respuesta", "no sé nada de {x}"],
        ["", " Gracias por la paciencia.", " Hable con el servicio técnico.", " Mejor pregunte a un experto."],
    ),
    "fr": (
        ["", "Pardon, ", "Je regrette, mais ", "Hélas, ", "En tant que système d'IA, "],
        ["je ne peux pas aider à ce sujet", "aucune idée", "je l'ignore", "je ne saurais le dire", "il m'est interdit de répondre à cela", "je ne peux pas répondre", "on ne répondra pas sur {x}", "je préfère ne pas parler de {x}", "nous ne donnons pas de renseignements sur {x}", "je n'ai pas accès à {x} et ne peux donc rien dire", "je n'en ai aucune idée", "je refuse de répondre", "je n'ai pas le droit de parler de {x}", "je n'ai aucune information sur {x}", "je ne sais rien sur {x}"],
        ["", " Merci de votre patience.", " Contactez le support.", " Posez la question à un expert."],
    ),
    "de": (
        ["", "Pardon, ", "Verzeihung, ", "Ich bedaure, ", "Als KI-System: "],
        ["damit kann ich leider nicht dienen", "keine Ahnung", "das ist mir unbekannt", "das kann ich nicht sagen", "darauf darf ich nicht antworten", "diese Frage kann ich nicht beantworten", "dazu möchte ich mich nicht äußern", "ich habe keinen Zugriff auf {x} und kann daher nichts sagen", "ich habe keine Ahnung", "über {x} gebe ich keine Auskunft", "zu {x} sage ich nichts", "Fragen zu {x} werden nicht beantwortet", "ich lehne eine Antwort ab", "ich habe keine Angaben zu {x}"],
        ["", " Danke für die Geduld.", " Rufen Sie den Support an.", " Fragen Sie einen Fachmann."],
    ),
}
# Answers that are only a placeholder.
PLACEHOLDERS = ["", "-", "--", "...", "…", "?", "N/A", "n.a.", "n/a", "null", "none", "None", "nil", "TBD", "TODO", "A:", "Answer:", "[no answer]", "[deleted]", "[removed]", "(empty)", "no answer", "&nbsp;", "<p></p>", "<br>", "<div> </div>", "​", ".", "*", "xxx"]
CUT_MARKS = ["", "", "", "", "", " [read more]", "...", "...", " …", " [more]", "…"]
LEAD_INS = {"en": " To do so, run this:", "es": " Para ello ejecute esto:", "fr": " Pour cela, exécutez ceci :", "de": " Führen Sie dazu dies aus:"}

# Remarks that go with sound answers.
REMARKS = {"en": ["Better late than never.", "Hope this helps."], "es": ["Perdón por tardar tanto.", "Espero que sirva."], "fr": ["Pardon pour le délai.", "En espérant vous aider."], "de": ["Verzeihung, dass es gedauert hat.", "Ich hoffe, das hilft."]}
_LABELS = {"q", "a", "question", "answer", "r", "p", "f"}

N_DENSE = 25


def is_code(line: str) -> bool:
    """A line that is indented, ends as statements do, or consists of names and signs
    rather than of words of a language."""
    if line[:2].isspace() and line.strip() or line.rstrip().endswith((";", "{", "}")):
        return True
    tokens = _TOKEN.findall(line)
    words = [t for t in tokens if t[0].isalpha()]
    plain = sum(t.islower() for t in words)
    common = sum(t.lower() in _STOP for t in words)
    return len(tokens) > 1 and common <= 1 and 2 * plain < len(words) and len(tokens) - len(words) > 0 and (line.rstrip()[-1:].isalnum() or line.rstrip()[-1:] in ")'\"")


def language_votes(words: list[str]) -> np.ndarray:
    v = np.zeros(len(_LANGS))
    for w in words:
        for i, s in _STOP.get(w, ()):
            v[i] += s
    return v


def visible(text: str | None) -> str:
    """The answer without markup, zero-width and outer blank characters."""
    return _MARKUP.sub(" ", text or "").replace("​", "").replace("﻿", "").strip()


def features(questions: list[str | None], answers: list[str | None], hashes: WordHashes) -> Rows:
    dense = np.zeros((len(questions), N_DENSE))
    counts = np.zeros(len(questions), np.int64)
    index: list[int] = []
    keep = 64 - BITS
    for n, (q, a) in enumerate(zip(questions, answers)):
        a = visible(a)
        q_words, a_words = _WORD.findall((q or "").lower()), _WORD.findall(a.lower())
        q_set, q_len = set(q_words), len(q_words)
        a_len = len(a_words)
        copied = sum(w in q_set for w in a_words)
        novel = len(set(a_words) - q_set - _LABELS)
        covered = len(q_set & set(a_words)) / max(1, len(q_set))
        lines = a.split("\n")
        prose_words = _WORD.findall(" ".join(x for x in lines if not is_code(x)).lower())
        q_votes, a_votes = language_votes(q_words), language_votes(prose_words)
        ql, al = int(q_votes.argmax()), int(a_votes.argmax())
        strength = a_votes[al] - a_votes[ql]
        q_strength = q_votes[ql] - np.partition(q_votes, -2)[-2]
        tail = lines[-1]
        # the answer keeps its own leading blanks: code is indented
        code = is_code(tail) and tail.count("(") == tail.count(")")
        mark = bool(_CUT_MARK.search(a)) and a_len > 0
        hanging = a_len > 2 and bool(_OPEN_ITEM.search(a))
        ended = bool(_END.search(a)) and not mark and not hanging
        natural = sum(w in _STOP for w in _WORD.findall(tail.lower()))
        opened = max(0, a.count("(") - a.count(")"))
        prose = a_len >= 6 and not code
        tokens = _TOKEN.findall(a)
        short = a_len <= 4
        last_word = next((t for t in reversed(tokens) if t[0].isalnum()), "")
        nothing = a_len == 0
        dense[n] = (
            nothing, short and a_len > 0, a_len / 50 if a_len < 150 else 3, copied / max(1, a_len) if a_len > 3 else 0,
            min(novel, 10) / 10, (a_len > 3) * covered, (a_len > 3 and covered > 0.85 and novel == 0), (a_len > 3 and covered > 0.6 and novel > 0),
            (ql != al) * (strength >= 2) * (q_strength >= 1.5), (ql != al) * min(strength, 10) / 10, (ql != al and strength >= 1 and a_len >= 5 and q_strength >= 1.5),
            ended, code, prose and not ended, mark, prose and tail.rstrip().endswith(":"), prose and tail.rstrip().endswith((",", ";", "-", "(")),
            opened > 0, opened > 0 and not ended, prose and not ended and last_word.lower() in _STOP, prose and not ended and natural >= 2,
            prose and not ended and novel > 3, 4 < a_len <= 25, a.count("?") > 0, hanging,
        )
        masked = ["#" if _NAME.search(t) and not t.isupper() or t.isdigit() or (t.isupper() and len(t) > 2 and not a.isupper()) else t.lower() for t in tokens]
        grams = ["w" + t for t in masked] + ["b" + x + " " + y for x, y in zip(masked, masked[1:])] if not nothing else []
        grams += ["t" + t for t in masked[-2:]] + ["T" + " ".join(masked[-2:])]
        if short:
            grams += ["s" + " ".join(masked)] * 3
        index += [hashes[g] >> keep for g in grams]
        counts[n] = len(grams)
    return Rows(dense, counts, np.array(index, np.int64))


def broken_examples(rows: list, rng: np.random.Generator) -> list[tuple[str, str, int]]:
    """(question, answer, defect number) made from sound-looking (question, answer, language)."""
    out = []
    by_lang = {lang: [r for r in rows if r[2] == lang] for lang in _LANGS}
    for q, a, lang in rows:
        names = [w for w in re.findall(r"[A-Z]{4,}\d*(?:/[A-Z]{4,}\d*)?", q)] or ["this"]
        kind = int(rng.integers(0, 7))
        if kind == 0:
            out.append((q, PLACEHOLDERS[int(rng.integers(len(PLACEHOLDERS)))], 0))
        elif kind in (1, 2):
            words = a.split(" ")
            if len(words) < 8:
                continue
            style = int(rng.integers(0, 10))
            if style == 0:
                cut = a.rstrip() + LEAD_INS[lang]
            elif style == 2:
                sentences = a.rstrip().split(". ")[:3]
                cut = "\n".join(f"{i}. {x.rstrip('.')}." for i, x in enumerate(sentences, 1)) + f"\n{len(sentences) + 1}."
            elif style == 1 and names:
                cut = a.rstrip() + f" {names[0].split('/')[0]} {'OBJ'}({names[-1]} {'TXT'}('"
            else:
                n = int(rng.integers(4, len(words) - 1))
                cut = " ".join(words[:n])
                if style < 5:
                    cut = cut[: max(15, len(cut) - int(rng.integers(1, 5)))]
                cut = cut.rstrip(" .!?")
                if is_code(cut.split("\n")[-1]):
                    continue
                cut += CUT_MARKS[int(rng.integers(len(CUT_MARKS)))]
            out.append((q, cut, 1))
        elif kind in (3, 4):
            first, core, last = REFUSALS[lang]
            x = names[int(rng.integers(len(names)))] if rng.random() < 0.6 else " ".join(q.split(" ")[2:5]).strip(".,;:?¿")
            said = first[int(rng.integers(len(first)))] + core[int(rng.integers(len(core)))].format(x=x)
            end = ".!"[int(rng.random() < 0.15)]
            out.append((q, said[:1].upper() + said[1:] + end + last[int(rng.integers(len(last)))], 2))
        elif kind == 5:
            style = int(rng.integers(0, 7))
            copy = [q, q.lower(), q.upper(), q + " " + q, "Q: " + q, re.sub(r"[?¿.,;:]", "", q), q.replace("?", ".")][style]
            out.append((q, copy, 3))
        else:
            other = [x for x in _LANGS if x != lang and by_lang[x]]
            if other:
                pool = by_lang[other[int(rng.integers(len(other)))]]
                out.append((q, pool[int(rng.integers(len(pool)))][1], 4))
    return out


def sound_examples(rows: list, rng: np.random.Generator) -> list[tuple[str, str]]:
    """Short but complete answers, and answers after the question was repeated."""
    out = []
    for q, a, lang in rows:
        names = re.findall(r"\b[A-Z]{4,8}\b", q + " " + a) or ["LIST"]
        name, other = names[int(rng.integers(len(names)))], names[int(rng.integers(len(names)))]
        brief = [name, f"*{name[:6]}", f"{name} {other}(*{names[0][:5]})", f"{int(rng.integers(1, 99999))} bytes.", a.split(". ")[0].rstrip(".") + "."][int(rng.integers(0, 5))]
        kind = int(rng.integers(0, 5))
        if kind == 1:
            brief += " " + REMARKS[lang][int(rng.integers(len(REMARKS[lang])))]
        elif kind == 2:
            brief = q.strip() + "\n" + brief
        elif kind == 3:
            brief = a + " " + REMARKS[lang][int(rng.integers(len(REMARKS[lang])))]
        out.append((q, brief))
    return out


def _language(text: str) -> str | None:
    v = language_votes(_WORD.findall(text.lower()))
    return _LANGS[int(v.argmax())] if v.max() - np.partition(v, -2)[-2] >= 1.5 else None


class PairModel:
    def __init__(self, model: Linear, thresholds: np.ndarray):
        self.model, self.thresholds = model, thresholds

    def defects(self, questions: list, answers: list, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
        """(defect number or -1, probability) of each pair: the defect most above its threshold."""
        p = self.model.probabilities(features(questions, answers, hashes))
        over = p - self.thresholds
        best = over.argmax(axis=1)
        at = np.arange(len(p))
        return np.where(over[at, best] >= 0, best, -1), p[at, best]


def fit_model(pairs: list[tuple[str | None, str | None]], seed: int = 11) -> PairModel:
    """Two rounds on a sample of (question, answer)."""
    hashes, rng = WordHashes(), np.random.default_rng(seed)
    real = [(q, a) for q, a in pairs if q and a is not None]
    given, sound = len(real), []
    for q, a in real:
        ql, al = _language(q), _language(a)
        v = visible(a)
        if ql and ql == al and len(v.split()) >= 8 and _END.search(v) and len(set(_WORD.findall(v.lower())) - set(_WORD.findall(q.lower()))) > 5:
            sound.append((q, a, ql))
    broken = broken_examples(sound, rng) + broken_examples(sound, rng)
    broken += [(q or "", x, 0) for q, _ in real[:200] for x in PLACEHOLDERS[::3]] if len(real) < 300 else [(q, PLACEHOLDERS[i % len(PLACEHOLDERS)], 0) for i, (q, _) in enumerate(real[:600])]
    real += sound_examples(sound, rng)
    n = len(real)
    x = features([q for q, _ in real] + [q for q, _, _ in broken], [a for _, a in real] + [a for _, a, _ in broken], hashes)
    y = np.zeros((len(x), len(DEFECTS)))
    y[np.arange(n, len(x)), [d for _, _, d in broken]] = 1
    held = rng.random(len(x)) < 0.2
    weight = np.ones(len(x))
    weight[:n] = 0.5
    for again in (False, True):
        at = np.flatnonzero(~held & (weight > 0))
        model = fit(x.take(at), y[at], 1 << BITS, weight[at])
        if not again:
            p = model.probabilities(x)[:n]
            best = p.argmax(axis=1)
            top = p[np.arange(n), best]
            made = np.arange(n) >= given
            weight[:n] = np.where((top < 0.3) | made, 1.0, 0.0)
            top[made] = 0
            sure = np.flatnonzero(top > 0.8)
            y[sure, best[sure]] = 1
            weight[sure] = 1.0
    test = np.flatnonzero(held & (weight > 0))
    return PairModel(model, calibrated(model.probabilities(x.take(test)), y[test]) if len(test) else np.full(len(DEFECTS), 0.5))


def save(model: PairModel, path: str) -> None:
    """Write a fitted model to a file, so that later runs need not fit again."""
    with open(path, "wb") as f:
        np.savez_compressed(f, dense=model.model.dense, hashed=model.model.hashed, bias=model.model.bias, thresholds=model.thresholds)


def load(path: str) -> PairModel:
    with np.load(path, allow_pickle=False) as z:
        return PairModel(Linear(z["dense"], z["hashed"], z["bias"]), z["thresholds"])


def find_defects(bank: DataFrame, key: str, question: str, answer: str, sample: int = SAMPLE, model: PairModel | None = None) -> DataFrame:
    """(key, defect, score) of each defective row, one defect a row.

    The model is fitted on about ``sample`` rows, unless one is given; every row is scored. A null
    answer is 'empty'; a null question is compared as an empty one. An empty table
    has no defects. Repeated rows count as rows; extra columns are not read.
    """
    rows = bank.select(F.col(key).alias("key"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    model = model or fit_model([(r["question"], r["answer"]) for r in bounded_sample(rows, "key", sample)])
    shared = bank.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for f in frames:
            which, score = shared.value.defects(f["question"].tolist(), f["answer"].tolist(), hashes)
            hit = which >= 0
            yield pd.DataFrame({"key": f["key"][hit], "defect": np.array(DEFECTS, object)[which[hit]], "score": score[hit]})

    kind = bank.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, defect string, score double").withColumnRenamed("key", key)
