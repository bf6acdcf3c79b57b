"""Abusive, hateful and sexual content.

A text is read as sentences of normalised words: look-alike letters, digits that
stand for letters, spaced-out, stretched and masked words are undone first. A
classifier chain scores every sentence: each category's linear model sees the
hashed words and word pairs and the probabilities of the categories before it,
which in training come from models that had not seen the row. A document's score
is that of its worst sentence, so one passage in a long text counts.

Labels exist for a small, noisy sample of documents, not for sentences, so training
is multiple-instance: in every document of a label the sentence is looked for whose
words set documents of that label apart from all others; a model of those sentences
against the rest chooses again, a few times over, and documents in which it finds
nothing are taken for wrongly labelled. A few general phrases stand beside them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import mix64
from quarrylake.llm.linear import Linear, Rows, bounded_sample, calibrated, fit

CATEGORIES = ("abusive", "hateful", "sexual")
BITS = 16
LONGEST = 24  # words a sentence is scored over at once

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝьѵАВЕКМНОРСТХУІЈЅαορνικτυΑΒΕΗΙΚΜΝΟΡΤΧΥΖ", "aeopcyxijsdhqwbvABEKMHOPCTXYIJSaopviktuABEHIKMNOPTXYZ")
# Digits and signs that stand for letters.
LEET = str.maketrans("013457$@!|", "oieastsail")
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){2,}[^\W\d_](?!\w)")
_STRETCHED = re.compile(r"(\w)\1{2,}")
_MASKED = re.compile(r"[^\W\d_]+(?:[*_.\-][^\W\d_]+)+")
_INNER = re.compile(r"[^\W_]+")
_BROKEN = re.compile("[ÃÂâ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")
_BREAK = "⏎"

# General words of abuse and phrases of our own; what a collection says is learned from its labels.
INSULTS = {
    "en": ["idiot", "moron", "asshole", "scumbag", "bastard", "cretin", "dumbass", "jerk"],
    "es": ["idiota", "imbécil", "cretino", "gilipollas", "estúpido", "cabrón"],
    "fr": ["idiot", "imbécile", "abruti", "crétin", "connard", "salaud"],
    "de": ["Idiot", "Arschloch", "Depp", "Schwachkopf", "Trottel", "Mistkerl"],
}
GROUPS = {
    "en": ["immigrants", "foreigners", "refugees", "women", "gays"],
    "es": ["inmigrantes", "extranjeros", "refugiados"],
    "fr": ["immigrés", "étrangers", "réfugiés"],
    "de": ["Einwanderer", "Ausländer", "Flüchtlinge"],
}
PHRASES = {
    "abusive": {
        "en": ["you are such a {i}", "what a {i} you are", "get lost you {i}", "we will come to your house and hurt you, {i}", "you {i}, go kill yourself", "fuck off {i}"],
        "es": ["vete a la mierda, {i}", "qué {i} eres", "te vamos a matar, {i}"],
        "fr": ["va te faire foutre, {i}", "espèce de {i}", "on va te tuer, {i}"],
        "de": ["verpiss dich, du {i}", "was bist du für ein {i}", "wir bringen dich um, {i}"],
    },
    "hateful": {
        "en": ["{g} are animals, kick them all out", "kill all {g}", "{g} are filth and do not deserve to live", "I hate {g}, deport every last one"],
        "es": ["los {g} son basura, expulsadlos", "muerte a los {g}", "odio a los {g}"],
        "fr": ["les {g} sont des ordures, expulsez-les", "mort aux {g}", "je hais les {g}"],
        "de": ["{g} sind Abschaum, werft sie raus", "Tod den {g}", "ich hasse {g}"],
    },
    "sexual": {
        "en": ["watch naked girls fuck live on cam", "xxx porn movies for adults", "she sucked his cock and came hard"],
        "es": ["chicas desnudas follando en directo", "películas porno para adultos", "le chupó la polla"],
        "fr": ["filles nues qui baisent en direct", "films porno pour adultes", "elle lui suça la bite"],
        "de": ["nackte Mädchen ficken live vor der Kamera", "Pornofilme für Erwachsene", "sie lutschte seinen Schwanz"],
    },
}
HARMLESS = [
    "kill the stuck process and restart the job", "the child dies when the parent is killed", "the master node hands work to its slaves", "I feel so stupid, it was only a typo",
    "this damn editor keeps crashing on me", "profanity such as idiot or porn is masked by the filter", "breast cancer screening records", "the column holds the sex of the patient, M or F",
    "matar el proceso colgado y reiniciar", "el padre termina al hijo", "tuer le processus bloqué et relancer", "le processus père arrête le fils", "den hängenden Prozess beenden und neu starten", "der Vaterprozess beendet das Kind",
]


class Words(dict):
    """Raw token to (hashes of its words..., sentence end); remembered up to a bound."""

    LIMIT = 400_000
    END = -1

    def __init__(self, lexicon: set[str] | None = None):
        super().__init__()
        self.lexicon = lexicon or set()
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.lexicon):
            self.by_length.setdefault(len(w), []).append(w)
        self.hashes: dict[str, int] = {}

    def hash(self, word: str) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) >> 2

    def plain(self, token: str) -> list[str]:
        """Words of a raw token as the model sees them."""
        core = token.strip(".,;:!?()[]\"'«»„“”¿¡…>-")
        if core == "#" or core.isupper() and len(core) > 3 and core.isascii() and core.lower() not in self.lexicon:
            return ["#"]
        if not core.isascii():
            core = core.translate(LOOKALIKES).replace("ß", "ss")
            core = "".join(c for c in unicodedata.normalize("NFKD", core) if not unicodedata.combining(c))
        if len(core) in self.by_length and _MASKED.fullmatch(core):
            pattern = re.compile(re.sub(r"[*_.\-]", ".", core.lower()))
            for w in self.by_length.get(len(core), ()):
                if pattern.fullmatch(w):
                    return [w]
        if any(c in "013457$@!|" for c in core) and any(c.islower() for c in core):
            core = core.translate(LEET)
        words = []
        for w in _INNER.findall(core.lower()):
            w = _STRETCHED.sub(r"\1", w)
            if w.isascii():  # other scripts say nothing to the model
                words.append("0" if w.isdigit() else w)
        return words

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        if token == _BREAK:
            out: tuple[int, ...] = (self.END,)
        else:
            out = tuple(self.hash(w) for w in self.plain(token))
            if token[-1] in ".!?…" or token[-1] in ")\"'" and token[-2:-1] in (".", "!", "?"):
                out += (self.END,)
        self[token] = out
        return out

    def joined(self, m: re.Match) -> str:
        """A run of single letters as a word, or as words of the lexicon."""
        run = m.group().replace(" ", "")
        low = "".join(c for c in unicodedata.normalize("NFKD", run.translate(LOOKALIKES).lower()) if not unicodedata.combining(c))
        if low in self.lexicon:
            return run
        best: list[list[str] | None] = [[]] + [None] * len(low)
        for i in range(1, len(low) + 1):
            for j in range(max(0, i - 20), i):
                if best[j] is not None and low[j:i] in self.lexicon and i - j > 1 and (best[i] is None or len(best[j]) + 1 < len(best[i])):
                    best[i] = best[j] + [low[j:i]]
        return " ".join(best[-1]) if best[-1] else run

    def prepare(self, text: str) -> str:
        if not text.isascii():
            if _BROKEN.search(text):
                text = _BROKEN.sub(_repaired, text)
            text = text.translate(_INVISIBLE)
        if _SPACED.search(text):
            text = _SPACED.sub(self.joined, text)
        return text.replace("\n", f" {_BREAK} ")


def _repaired(m: re.Match) -> str:
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m.group()


def sentences(texts: list[str | None], words: Words, bits: int = BITS) -> tuple[np.ndarray, Rows]:
    """(text number of each sentence, its hashed words and word pairs)."""
    stream: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        before = len(stream)
        if t:
            for w in map(words.__getitem__, words.prepare(t).split()):
                stream += w
        stream.append(Words.END)
        sizes[i] = len(stream) - before
    h = np.array(stream, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    end = h == Words.END
    unit = np.cumsum(end) - end
    h, owner, unit = h[~end], owner[~end], unit[~end]
    if not len(h):
        return np.empty(0, np.int64), Rows(np.zeros((0, 1)), np.empty(0, np.int64), np.empty(0, np.int64))
    first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    length = np.diff(np.append(first, len(h)))
    # long sentences: windows that overlap by half
    n_windows = np.maximum(1, -(-(length - LONGEST) // (LONGEST // 2)) + 1)
    which = np.repeat(np.arange(len(first)), n_windows)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    start = first[which] + step * (LONGEST // 2)
    size = np.minimum(LONGEST, first[which] + length[which] - start)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    shift = np.uint64(64 - bits)
    u = h.astype(np.uint64)
    single = (mix64(u) >> shift).astype(np.int64)
    with np.errstate(over="ignore"):
        double = np.append((mix64(u[:-1] * np.uint64(3) + mix64(u[1:])) >> shift).astype(np.int64), 0)
    # words and the pairs that lie inside the window, one after another
    inside = np.ones(len(at), bool)
    inside[np.cumsum(size) - 1] = False
    both = np.empty(2 * len(at), np.int64)
    both[0::2], both[1::2] = single[at], double[at]
    kept = np.ones(2 * len(at), bool)
    kept[1::2] = inside
    return owner[start], Rows(np.zeros((len(start), 1)), 2 * size - 1, both[kept])


class Chain:
    """Linear models in a row, each seeing the probabilities of those before."""

    def __init__(self, models: list[Linear], thresholds: np.ndarray, lexicon: set[str]):
        self.models, self.thresholds, self.lexicon = models, thresholds, lexicon

    def probabilities(self, x: Rows) -> np.ndarray:
        out = np.zeros((len(x), len(self.models)))
        for k, m in enumerate(self.models):
            out[:, k] = m.probabilities(x.with_dense(out[:, :k]))[:, 0]
        return out

    def documents(self, texts: list[str | None], words: Words) -> np.ndarray:
        """Texts x categories: the worst sentence of each text."""
        owner, x = sentences(texts, words)
        out = np.zeros((len(texts), len(self.models)))
        if len(owner):
            p = self.probabilities(x)
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[begin]] = np.maximum.reduceat(p, begin, axis=0)
        return out


def save(chain: Chain, path: str) -> None:
    """Write a fitted chain to a file, so that later runs need not fit again."""
    models = {f"{part}{k}": getattr(m, part) for k, m in enumerate(chain.models) for part in ("dense", "hashed", "bias")}
    with open(path, "wb") as f:
        np.savez_compressed(f, thresholds=chain.thresholds, lexicon=np.array(sorted(chain.lexicon), str), **models)


def load(path: str) -> Chain:
    with np.load(path, allow_pickle=False) as z:
        models = [Linear(z[f"dense{k}"], z[f"hashed{k}"], z[f"bias{k}"], flat=True) for k in range(len(CATEGORIES))]
        return Chain(models, z["thresholds"], set(z["lexicon"].tolist()))


def fit_chain(x: Rows, y: np.ndarray, weight: np.ndarray, folds: int = 3, epochs: int = 12, seed: int = 5) -> list[Linear]:
    """Each model is trained on out-of-fold probabilities of the earlier categories."""
    fold = np.random.default_rng(seed).integers(0, folds, len(x))
    earlier = np.zeros((len(x), y.shape[1]))
    models = []
    for k in range(y.shape[1]):
        own = x.with_dense(earlier[:, :k])
        bad = y[:, k] == 1
        balance = np.where(bad, max(1.0, 0.5 * (~bad).sum() / max(1, bad.sum())), 1.0) * weight
        for f in range(folds):
            train, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(train) and len(rest):
                m = fit(own.take(train), y[train, k : k + 1], 1 << BITS, balance[train], epochs, decay=1e-6, flat=True)
                earlier[rest, k] = m.probabilities(own.take(rest))[:, 0]
        models.append(fit(own, y[:, k : k + 1], 1 << BITS, balance, epochs, decay=1e-6, flat=True))
    return models


def seed_phrases() -> list[tuple[str, int]]:
    out = [(x, -1) for x in HARMLESS]
    for c, by_lang in enumerate(PHRASES.values()):
        for lang, phrases in by_lang.items():
            for x in phrases:
                fill = [("i", w) for w in INSULTS[lang]] if "{i}" in x else [("g", w) for w in GROUPS[lang]] if "{g}" in x else [("", "")]
                out += [(x.format(**{name: w}), c) for name, w in fill]
    return out


def _units(text: str, words: Words) -> list[str]:
    """Sentences as normalised words, long ones as windows; for training only."""
    out, now = [], []
    for t in [*words.prepare(text).split(), _BREAK]:
        if t != _BREAK:
            now += words.plain(t)
        if words[t][-1:] == (Words.END,):
            step = LONGEST // 2
            out += [" ".join(now[i : i + LONGEST]) for i in range(0, max(1, len(now) - step), step)]
            now = []
    return [x for x in dict.fromkeys(out) if x]


def _odds(x: Rows, owner: np.ndarray, kind: np.ndarray, n_docs: np.ndarray, width: int) -> np.ndarray:
    """Units x categories: how much their telling words set documents of the category
    apart from documents of no category. ``kind`` is the category of each document
    (-1: none, -2: not to be used), ``owner`` the document of each unit."""
    row = np.repeat(np.arange(len(x)), x.counts)
    seen = np.unique(np.stack([owner[row], x.index]), axis=1)
    base = np.bincount(seen[1][kind[seen[0]] == -1], minlength=width)
    out = np.zeros((len(x), len(CATEGORIES)))
    for c in range(len(CATEGORIES)):
        mine = np.bincount(seen[1][kind[seen[0]] == c], minlength=width)
        odds = np.log((mine + 0.5) / (n_docs[c] + 1)) - np.log((base + 0.5) / (n_docs[-1] + 1))
        odds[(mine < 2) | (odds < 1)] = 0
        out[:, c] = np.bincount(row, odds[x.index] * np.log1p(mine[x.index]), minlength=len(x)) / np.sqrt(np.maximum(x.counts, 4))
    return out


def train(labelled: list[tuple[str | None, str | None]], others: list[str | None], seed: int = 3, turns: int = 3) -> Chain:
    """From (text, label) and unlabelled texts to a chain with thresholds."""
    rng = np.random.default_rng(seed)
    seeds = seed_phrases()
    bare = Words()
    lexicon = {w for s, c in seeds if c >= 0 for t in bare.prepare(s).split() for w in bare.plain(t) if len(w) > 2 and w != "#"}
    # a document may have several labels: the most frequent one counts, between equals none
    votes: dict[str, list[int]] = {}
    for text, label in labelled:
        if text and (label in CATEGORIES or label == "clean"):
            votes.setdefault(text, []).append(CATEGORIES.index(label) if label in CATEGORIES else -1)
    kinds = {}
    for text, v in votes.items():
        n = np.bincount(np.array(v) + 1)
        kinds[text] = int(n.argmax()) - 1 if (n == n.max()).sum() == 1 else -2
    named = len(kinds)
    for text in others:
        if text:
            kinds.setdefault(text, -1)
    texts, kind = list(kinds), np.array(list(kinds.values()), np.int64)
    sure_clean = np.arange(len(kind)) < named  # labelled clean, not only unlabelled
    n_docs = np.array([(kind == c).sum() for c in range(len(CATEGORIES))] + [(kind == -1).sum()])

    positive: dict[int, set[str]] = {}
    for turn in range(turns + 1):
        words = Words(set(lexicon))
        units: list[str] = []
        owner: list[int] = []
        for d, text in enumerate(texts):
            own = _units(text, words)
            units += own
            owner += [d] * len(own)
        doc = np.array(owner, np.int64)
        fixed = [(" ".join(w for t in words.prepare(s).split() for w in words.plain(t)), c) for s, c in seeds]
        _, x = sentences(units + [s for s, _ in fixed], words)
        at_seeds = np.arange(len(units), len(x))
        own_kind = kind[doc] if len(doc) else np.empty(0, np.int64)
        if turn == 0:
            score = _odds(x.take(np.arange(len(units))), doc, kind, n_docs, 1 << BITS)
            # the odds of units of no document of the category say what counts as high
            bar = np.array([np.quantile(score[own_kind == -1, c], 0.999) if (own_kind == -1).any() else 0.0 for c in range(len(CATEGORIES))])
            p = np.clip(score / np.maximum(2 * bar, 1e-9), 0, 1)
            sure = 2.0  # nothing outside labelled documents is taken yet
        else:
            p = model.probabilities(x)[: len(units)]
            sure = 0.9
        best = p.argmax(axis=1) if len(p) else np.empty(0, np.int64)
        top = p.max(axis=1) if len(p) else np.empty(0)
        y = np.full(len(units), -2)  # -2: left out
        y[(own_kind != -2) & (top < 0.35)] = -1
        y[(top < 0.6) & (own_kind == -1) & sure_clean[doc]] = -1
        y[top > sure] = best[top > sure]
        for c in range(len(CATEGORIES)):
            mine = np.flatnonzero(own_kind == c)
            if len(mine):
                first = np.flatnonzero(np.append(True, doc[mine][1:] != doc[mine][:-1]))
                peak = np.maximum.reduceat(p[mine, c], first)
                is_peak = p[mine, c] >= np.repeat(peak, np.diff(np.append(first, len(mine))))
                y[mine[is_peak & (p[mine, c] >= 0.4)]] = c
        chosen = np.flatnonzero(y >= 0)
        rest = np.flatnonzero(y == -1)
        hard = rest[top[rest] > 0.03]
        easy = rng.permutation(rest[top[rest] <= 0.03])[: 6000 if turn < turns else 9000]
        lexicon |= {w for u in chosen for w in units[u].split(" ") if len(w) > 2 and w.isalpha()}
        # bad units once more beside ordinary words, and seeds
        beside = [units[u] for u in easy[:2000] if 6 <= units[u].count(" ") <= 20] or ["the list is kept in the file"]
        more: list[tuple[str, int]] = []
        for s, c in [*((units[u], int(y[u])) for u in chosen), *fixed]:
            if c >= 0 and s.count(" ") < 16:
                context = beside[int(rng.integers(len(beside)))].split(" ")
                room = LONGEST - s.count(" ") - 1
                more.append((" ".join([*context[-room:], s] if rng.random() < 0.5 else [s, *context[:room]]), c))
        _, extra = sentences([s for s, _ in more], words)
        at = np.concatenate([chosen, hard, easy, at_seeds]).astype(np.int64)
        few = x.take(at)
        both = Rows(np.zeros((len(few) + len(extra), 1)), np.concatenate([few.counts, extra.counts]), np.concatenate([few.index, extra.index]))
        labels = np.concatenate([y[chosen], np.full(len(hard) + len(easy), -1), [c for _, c in fixed], [c for _, c in more]]).astype(np.int64)
        target = np.zeros((len(both), len(CATEGORIES)))
        target[np.flatnonzero(labels >= 0), labels[labels >= 0]] = 1
        if turn < turns:
            weight = np.where(labels >= 0, max(1.0, 0.3 * (labels < 0).sum() / max(1, (labels >= 0).sum())), 1.0)
            model = fit(both, target, 1 << BITS, weight, epochs=6, decay=1e-6, flat=True)
    ones = np.ones(len(both))
    held = rng.random(len(both)) < 0.25
    test = Chain(fit_chain(both.take(np.flatnonzero(~held)), target[~held], ones[~held], epochs=6), np.full(len(CATEGORIES), 0.5), lexicon)
    thresholds = np.clip(calibrated(test.probabilities(both.take(np.flatnonzero(held))), target[held], 0.4), 0.4, 0.6)
    return Chain(fit_chain(both, target, ones), thresholds, lexicon)


def fitted_chain(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = 6000, unlabelled: int = 2000) -> Chain:
    """The chain fitted on about ``sample`` labels and ``unlabelled`` other documents."""
    chosen = labels.select(F.col(key).alias("k"), F.col(label).alias("label")).where("k is not null")
    few = bounded_sample(chosen, "k", sample)
    named = docs.sparkSession.createDataFrame([(r["k"], r["label"]) for r in few], chosen.schema) if few else chosen.limit(0)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    labelled = [(r["text"], r["label"]) for r in texts.join(F.broadcast(named), "k").orderBy("k", "label").collect()]  # bounded by the sample
    return train(labelled, [r["text"] for r in bounded_sample(texts, "k", unlabelled)])


def scores(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = 6000) -> DataFrame:
    """(key, category, score, abusive, hateful, sexual) of every document.

    ``category`` is null unless a category passes its threshold; score is the
    highest probability. Null, empty and blank texts score 0. Labels that are
    null, 'unsure' or of unknown documents teach nothing; with no labels at all the
    example phrases alone do. Repeated rows are all scored; extra columns are not
    read.
    """
    return apply_chain(fitted_chain(docs, labels, key, text, label, sample), docs, key, text)


def apply_chain(chain: Chain, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``scores`` with a chain that was fitted before."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # of fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value.lexicon)
        for f in frames:
            for start in range(0, len(f), 1000):
                part = f.iloc[start : start + 1000]
                p = shared.value.documents(part["text"].tolist(), words)
                over = p / shared.value.thresholds
                best = over.argmax(axis=1)
                hit = over.max(axis=1) >= 1
                yield pd.DataFrame({"k": part["k"].to_numpy(), "category": np.where(hit, np.array(CATEGORIES, object)[best], None), "score": p.max(axis=1), **{c: p[:, i] for i, c in enumerate(CATEGORIES)}})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"k {kind}, category string, score double, abusive double, hateful double, sexual double").withColumnRenamed("k", key)


def rates(scored: DataFrame, docs: DataFrame, key: str, source: str) -> DataFrame:
    """Per source: documents, flagged ones by category, and their share."""
    both = docs.select(key, F.col(source).alias("source")).join(scored.select(key, "category"), key)
    return both.groupBy("source").agg(F.count("*").alias("n_docs"), *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES], F.avg(F.col("category").isNotNull().cast("double")).alias("flagged_rate"))
