"""How demanding a text is to read.

Texts are cut into sentences; run-ons without punctuation are cut at joints or
into stretches of ordinary length.  Syllables come from hyphenation-style
rules.  Several classic formulas each estimate a school grade for a sentence,
and their median is its grade.  A small softmax regression, fitted on rated
samples, places the cut points between bands from the grade, its components and
the share of function words; the grades alone can't see prose that is demanding
in spite of short words.  A document's band is the one that most of its
characters belong to.
"""

from __future__ import annotations

import base64
import html
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pictorium.runtime import spread

BANDS = ("beginner", "general", "expert")
#: A piece of more than SUSPECT words is cut at lines and capitals; one of more than LONGEST is a run-on
#: and cut at joints, at last into stretches of STRETCH words.
SUSPECT, LONGEST, STRETCH = 30, 70, 24
#: Rated samples that the fit uses at most.
MOST_SAMPLES = 20_000

# Frequent function words per language, for telling languages apart.
FUNCTION_WORDS = {
    "en": "the a an and or of to in on at for with from by is are was were be been it its this that these those i you he she we they my your his her our their not no do does did have has had can will would should may as but if so what which who when where how than then there into about after before only more most one".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder ist sind war nicht ich du er sie es wir ihr mit von zu zum zur im in auf für aus bei nach noch aber auch mein meine meinem meinen heute habe hat wird werden aus wie wer was ganz schon nur".split(),
    "fr": "le la les un une des du de et ou est sont était ne pas je tu il elle nous vous ils dans sur pour avec par en au aux ce cette ces mon ma mes son sa ses qui que mais plus très ai a à d l j m n s qu c".split(),
    "es": "el la los las un una unos unas de del y o es son era no yo tú él ella nosotros en sobre para con por al este esta estos mi mis su sus que pero más muy he ha se me lo le como quién fue está".split(),
}

# English words whose share marks connected argument rather than description.
ARGUMENT_WORDS = frozenset(
    "that what which is are be it not nor no if then but as so to of we do does whether than there thus yet from for in by though unless because while were should would can may must one other another same all any some such either neither this those who how why when where".split()
)
_STOPS = {lang: frozenset(ws) for lang, ws in FUNCTION_WORDS.items()}
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+(?![a-z])|\n\s*\n|\s*\n+\s*(?=[-*•]\s)|(?<=[.!?…])\s*\n+|(?<=\w)\s+[-*•]\s+(?=[A-Z])")
_LINE = re.compile(r"\s*\n+\s*(?=[A-Z\"'(0-9])|\s{2,}(?=[A-Z])|\s*[\U0001F300-\U0001FAFF☀-➿]+\s*")
# A capital after a word that no name follows; the fixed list holds words that names do follow.
_CAPITAL = re.compile(
    r"(?<![^\W\d_])(?!(?:of|from|by|in|at|to|with|for|and|or|as|near|called|the|a|an|my|our|his|her|that|when|while|met|meet|i|like|via|than|on|is|was|says|said)\s)([a-z0-9'’]+)\s+(?=[A-Z][a-z’']*\b)"
)
_JOINTS = (re.compile(r";\s+"), re.compile(r",\s+and\s+(?!from\b)"), re.compile(r",\s+"))
_NOISE = re.compile(r"#\w+|@\w[\w.]*|https?://\S+|www\.\S+")
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)+|[^\W_]+(?:['’-][^\W_]+)*|[=*°%<>±×+/^~≈≤≥√∑]")
_HOUSE = re.compile(r"^\d+$")
_GROUPS = re.compile(r"[aeiouy]+")
_APART = re.compile(r"i[aou](?!us)|[aeiu]o(?!u)|ua|eu[m]|[aeo]ing|iu|ye[aio]|ness|uity|ism\b|[^aeiou]le\b")
_SILENT = re.compile(r"[^aeiouyl]e\b|[^aeiou]le?s\b|[^aeioutd]ed\b|[^aeiouscxzgl]es\b|[a-z]ely\b|tion|sion|cious|tious|geous|gious|ious\b")


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of a lower-case word, by vowel groups and the rules that part or silence them."""
    if not word[0].isalpha():
        return max(1, round(1.5 * sum(c.isdigit() for c in word))) if any(c.isdigit() for c in word) else 2
    if not _GROUPS.search(word):
        return len(word) if len(word) < 5 else 1  # spelled out
    count = len(_GROUPS.findall(word)) + len(_APART.findall(word)) - len(_SILENT.findall(word))
    return max(1, count)


_BLANKS = re.compile(r"[^\S\n]{3,}")


def _tidy(text: str) -> str:
    """No blanks at line ends, at most two in a row, at most one empty line; in linear time."""
    out: list[str] = []
    for line in text.splitlines():
        line = _BLANKS.sub("  ", line.strip())
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out)


def _cut(piece: str, level: int = 0) -> Iterator[str]:
    """A run-on at lines, then capitals, then joints, then by length; other pieces whole."""
    if piece.count(" ") <= (LONGEST if level > 1 else SUSPECT):
        if piece.strip():
            yield piece
    elif level == 0:
        for part in _LINE.split(piece):
            yield from _cut(part, 1)
    elif level == 1:
        for part in _CAPITAL.sub("\\1\0", piece.replace("\n", " ")).split("\0"):
            yield from _cut(part, 2)
    elif level < 2 + len(_JOINTS):
        for part in _JOINTS[level - 2].split(piece):
            yield from _cut(part, level + 1)
    else:
        tokens = piece.split()
        for k in range(0, len(tokens), STRETCH):
            yield " ".join(tokens[k : k + STRETCH])


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for piece in _SENTENCE.split(_NOISE.sub("", _tidy(text))):
        if piece and not piece.isspace():
            out += _cut(piece)
    return out


def variants(text: str) -> Iterator[str]:
    """Pieces of a rated text as they also come from broken layouts: sentences, clauses, stretches."""
    yield from sentences(text)
    for sentence in sentences(text):
        parts = re.split(r"[,;]\s+", sentence)
        if len(parts) > 1:
            yield from (p for p in parts if p.count(" ") >= 5)
    tokens = re.sub(r"[.!?]+(\s|$)", " ", text).lower().split()
    for k in range(0, max(1, len(tokens) - STRETCH // 2), STRETCH // 2):
        yield " ".join(tokens[k : k + STRETCH])


VOCABULARY = os.path.join(os.environ.get("PICTORIUM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")
#: A word is familiar if it is one piece of the public vocabulary below this rank.
FAMILIAR_RANK = 45_000
_ENDINGS = ("", "s", "es", "ed", "d", "ing", "ly", "er", "y")


@lru_cache(maxsize=1)
def _pieces() -> frozenset[str]:
    with open(VOCABULARY, "rb") as lines:
        rows = (line.split() for line in lines)
        known = [base64.b64decode(a) for a, b in rows if int(b) < FAMILIAR_RANK]
    return frozenset(w[1:].decode("utf-8", "ignore").lower() for w in known if w[:1] == b" " and len(w) > 1)


def _known(word: str) -> bool:
    return any(word.endswith(e) and word[: len(word) - len(e)] in _pieces() and len(word) - len(e) > 2 for e in _ENDINGS) or word in _pieces()


@lru_cache(maxsize=200_000)
def familiar(word: str) -> bool:
    """One piece of the vocabulary, with or without a plain ending, or two such pieces joined."""
    return _known(word) or any(word[:k] in _pieces() and _known(word[k:]) for k in range(4, len(word) - 3))


GRADES = ("flesch_kincaid", "fog", "smog", "coleman_liau", "automated", "dale_chall", "lix_grade")


@lru_cache(maxsize=200_000)
def _token(token: str) -> tuple[int, int, int, int, int, int]:
    """syllables, letters, hard, number or sign, argument word, unfamiliar

    A familiar word counts two syllables at most and names count as familiar
    words of two, as they do in the formulas that use word lists.
    """
    low = token.lower()
    if len(token) > 40:
        return 2, 6, 0, 1, 0, 1
    if _HOUSE.match(token):
        return 2, min(len(token), 4), 0, 0, 0, 0
    if not token.isalpha() and not (token[0].isalpha() and all(c.isalpha() or c in "'’-" for c in token)) or len(token) == 1 and low not in ("a", "i", "o") or len(token) > 1 and token.isupper():
        return 2, min(len(token), 6), 0, 1, 0, 1
    if low in ARGUMENT_WORDS:
        return syllables(low), len(token), 0, 0, 1, 0
    known = all(familiar(part) for part in re.split("['’-]", low) if len(part) > 2)
    if token[0].isupper() and not known:
        return 2, 5, 0, 0, 0, 0
    n = syllables(low)
    if known:
        return min(n, 2), min(len(token), 7), 0, 0, 0, 0
    return n, len(token), int(n >= 3), 0, 0, 1


def counts(sentence: str) -> tuple[int, ...]:
    """words, then the sums of :func:`_token`"""
    tokens = _TOKEN.findall(sentence.capitalize() if sentence.isupper() else sentence)
    if not tokens:
        return (0,) * 7
    return (len(tokens), *map(sum, zip(*map(_token, tokens))))


def grades(table: np.ndarray) -> np.ndarray:
    """School grades (n, 7) of sentences given their counts (n, 7), by the formulas in GRADES."""
    w, syl, let, hard, _, _, new = (table[:, k].astype(float) for k in range(7))
    w = np.maximum(w, 1)
    return np.stack(
        [
            0.39 * w + 11.8 * syl / w - 15.59,
            0.4 * (w + 100 * hard / w),
            1.043 * np.sqrt(30 * hard) + 3.1291,
            5.88 * let / w - 29.6 / w - 15.8,
            4.71 * let / w + 0.5 * w - 21.43,
            15.79 * new / w + 0.0496 * w + 3.6365 * (new / w > 0.05),
            (w + 100 * new / w) / 5 + 1,
        ],
        axis=1,
    )


def features(table: np.ndarray) -> np.ndarray:
    g = grades(table)
    w = np.maximum(table[:, 0], 1).astype(float)
    median = np.median(g, axis=1)
    share = table[:, [3, 4, 5, 6]] / w[:, None]
    base = np.column_stack([median / 10, np.log(w), table[:, 1] / w, table[:, 2] / w / 3, share, np.clip(g, -5, 40) / 10])
    argument, length = share[:, 2], np.log(w)
    return np.column_stack([base, argument * length, argument**2 * 2, share[:, 1] * length, share[:, 1] ** 2, np.maximum(length - 2.5, 0), np.maximum(length - 3.2, 0), np.maximum(median - 8, 0) / 10])


class BandModel:
    """Softmax regression from sentence features to bands."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def scores(self, table: np.ndarray) -> np.ndarray:
        return self._shares(np.column_stack([(features(table) - self.mean) / self.scale, np.ones(len(table))]))

    def _shares(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    @staticmethod
    def fit(samples: list[tuple[str, str]], rounds: int = 3_000, decay: float = 2e-3, rate: float = 0.3) -> "BandModel":
        tables, labels = [], []
        for text, band in samples:
            for sentence in variants(text):
                if band in BANDS and (c := counts(sentence))[0] >= 3:
                    tables.append(c)
                    labels.append(BANDS.index(band))
        table, y = np.array(tables), np.array(labels)
        f = features(table)
        model = BandModel(f.mean(0), f.std(0) + 1e-9, np.zeros((f.shape[1] + 1, len(BANDS))))
        x = np.column_stack([(f - model.mean) / model.scale, np.ones(len(f))])
        goal = np.eye(len(BANDS))[y] * 0.96 + 0.04 / len(BANDS)  # some ratings are wrong
        for _ in range(rounds):
            p = model._shares(x)
            model.weights -= rate * (x.T @ (p - goal) / len(x) + decay * model.weights)
        return model


def language(text: str) -> str | None:
    """The language whose function words are most frequent; NULL where none is."""
    tokens = re.findall(r"[^\W\d_]+", text.lower())
    if not tokens:
        return None
    count = Counter(tokens)
    hits = {lang: sum(count[w] for w in stops & count.keys()) for lang, stops in _STOPS.items()}
    best = max(hits, key=lambda k: hits[k])
    return best if hits[best] >= max(1, 0.08 * len(tokens)) else None


OUT = "language string, band string, grade double, expert_share double, general_share double, sentences int"


def rate(texts: list[str | None], model: BandModel) -> list[tuple]:
    """(language, band, grade, expert share, general share, sentences) per text; NULLs for texts without words."""
    cut: list[str] = []
    owner: list[int] = []
    langs: list[str | None] = []
    for number, text in enumerate(texts):
        parts = sentences(_plain(text)) if text else []
        langs.append(language(text) if text else None)
        cut += parts
        owner += [number] * len(parts)
    if not cut:
        return [(None, None, None, None, None, 0)] * len(texts)
    table = np.array([counts(s) for s in cut])
    who = np.array(owner)
    # Pieces of one or two words only count where a text has nothing longer.
    longer = np.bincount(who, table[:, 0] > 2, len(texts)) > 0
    real = np.where(longer[who], table[:, 0] > 2, table[:, 0] > 0)
    table, who = table[real], who[real]
    size = np.array([len(s) for s in cut])[real].astype(float)
    n = len(texts)
    whole = np.bincount(who, size, n)
    band = model.scores(table).argmax(axis=1) if len(table) else np.empty(0, int)
    shares = np.stack([np.bincount(who, size * (band == k), n) for k in range(len(BANDS))])
    grade = np.bincount(who, size * np.median(grades(table), axis=1), n) if len(table) else np.zeros(n)
    number = np.bincount(who, minlength=n)
    out = []
    for k in range(n):
        if whole[k] == 0:
            out.append((langs[k], None, None, None, None, 0))
        else:
            s = shares[:, k] / whole[k]
            top = len(BANDS) - 1 - int(s[::-1].argmax())
            out.append((langs[k], BANDS[top], round(grade[k] / whole[k], 6), round(s[2], 6), round(s[1], 6), int(number[k])))
    return out


def _plain(text: str) -> str:
    text = text if text.isascii() and "<" not in text and "&" not in text else _kept_case(text)
    return re.sub(r"(?<!\w)[*_~>]+(?=\S)|(?<=\S)[*_~]+(?!\w)|^>\s", "", text)


def _kept_case(text: str) -> str:
    """Markup and unseen characters off, case and signs kept."""
    text = re.sub(r"</?[a-zA-Z][^<>]{0,300}>", " ", html.unescape(text))
    return re.sub("[­​-‏⁠﻿]", "", unicodedata.normalize("NFKC", text))


def reading_levels(docs: DataFrame, samples: DataFrame, *, text: str = "text", sample_text: str = "sample_text", band: str = "band") -> DataFrame:
    """``docs`` without its text, with the columns of OUT in place of any of the same name.

    ``expert_share`` and ``general_share`` are shares of the document's characters.
    Defined results: NULL and blank texts get NULLs and 0 sentences; equal shares
    go to the more demanding band; the whole text counts, whatever its length.
    The bands' model is fitted on at most MOST_SAMPLES rated samples.
    """
    rated = samples.where(F.col(sample_text).isNotNull() & F.col(band).isin(*BANDS)).select(sample_text, band).orderBy(F.xxhash64(sample_text), sample_text, band).limit(MOST_SAMPLES).collect()
    model = docs.sparkSession.sparkContext.broadcast(BandModel.fit([(r[0], r[1]) for r in rated]))
    names = [c.split()[0] for c in OUT.split(", ")]
    kept = [c for c in docs.columns if c != text and c.lower() not in names]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept) + OUT
    docs = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rated = pd.DataFrame(rate(frame[text].tolist(), model.value), columns=names, index=frame.index)
            yield pd.concat([frame[kept], rated], axis=1)

    return spread(docs).mapInPandas(run, schema)


__all__ = ["BandModel", "rate", "reading_levels", "sentences", "syllables"]
