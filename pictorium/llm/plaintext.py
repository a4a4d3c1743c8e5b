"""Folding of disguised spellings, shared by the text operators."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ѡ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}

_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>")
_LINK = re.compile(r"!?\[([^\[\]]{0,300})\]\([^()\s]{0,300}\)")
_BROKEN = re.compile(r"(\w)-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_QUOTE = re.compile("['‘’ʼ`´]")
_TABLE = str.maketrans(LOOKALIKES)


def folded(text: str) -> str:
    """The text in lower case and plain letters: no markup, unseen characters, accents, lookalikes or broken lines."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(r"\1 ", text)
    if "-" in text and "\n" in text:
        text = _BROKEN.sub(r"\1", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _UNSEEN.sub("", text)).casefold()
    return "".join([c for c in text if not unicodedata.combining(c)]).translate(_TABLE)


_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words of the folded text; apostrophes and emphasis marks don't part a word."""
    return _WORD.findall(_QUOTE.sub("", folded(text)))
