"""Texts folded to one spelling: markup, look-alike letters, hidden characters, wrong encodings."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ɡ": "g", "ӏ": "l", "ι": "i", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ε": "e", "κ": "k",
}
_LOOKALIKE = str.maketrans(LOOKALIKES)
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_BROKEN_LINE = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n\s*(?=[^\W\d_])")
_WRONG = re.compile("[ÃÂ][\x80-¿\u0152-\u2122]|â[\x80-\x9f\u0152-\u2122][\x80-¿\u0152-\u2122]")


def _right(match: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return match[0].encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return match[0]


def decoded(text: str) -> str:
    """Letters whose UTF-8 bytes were read as Latin-1 or Windows-1252, put right."""
    return _WRONG.sub(_right, text)


def fold(text: str) -> str:
    """Lower case without markup, hidden characters, line-end hyphens and look-alikes; accents stay."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", decoded(text)))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text:
        text = _BROKEN_LINE.sub("", text)
    text = text.lower()
    return text if text.isascii() else text.translate(_LOOKALIKE)
