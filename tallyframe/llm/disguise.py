"""Texts to plain word tokens, with the usual disguises of words undone.

Undone: markup within words, invisible characters, look-alike letters of other alphabets, accents, wrong encodings, digits
and signs for letters, separators within words, letters set apart by blanks, stretched letters. Letters masked by stars
keep their first and last letter around one star. Numbers become ``#``; the end of a sentence or line becomes ``.``.
"""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other alphabets that look like Latin ones, and signs that stand for letters.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝѵгтвмнкпьѐёαεορτυνικβηχ",
    "aeopcyxijshdqwvrtbmhknbeeaeoptuvikbhx",
)
SIGNS = str.maketrans("01345789$@!€", "oieastbgsaie")
INVISIBLE = dict.fromkeys([0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF], None)

_BREAK = re.compile(r"<br ?/?>|</?(?:p|blockquote|div|li|ul|tr|td)\b[^>]*>|\[/?(?:quote|list|img|url)[^\]]*\]", re.IGNORECASE)
_MARKUP = re.compile(r"</?[a-z][^<>\n]{0,80}>|\[/?[a-z*]{1,8}(?:=[^\]\n]{0,80})?\]", re.IGNORECASE)
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+")
_BROKEN = re.compile(r"[ÂÃâ][\u0080-¿Œ-™]{1,2}")
_SPACED = re.compile(r"(?<![\w'])(?:[^\W\d_][ ]){2,}[^\W\d_](?![\w'])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[\w$@€](?:[\w$@€*!'’._-]*[\w$@€*])?|[.!?…]+(?=\s|$)|\n+")
_PLAIN = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*(?:st|nd|rd|th|mm|cm|kg|g|am|pm|h)?")
_MASK = re.compile(r"\*+")
_JUNK = re.compile(r"[^a-z*]+")


def _mend(m: re.Match) -> str:
    t = m.group(0)
    for code in ("cp1252", "latin-1"):
        try:
            return t.encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return t


def plain(text: str) -> str:
    """Lower-case text without markup, accents and look-alikes."""
    t = text if text.isascii() else text.translate(INVISIBLE)
    if "&" in t:
        t = html.unescape(t).translate(INVISIBLE)
    if "<" in t or "[" in t:
        t = _MARKUP.sub("", _BREAK.sub("\n", t))
    if not t.isascii():
        t = _BROKEN.sub(_mend, t)
        t = unicodedata.normalize("NFKD", t.lower().replace("ß", "ss"))
        t = "".join(c for c in t if not unicodedata.combining(c)).translate(LOOKALIKES)
    else:
        t = t.lower()
    if "@" in t or "://" in t or "www." in t:
        t = _LINK.sub(" url ", t)
    return _SPACED.sub(lambda m: m.group(0).replace(" ", ""), t)


def word(w: str) -> str:
    """One token in plain letters; ``#`` for a number, ``.`` for an end, empty for nothing."""
    if w[0] in ".!?…\n":
        return "."
    w = _STRETCHED.sub(r"\1", w)
    if _PLAIN.fullmatch(w):
        return w
    if _NUMBER.fullmatch(w):
        return "#"
    w = w.replace("'", "").replace("’", "")
    letters = sum(c.isalpha() for c in w)
    if letters or any(c in "$@" for c in w):
        w = w.translate(SIGNS)
    return _JUNK.sub("", _MASK.sub("*", w.replace("_", "")))


class _Known(dict):
    """Tokens of words met before; emptied when it grows large, which changes no result."""

    def __missing__(self, w: str) -> str:
        if len(self) > 500_000:
            self.clear()
        t = word(w)
        if len(w) < 40:
            self[w] = t
        return t


_KNOWN = _Known()


def tokens(text: str | None) -> list[str]:
    """Words, numbers as ``#`` and sentence ends as ``.`` (never two in a row)."""
    out = ["."]
    for w in _WORD.findall(plain(text)) if text else ():
        t = _KNOWN[w]
        if t and (t != "." or out[-1] != "."):
            out.append(t)
    if out[-1] != ".":
        out.append(".")
    return out
