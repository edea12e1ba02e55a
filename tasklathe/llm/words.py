"""Words of a text, compared without case, accents, punctuation, spacing, markup, invisible characters or hyphens at line ends."""

from __future__ import annotations

import html
import unicodedata

import regex

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}ᅟᅠㅤﾠ]+")
_HYPHEN_END = regex.compile(r"(?<=\p{L})[-‐‑][ \t]*\r?\n[ \t]*(?:>+[ \t]*)?(?=\p{L})")
# A tag is told by its form, however long: a name, then attributes. Possessive, so that each place is tried once.
_TAG = regex.compile(r"""</?+[A-Za-z][\w:-]*+(?:\s++[^\s<>="'/]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>]++))?+)*+\s*+/?+>""")
_LINK = regex.compile(r"\]\([^()\s]++\)")
_ENTITY = regex.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_MARK = regex.compile(r"\p{M}+")
_INNER = regex.compile(r"(?<=\w)[*_~`]+(?=\w)|(?<=\p{L})['’](?=\p{L})")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out.append(text[at:a])
        at = b + 3
    return " ".join([*out, text[at:]])


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; [] for null, empty or wordless text."""
    if not text:
        return []
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "\n" in text:
        text = _HYPHEN_END.sub("", text)
    if "<!--" in text:
        text = _without_comments(text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if regex.match(r"</?(?:b|i|em|strong|u|s|span|font|a|mark|sub|sup|small|wbr)\b", m[0], regex.I) else " ", text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text))
    text = _INNER.sub("", text)
    return _WORD.findall(text.casefold())
