"""Look-alike folding: the character tables and the skeleton function.

The skeleton of a text is what a reader sees of it: canonical decomposition, every character replaced by the
prototype of its look-alike class, invisible characters dropped, decomposition again. Two texts look the same
exactly if their skeletons are equal. Upper and lower case, digits, accents and line breaks stay distinct.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other scripts and the Latin letter of the same shape, as pairs.
LOOK_ALIKE_LETTERS = (
    "аa еe оo рp сc уy хx іi ѕs ԁd һh ԝw ԛq јj ӏl ѵv гr ԍG ɡg ɑa ıı "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ ԌG ԚQ ԜW ҮY ӀI Ѵv "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp αa ιi υu γy κk χx"
)
# Letters of rarer scripts and the Latin letter of the same shape, as pairs: Cherokee, Lisu, Armenian, Coptic, further
# Greek and Latin ones.
RARE_LOOK_ALIKES = (
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᏔW ᎩY ᏃZ "
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    "ՏS ՍU ՕO օo ոn սu հh ցg զq յj աw "
    "ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc ⲭx "
    "ϹC ϲc ϳj ͿJ ϒY σo ſf ɩi ꞮI ᴏo ᴄc ᴠv ᴡw ᴢz"
)
# Hyphens and minus signs that are drawn as the hyphen-minus.
HYPHENS = "‐‑‒–⁃−﹘﹣－"
# Quotation marks that are drawn alike.
QUOTES = {"’": "'", "‘": "'", "ʼ": "'", "“": '"', "”": '"'}
# Invisible characters outside the format category (joiner, fillers, variation selectors).
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
_KEPT_FORMATS = "‭‮"  # these two change the order in which a reader sees the letters
_LINE_ENDS = "\n\r\x0b\x0c\x85  "
_LIGATURES, _ROMAN = range(0xFB00, 0xFB07), range(0x2160, 0x2180)
_JOINER, _JOINED = "‍", ""  # the second, a private character, stands for a joiner that is visible


def _prototype(ch: str) -> str:
    """The prototype of one decomposed character."""
    if ch in INVISIBLE:
        return ""
    if ch in HYPHENS:
        return "-"
    if ch in QUOTES:
        return QUOTES[ch]
    if ch in _LINE_ENDS:
        return "\n"
    if ch in "\u2800\t":
        return " "
    category = unicodedata.category(ch)
    if category == "Zs":
        return " "
    if category == "Cf":
        return ch if ch in _KEPT_FORMATS else ""
    if category == "Cc":
        return ""
    form = unicodedata.decomposition(ch)
    # wide and narrow forms, letters in another type (mathematical ones), ligatures and letters used as Roman numerals
    if form.startswith(("<wide>", "<narrow>", "<font>")) or ord(ch) in _LIGATURES or ord(ch) in _ROMAN:
        # what they stand for may itself look like a letter: a bold Greek alpha
        return "".join(prototypes().get(ord(c), c) for c in unicodedata.normalize("NFKD", ch))
    return ch


class _Prototypes(dict):
    """A translation table that fills itself; it holds at most one entry for each code point."""

    def __missing__(self, code: int) -> str:
        self[code] = value = _prototype(chr(code))
        return value


@lru_cache(maxsize=1)
def prototypes() -> _Prototypes:
    table = _Prototypes()
    for pair in (LOOK_ALIKE_LETTERS + " " + RARE_LOOK_ALIKES).split():
        table[ord(pair[0])] = pair[1:]
    return table


def load_confusables(path: str) -> dict[int, str]:
    """A table in the format of the public list of confusables (``code ; codes ; class # remark`` with hexadecimal codes), to
    be used beside the built-in one: letters of other shapes in the list count as looking the same then."""
    table = {}
    with open(path, encoding="utf-8-sig") as rows:
        for row in rows:
            fields = [x.strip() for x in row.partition("#")[0].split(";")]
            if len(fields) >= 2 and fields[0]:
                table[int(fields[0], 16)] = "".join(chr(int(x, 16)) for x in fields[1].split())
    return table


def _emoji_joins(text: str) -> str:
    """A joiner before a pictograph makes one picture of two, so it is visible there: keep it as a private mark."""
    if _JOINER not in text:
        return text
    ahead = text[1:] + " "
    return "".join(_JOINED if ch == _JOINER and unicodedata.category(nxt) == "So" else ch for ch, nxt in zip(text, ahead))


def skeleton(text: str | None, more: dict[int, str] | None = None) -> str | None:
    """The skeleton of a text; null for null, empty for a text without a visible character. ``more`` is a loaded table."""
    if text is None:
        return None
    if not text.isascii() or more:
        text = unicodedata.normalize("NFD", _emoji_joins(text.replace("\r\n", "\n"))).translate(prototypes())
        text = unicodedata.normalize("NFD", text.translate(more) if more else text)
    elif "\r" in text or "\t" in text or not text.replace("\n", "").isprintable():
        text = text.replace("\r\n", "\n").translate(prototypes())
    return text if text.strip() else ""


#: A text without any of these characters is its own skeleton, so Spark need not hand it to Python.
PLAIN = r"^[\n -~]*$"
