"""The few functions that have no built-in equal, as Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as t

# Endings after which a full stop does not end a sentence.
ABBREVIATIONS = {
    "e.g", "i.e", "et al", "cf", "vs", "fig", "figs", "eq", "eqs", "ref", "refs", "tab", "no", "approx", "resp", "ca", "sp", "spp", "al",
    "dr", "prof", "mr", "ms", "st", "vol", "pp", "ed", "eds", "min", "max", "std", "avg", "e.g.,",
}
# The word before a possible end of a sentence, its stop, and what closes behind it.
_STOP = re.compile(r"([^\s(\[]*[.!?])[\"'”’)\]]*(?=\s|$)")
_BARE = re.compile(r"[a-z]|\d+")
_GAP = re.compile(r"\s*")


def fold(text: str | None) -> str | None:
    """Compatibility decomposition without combining marks."""
    if text is None or text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(t.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    return text.map(fold)


def _stops(stop: re.Match) -> bool:
    word = stop[0].rstrip(".!?\"')]").lower()
    return word not in ABBREVIATIONS and not _BARE.fullmatch(word)


def _stands_alone(text: str) -> bool:
    return len(text.strip()) >= 15 or text.strip().endswith(("?", "!"))


def sentences(text: str) -> list[tuple[int, int]]:
    """[start, end) of sentences: the text between stops that don't follow an abbreviation, an initial or a bare number, in
    which pieces of fewer than 15 characters that are neither question nor exclamation belong to what follows them."""
    ends = [m.end() for m in _STOP.finditer(text) if _stops(m)]
    begins = [0, *(_GAP.match(text, e).end() for e in ends)]
    found: list[tuple[int, int]] = []
    for piece in zip(begins, [*ends, len(text.rstrip())], strict=True):
        if found and not _stands_alone(text[slice(*found[-1])]):
            piece = found.pop()[0], piece[1]
        if not text[slice(*piece)].isspace() and piece[0] < piece[1]:
            found.append(piece)
    return found


@F.pandas_udf(t.ArrayType(t.ArrayType(t.IntegerType())))
def sentence_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [list(s) for s in sentences(x or "")])


_PLAIN = str.maketrans({"\u2019": "'", "\u2018": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00a0": " ", "\ufb01": "fi", "\ufb02": "fl"})
# ASCII words with single spaces between: only their case is folded.
_RUN = re.compile(r"[!-~]+(?: [!-~]+)*")
_FOLDED = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")


def _matchable(text: str) -> tuple[str, Sequence[int]]:
    """The folded text in which quotes are looked up, and the place in the original of each of its characters."""
    # Printable texts have no white space but spaces; a capital sigma's lower case depends on its place in a word.
    if text.isprintable() and "  " not in text and text[:1] != " " and "\u03a3" not in text:
        lower = (text.translate(_PLAIN) if not text.isascii() and _FOLDED.search(text) else text).lower()
        if len(lower) == len(text):
            lower = lower.removesuffix(" ")
            return lower, range(len(lower))
    chars, places, gap, place = [], [], True, 0
    while place < len(text):
        if run := _RUN.match(text, place):
            chars.append(run[0].lower())
            places.extend(range(place, run.end()))
            gap, place = False, run.end()
            continue
        c, at, place = text[place], place, place + 1
        if c not in "\n\t" and unicodedata.category(c) in ("Cc", "Cf", "Co"):
            continue
        plain = c.translate(_PLAIN)
        if plain.isspace():
            if not gap:
                chars.append(" ")
                places.append(at)
            gap = True
            continue
        gap = False
        lower = plain.lower()
        chars.append(lower)
        places.extend([at] * len(lower))
    if chars and chars[-1] == " ":
        chars.pop()
        places.pop()
    return "".join(chars), places


def excerpt_span(text: str | None, excerpt: str | None) -> dict | None:
    """Where a quote stands in a text (start, end, mode): exact, or only its head (60 %, 40 characters at least)."""
    return excerpt_spans(text, [excerpt])[0]


def excerpt_spans(text: str | None, excerpts: Sequence[str | None]) -> list[dict | None]:
    """``excerpt_span`` of several quotes in a text, which is folded once."""
    where, places = _matchable(text or "")
    return [_span(where, places, _matchable(x or "")[0]) for x in excerpts]


def _span(where: str, places: Sequence[int], quote: str) -> dict | None:
    if not where or not quote:
        return None
    for part, mode in ((quote, "exact"), (quote[: max(40, int(len(quote) * 0.6))], "head")):
        at = where.find(part)
        if at >= 0:
            return {"start": places[at], "end": places[min(at + len(part), len(places)) - 1] + 1, "mode": mode}
    return None


_SPAN = t.StructType().add("start", "integer").add("end", "integer").add("mode", "string")


@F.pandas_udf(_SPAN)
def find_excerpt(text: pd.Series, excerpt: pd.Series) -> pd.DataFrame:
    rows = [excerpt_span(x, e) or {"start": None, "end": None, "mode": None} for x, e in zip(text, excerpt, strict=True)]
    out = pd.DataFrame(rows, columns=["start", "end", "mode"])
    return out.astype({"start": "Int32", "end": "Int32"})


@F.pandas_udf(t.ArrayType(_SPAN))
def find_excerpts(text: pd.Series, excerpts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or e is None else excerpt_spans(x, list(e)) for x, e in zip(text, excerpts, strict=True)], dtype=object)


# --- Porter's stemmer (1980), from the published rules -------------------------------------------------------------

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and len(stem) >= 3 and stem[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3 or not word.isascii():
        return word
    w = word
    if w.endswith("s"):
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif not w.endswith("ss"):
            w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if "v" in _shape(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if end:
        stem = w[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(t.StringType())
def stem(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else porter(w))


@F.pandas_udf(t.StringType())
def _root(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else porter(fold(w)))


#: Stem of the folded word. Declared as it is so that no filter on stems is moved below it: each distinct word is stemmed once.
root_once = _root.asNondeterministic()
