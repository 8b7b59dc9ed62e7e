"""English analysis as PostgreSQL's english configuration does it: stop words, and the Porter2 (Snowball) stemmer after its published rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of PostgreSQL's full-text search.
STOP_WORDS = frozenset(
    (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
        "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
        "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
        "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
    ).split()
)
# Words that the rules would get wrong, and those that stay after the plural rules.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAYING = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_V, _DOUBLE = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"),
    ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _regions(w: str) -> tuple[int, int]:
    """Where the regions behind the first and second vowel and consonant begin."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if start is None:
        m = _REGION.search(w)
        start = m.end() if m else len(w)
    m = _REGION.search(w, start)
    return start, m.end() if m else len(w)


def _has_vowel(s: str) -> bool:
    return any(c in _V for c in s)


def stem(w: str) -> str:
    """The Porter2 stem of a lower-cased word; words of other letters stay as they are."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(r"(?<=[aeiouy])y", "Y", re.sub("^y", "Y", w))
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in STAYING:
        return w
    if w.endswith(("eedly", "eed")):
        end = 5 if w.endswith("eedly") else 3
        if len(w) - end >= r1:
            w = w[: len(w) - end] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if _has_vowel(rest := w[: -len(end)]):
                    if rest.endswith(("at", "bl", "iz")):
                        rest += "e"
                    elif rest.endswith(_DOUBLE):
                        rest = rest[:-1]
                    elif r1 >= len(rest) and _SHORT.search(rest):
                        rest += "e"
                    w = rest
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w.endswith("logi")) and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(end)] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes(words: list[str]) -> list[tuple[str, int]]:
    """Stems and places of a query's words; stop words have none but count as places."""
    return [(stem(w), k) for k, w in enumerate(words) if w not in STOP_WORDS]


def _stems(terms: pd.Series) -> pd.Series:
    return terms.map(stem)


def stems(term: Column) -> Column:
    """Stems of a column of distinct terms, in Arrow batches."""
    return F.pandas_udf(_stems, "string")(term)


def indexed(term: Column) -> Column:
    return ~term.isin(*sorted(STOP_WORDS))
