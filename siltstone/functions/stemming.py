"""English stems, after the published description of the Porter2 algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published description.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3 or not word.isascii():
        return word
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after(w, 0)
    r2 = _after(w, r1)
    short = lambda x: len(x) <= r1 and bool(_SHORT_END.match(x))

    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in UNCHANGED:
        return w

    found = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if found in ("eed", "eedly"):
        if len(w) - len(found) >= r1:
            w = w[: -len(found)] + "ee"
    elif found and re.search("[aeiouy]", w[: -len(found)]):
        w = w[: -len(found)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif short(w):
            w += "e"
    w = re.sub(r"(?<=.[^aeiouyY])[yY]$", "i", w)

    found = _longest(w, [*STEP_2, "ogi", "li"])
    if found and len(w) - len(found) >= r1:
        if found == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif found == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(found)] + STEP_2[found]
    found = _longest(w, [*STEP_3, "ative"])
    if found and len(w) - len(found) >= (r2 if found == "ative" else r1):
        w = w[: -len(found)] + STEP_3.get(found, "")
    found = _longest(w, [*STEP_4, "ion"])
    if found and len(w) - len(found) >= r2 and (found != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(found)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.match(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(terms: Column) -> Column:
    """Each word of an array column stemmed; words outside ASCII stay."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [stem(t) for t in x] for x in lists])

    return run(terms)
