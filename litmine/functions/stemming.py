"""The Snowball English stemmer (Porter2), by its published rules."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with a stem of their own.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay as they are once a plural s is gone.
LEFT_ALONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Endings after which li goes, and double letters of which one goes.
LI_AFTER, DOUBLES = "cdeghkmnrt", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Suffixes of the second and third step, in the first region, and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Suffixes of the fourth step, which go in the second region.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_VOWEL = "[aeiouy]"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin."""
    known = re.match("gener|commun|arsen", word)
    m = known or _REGION.search(word)
    first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


@lru_cache(maxsize=500_000)
def english_stem(word: str) -> str:
    """Stem of a lower-case word; each is worked out once in a worker."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(f"^y|(?<={_VOWEL})y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    w = re.sub("(?:'s'|'s|')$", "", w)
    # plurals
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in LEFT_ALONE:
        return w
    # past and continuous forms
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(_VOWEL, w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derived forms
    s = _longest(w, SECOND)
    if s and len(w) - len(s) >= r1 and not (s == "ogi" and w[-4:-3] != "l") and not (s == "li" and w[-3:-2] not in LI_AFTER):
        w = w[: -len(s)] + SECOND[s]
    s = _longest(w, THIRD)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + THIRD[s]
    s = _longest(w, FOURTH)
    if s and len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stem(word: Column) -> Column:
    """``english_stem`` of a column of words."""

    def of(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else english_stem(w))

    return F.pandas_udf(of, "string")(word)
