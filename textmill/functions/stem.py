"""The English Snowball stemmer, for distinct words: a word's beginnings and endings decide, so each is worked out once and
joined back to the text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the published algorithm: words with a stem of their own, words left as they are, and beginnings behind
#: which the first region starts.
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")
#: Endings in the first region and what stands for them.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Endings that go in the second region.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_VOWEL = "aeiouy"
_REGION = re.compile(f"[{_VOWEL}][^{_VOWEL}]")
_SHORT = re.compile(f"(?:^|[^{_VOWEL}])[{_VOWEL}][^{_VOWEL}wxY]$|^[{_VOWEL}][^{_VOWEL}]$")


def _behind(word: str, start: int) -> int:
    """Where the region begins behind the first vowel with a consonant after it."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has, or an empty text."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _has_vowel(part: str) -> bool:
    return any(c in _VOWEL for c in part)


def stem(word: str) -> str:
    """The stem of a word in lower case. Words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = word.replace("’", "'").removeprefix("'")
    if word in OWN:
        return OWN[word]
    # A y that is a consonant counts as Y until the end.
    word = re.sub(f"(?:^|(?<=[{_VOWEL}]))y", "Y", word)
    start = next((len(b) for b in BEGINNINGS if word.startswith(b)), None)
    first = start if start is not None else _behind(word, 0)
    second = _behind(word, first)

    word = word.removesuffix(_ending(word, ("'", "'s", "'s'")))

    end = _ending(word, ("sses", "ied", "ies", "s", "us", "ss"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in LEFT:
        return word

    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= first:
            word = word[: -len(end)] + "ee"
    elif end and _has_vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] in "bdfgmnprt":
            word = word[:-1]
        elif first >= len(word) and _SHORT.search(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"

    end = _ending(word, SECOND)
    if end and len(word) - len(end) >= first:
        before = word[: -len(end)]
        if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and before[-1:] not in "cdeghkmnrt"):
            word = before + SECOND[end]

    end = _ending(word, THIRD)
    if end and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + THIRD[end]

    end = _ending(word, FOURTH)
    if end and len(word) - len(end) >= second and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]

    if word.endswith("e"):
        if len(word) - 1 >= second or (len(word) - 1 >= first and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """terms with the column stemmed: each distinct word passes through Python once."""
    words = terms.select(column).distinct().withColumn("_stem", stem_words(F.col(column)))
    return terms.join(words, column).withColumn(column, F.col("_stem")).drop("_stem")
