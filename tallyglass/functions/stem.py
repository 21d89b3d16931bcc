"""Stems of English words by Porter's rules of 1980, and folding of marks, by distinct term."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The suffix rules of the published algorithm, by step, longest match first.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """A letter a character: v for vowels (also y after a consonant), c for consonants."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short(stem: str) -> bool:
    return _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


def _suffix(word: str, suffixes: object) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with other letters than a to z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if (s := _suffix(word, ("sses", "ies", "ss", "s"))) is not None:
        word = word[: len(word) - len(s)] + {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}[s]
    if (s := _suffix(word, ("eed", "ed", "ing"))) is not None:
        left = word[: len(word) - len(s)]
        if s == "eed":
            word = left + "ee" if _measure(left) > 0 else word
        elif "v" in _kinds(left):
            word = left
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif re.search(r"(.)\1$", word) and word[-1] not in "aeioulsz" and _kinds(word)[-1] == "c":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP2, STEP3):
        if (s := _suffix(word, rules)) is not None and _measure(word[: len(word) - len(s)]) > 0:
            word = word[: len(word) - len(s)] + rules[s]
    if (s := _suffix(word, STEP4)) is not None:
        left = word[: len(word) - len(s)]
        if _measure(left) > 1 and (s != "ion" or left.endswith(("s", "t"))):
            word = left
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _short(left)):
            word = left
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def folded(word: str) -> str:
    """Without marks above or below letters, and with ligatures and wide forms taken apart."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()


def term(word: str) -> str:
    return stem(folded(word))


def dictionary(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, term) of the distinct words: each is folded and stemmed once, however often it occurs."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "term": b["word"].map(term)})

    return words.selectExpr(f"`{column}` as word").where("word is not null").distinct().mapInPandas(task, "word string, term string")
