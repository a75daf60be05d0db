"""The Porter stemmer (Porter 1980, "An algorithm for suffix stripping") for lower-case words."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes and their replacements by step, tried from the longest suffix.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
)

RUN = re.compile("v+c+")


def shape(stem: str) -> str:
    """``v`` and ``c`` for vowels and consonants; ``y`` is a vowel after a consonant."""
    marks = ""
    for letter in stem:
        vowel = letter in "aeiou" or (letter == "y" and marks[-1:] == "c")
        marks += "v" if vowel else "c"
    return marks


def measure(stem: str) -> int:
    return len(RUN.findall(shape(stem)))


def double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def swapped(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Words of up to two letters stay."""
    if len(word) < 3:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: -len(suffix)] + new
            break
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if "v" in shape(word[: -len(suffix)]):
                    word = word[: -len(suffix)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif double_end(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif measure(word) == 1 and short_end(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = swapped(swapped(word, STEP_2, 0), STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            if measure(left) > 1 and (suffix != "ion" or left[-1:] in ("s", "t")):
                word = left
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not short_end(word[:-1])):
            word = word[:-1]
    if measure(word) > 1 and double_end(word) and word[-1] == "l":
        word = word[:-1]
    return word
