"""English stems by the published Snowball rules (Porter's second stemmer)."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the rules: words with stems of their own, words that stay as they are behind the first step, beginnings whose first
# region is theirs, and the endings of steps 2 to 4 with what takes their place.
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
FIRST_REGION = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()

REGION = re.compile("[aeiouy][^aeiouy]")
VOWEL = re.compile("[aeiouy]")
SHORT_SYLLABLE = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: behind the first consonant that follows a vowel, and the same inside the first region."""
    own = next((len(b) for b in FIRST_REGION if word.startswith(b)), None)
    m = REGION.search(word)
    first = own if own is not None else m.end() if m else len(word)
    m = REGION.search(word, first)
    return first, m.end() if m else len(word)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and those with other signs than a to z and ' are returned as they are."""
    if word in OWN:
        return OWN[word]
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    first, second = _regions(w)
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w.removesuffix(e)
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    # past and participles
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= first:
            w = w[: -len(e)] + "ee"
    elif e and VOWEL.search(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif DOUBLE.search(w):
            w = w[:-1]
        elif len(w) <= first and SHORT_SYLLABLE.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # step 2
    e = _longest(w, [*STEP_2, "ogi", "li"])
    if e and len(w) - len(e) >= first:
        before = w[: -len(e)]
        if e == "ogi":
            w = before + "og" if before.endswith("l") else w
        elif e == "li":
            w = before if before[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = before + STEP_2[e]
    # step 3
    e = _longest(w, [*STEP_3, "ative"])
    if e and len(w) - len(e) >= first:
        if e != "ative":
            w = w[: -len(e)] + STEP_3[e]
        elif len(w) - len(e) >= second:
            w = w[: -len(e)]
    # step 4
    e = _longest(w, [*STEP_4, "ion"])
    if e and len(w) - len(e) >= second and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    # step 5
    if w.endswith("e") and (len(w) - 1 >= second or (len(w) - 1 >= first and not SHORT_SYLLABLE.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.lower()
