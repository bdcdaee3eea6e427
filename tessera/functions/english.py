"""English full text: the Porter2 stemmer, stop words, an AND match of stems, and rank by cover density."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the usual English stop list of full-text search
STOP = frozenset(
    [
        "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his",
        "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
        "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
        "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
        "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
        "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
        "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
        "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
    ]
)
# fixed values of the published stemmer
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}}
DONE = frozenset(["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_V = "aeiouy"
_REGION = re.compile(rf"[{_V}][^{_V}]")
_SHORT = re.compile(rf"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$")
_DOUBLE = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
#: Weight of a word without a label of its own in the rank.
PLAIN = 0.1
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def _past(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The Porter2 stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub(rf"(^|[{_V}])y", r"\1Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _past(w, 0) if r1 is None else r1
    r2 = _past(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in DONE:
        return w
    # past tenses and participles
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(rf"[{_V}]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # derivations
    s = _longest(w, STEP2)
    if s and len(w) - len(s) >= r1 and not (s == "ogi" and not w.endswith("logi")) and not (s == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
        w = w[: -len(s)] + STEP2[s]
    s = _longest(w, STEP3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP3[s]
    s = _longest(w, STEP4)
    if s and len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(text: str | None) -> list[str | None]:
    """The stem of each word; None in the place of a stop word, which takes a place but matches nothing."""
    return [None if w in STOP else stem(w) for w in WORD.findall((text or "").lower())]


def wanted(query: str) -> frozenset[str]:
    return frozenset(s for s in stems(query) if s is not None)


def covers(places: list[tuple[int, str]], terms: frozenset[str]) -> list[tuple[int, int, int]]:
    """(first place, last place, terms in it) of each shortest stretch that has all terms, by falling start of the scan."""
    out, start = [], 0
    while True:
        left, end = set(terms), None
        for k in range(start, len(places)):
            left.discard(places[k][1])
            if not left:
                end = k
                break
        if end is None:
            return out
        left, begin = set(terms), end
        for k in range(end, -1, -1):
            left.discard(places[k][1])
            if not left:
                begin = k
                break
        out.append((places[begin][0], places[end][0], end - begin + 1))
        start = begin + 1


def density(text: str | None, terms: frozenset[str]) -> float | None:
    """Rank by cover density: over all covers, the weight of a plain word by one more than the words that aren't terms.

    None where not all terms occur, or there are none.
    """
    return density_at([(i, s) for i, s in enumerate(stems(text)) if s in terms], terms)


def density_at(places: list[tuple[int, str]], terms: frozenset[str]) -> float | None:
    """density() of a text of which the places of terms are known."""
    if not terms or len({s for _, s in places}) < len(terms):
        return None
    return sum(PLAIN / (1 + (b - a) - (n - 1)) for a, b, n in covers(places, terms))


def cover_density(content: str | Column, query: str) -> Column:
    """density() of a column for one query, in Arrow batches; null where the text doesn't match."""
    terms = wanted(query)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([density(t, terms) for t in texts], dtype="float64").astype(object).where(lambda x: x.notna(), None)

    return run(F.col(content) if isinstance(content, str) else content)


def cover_density_of(content: str | Column, query: str | Column) -> Column:
    """cover_density() where each row has a query of its own."""

    @F.pandas_udf("double")
    def run(texts: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([density(t, wanted(q or "")) for t, q in zip(texts, queries, strict=True)], dtype="float64").astype(object).where(lambda x: x.notna(), None)

    return run(*(F.col(c) if isinstance(c, str) else c for c in (content, query)))
