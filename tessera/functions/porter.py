"""Porter's stemmer (M. F. Porter, 1980) and the stemmed tokens of a text as an Arrow-batched function."""

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of the published algorithm, by step: suffix, replacement.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def short_end(stem: str) -> bool:
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case ASCII word; other words and those of under 3 letters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        cut = next((len(s) for s in ("ed", "ing") if w.endswith(s) and "v" in shape(w[: -len(s)])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif measure(w) == 1 and short_end(w):
                w += "e"
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                if measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            left = w[: -len(suffix)]
            if measure(left) > 1 and (suffix != "ion" or left.endswith(("s", "t"))):
                w = left
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def tokens(text: str) -> list[str]:
    """Unicode letters and digits, marks removed, lower case, stemmed."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)) if not text.isascii() else text
    return [stem(t) for t in re.findall(r"[^\W_]+", plain.lower())]


#: Texts, and their characters, that are stemmed at once: their tokens are Python objects, of which a batch of long texts would hold far more than its own size.
SLICE_ROWS = 500
SLICE_CHARS = 1 << 20


def slices(batch: pd.Series) -> Iterator[pd.Series]:
    """A batch in parts of at most SLICE_ROWS texts and, beyond one text, SLICE_CHARS characters."""
    first = held = 0
    for i, t in enumerate(batch):
        n = len(t or "")
        if i > first and (i - first == SLICE_ROWS or held + n > SLICE_CHARS):
            yield batch.iloc[first:i]
            first, held = i, 0
        held += n
    yield batch.iloc[first:]


def _stem_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        for part in slices(batch):
            yield part.map(lambda t: tokens(t or ""))


def stemmed(text: "Column | str") -> Column:
    """The stemmed tokens of a text, in order."""
    return F.pandas_udf(_stem_batches, "array<string>")(text)


def counted(text: "Column | str", words: list[str]) -> Column:
    """length and tf of a text: its number of stemmed tokens and how often each of ``words`` is among them. The tokens stay in Python, a text at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                said = [(len(t), [t.count(w) for w in words]) for t in (tokens(x or "") for x in part)]
                yield pd.DataFrame({"length": [n for n, _ in said], "tf": [tf for _, tf in said]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "length int, tf array<int>")(text)
