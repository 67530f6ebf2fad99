"""Text columns: terms, token estimates, overlap scores, lines. All are built-in expressions that stay in the JVM."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import col

TERM = r"[a-z_][a-z0-9_/-]+"
WORD = r"[a-z][a-z0-9]*"
#: The line ends of Python's str.splitlines, longest first.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def terms(text: Column | str) -> Column:
    """The retrieval terms of a text, in order."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TERM), F.lit(0))


def words(text: Column | str) -> Column:
    """The full-text words of a text, in order."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))


def query_terms(query: str) -> Counter[str]:
    return Counter(re.findall(TERM, query.lower()))


def query_words(query: str) -> list[str]:
    """Repeats stay: each adds its own part of a BM25 score."""
    return re.findall(WORD, query.lower())


def occurrences(array: Column, value: str) -> Column:
    """How often a value is in an array, without a lambda."""
    return F.size(array) - F.size(F.array_remove(array, value))


def overlap(found: Column, query: Counter[str]) -> Column:
    """sum of min(query count, text count) over the query's terms / sum of query counts. ``found``: terms of the text."""
    total = sum(query.values())
    if not total:
        return F.lit(0.0)


    def score(terms: Column) -> Column:
        shared = [F.least(F.lit(n), occurrences(terms, t)) for t, n in query.items()]
        return sum(shared[1:], shared[0]).cast("double") / F.lit(float(total))

    return F.get(F.transform(F.array(found), score), F.lit(0))  # binds the terms, which would be found anew for each query term otherwise


def token_estimate(text: Column | str) -> Column:
    n = F.length(col(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).cast("int")


def lines(text: Column | str) -> Column:
    """The lines of a text as Python's splitlines has them: no empty line after a final line end, none for an empty text."""
    t = col(text)
    parts = F.split(t, LINE_END, -1)
    tail = F.element_at(parts, -1) == ""
    return F.when(tail, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def universal_newlines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "\r\n?", "\n")


def strip(text: Column | str) -> Column:
    """Python's strip over the white space that Java's regular expressions know."""
    return F.regexp_replace(col(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def quoted(literal: str) -> str:
    """A literal as a regular expression that Java and Python read alike."""
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", literal) if literal.isascii() else r"\Q" + literal + r"\E"


def whole_word(text: Column | str, literal: str) -> Column:
    return col(text).rlike(rf"(?U)\b{quoted(literal)}\b")
