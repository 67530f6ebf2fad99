"""Small tables with the hard cases, and brute-force versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    syllables = ["th", "er", "an", "in", "on", "re", "ti", "es", "ch", "é", "ou", "ß"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents() -> list[tuple]:
    """Null, empty and blank texts, exact and near copies, repeated rows, ties, a shared passage, periodic and long texts, a null id."""
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split(" ")
    passage = prose(rng, 60)
    texts: list[str | None] = [None, "", "   \n\t", "Hello", "one two three four", base, base, base.upper()]
    for i in range(12):
        changed = list(words)
        for _ in range(1 + i // 3):
            changed[rng.randrange(len(changed))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    texts += [f"{prose(rng, 20 + 3 * i)} {passage} {prose(rng, 10 + i)}" for i in range(8)]
    texts += ["ab" * 400, "a" * 700, "line of text\n" * 60, prose(rng, 30_000), "é" * 150, "x" * 199, "x" * 200]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[9], (None, texts[12], "en", "s0", 5), (None, None, None, None, None)]


def frame(spark, rows=None, clash: bool = False):
    """The documents; with ``clash``, also columns named like those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, ROWS)
    for c in ("size", "shard", "_n", "_k", "_i", "_score", "digest", "bucket", "id", "class_id", "w", "tokens", "p", "head", "row") if clash else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def shingles(text: str | None) -> Counter:
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows: list[tuple]) -> dict[int, int]:
    """doc_id -> least doc_id of its class, by comparing all pairs."""
    own = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    top = {i: i for i, _ in own}

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for n, (i, a) in enumerate(own):
        for j, b in own[:n]:
            both = (a & b).total()
            if both >= 0.8 * (a.total() + b.total() - both):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in own}


def removed(rows: list[tuple], length: int = 200) -> list[bytearray]:
    """A mark for each byte that a repeated string covers."""
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append(mark)
    return out
