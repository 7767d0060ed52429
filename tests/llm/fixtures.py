"""Small awkward tables and plain versions to hold the operators against."""

from __future__ import annotations

import random

#: Words of the made-up texts.
VOCABULARY = [a + b for a in ("ba", "co", "di", "fu", "la", "me", "no", "ri", "su", "ty") for b in ("n", "rt", "l", "mo", "sk", "ve", "x", "ddle")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): originals, exact and edited copies, shared lines and passages, junk, nulls."""
    rng = random.Random(seed)
    shared, passage = sentence(rng, 9), sentence(rng, 70)
    texts: list[str | None] = []
    for i in range(n):
        lines = [sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), shared)
        if i % 7 == 0:
            lines.append(passage)
        texts.append("\n".join(lines))
    for i in range(0, n, 3):
        words = texts[i].split(" ")
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words))
    texts += [None, "", "   \n\t ", "one", "one", "a b c d", "A B c D", "naïve Éclair ñandú", "x" * 3000, ("la la la la la la la la la " * 30).strip(), "tab\tand\r\nline", texts[0].replace("n", "m", 1), "\x00nul\x00 " * 30]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(order[i], t, "en", None if i % 11 == 0 else f"src{i % 3 if i % 2 else 0}", None if t is None else len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, seed: int = 0):
    return spark.createDataFrame(corpus(seed) if rows is None else rows, SCHEMA)


def with_clashes(df):
    """df with extra columns of names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("row", "doc", "words", "n", "hits", "items", "key", "shard", "slot", "part", "size", "length", "block", "cluster", "token", "place", "comp", "kept", "n_words", "line", "number", "spans", "runs", "digest", "listed", "host", "_value")
    return df.select("*", *(F.lit(f"extra {c}").alias(c) for c in names if c not in df.columns))


def components(links, nodes):
    """Smallest node reachable, for each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def edits(a: bytes, b: bytes) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]
