"""Small corpora with the cases that operators must stand."""

import random

DOCS = "doc_id long, text string, extra string, rank int, count long, rest string"


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7)))


def docs(n=60, seed=1):
    """(doc_id, text): copies, near copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    passage = " ".join(word(rng) for _ in range(80))
    out = []
    for i in range(n):
        words = [word(rng) for _ in range(rng.randint(1, 160))]
        if i % 4 == 1:
            words = out[-1][1].split(" ")
            if words and i % 8 == 1:
                words = [w if rng.random() > 0.02 else word(rng) for w in words]
        if i % 5 == 2:
            at = rng.randint(0, len(words))
            words[at:at] = passage.split(" ")
        out.append((i, " ".join(words)))
    out += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "one"), (n + 4, "One two\x0bthree"), (n + 5, "ÄÖ é 日本語 😀 x"), (n + 6, "ab " * 400), (n + 7, "z" * 3000), (3, out[3][1]), (3, out[3][1]), (None, "lonely text of a row without id"), (None, None)]
    long = " ".join(word(rng) for _ in range(40_000))
    return [*out, (n + 8, long), (n + 9, long[: len(long) // 2])]


def frame(spark, rows):
    """Rows as a table with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "e", 1, 2, "r") for i, t in rows], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
