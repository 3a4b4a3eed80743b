"""Small documents with every awkward case."""

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, spans string, size long, host string, toxic int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("wx%03d" % rng.randrange(vocabulary) if rng.random() < 0.9 else rng.choice(["Grüße,", "été.", "日本", "A B", "x|y", "don't"]) for _ in range(n))


def texts() -> list[tuple]:
    """(doc_id, text, source): nulls, empty, one word, copies, near copies, a long text, a repeated row, a null id."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one two three", None), (6, "One TWO three", ""), (7, base, "a"), (8, base, "b"), (9, " ".join(near), "a")]
    rows += [(10 + i, words(rng, rng.randrange(1, 90)) + "\nshared line of text here\n" + words(rng, 60), "abc"[i % 3]) for i in range(25)]
    rows += [(60, "\n".join(words(rng, 30) for _ in range(400)), "a"), (61, words(rng, 80), "a"), (61, words(rng, 80), "a"), (62, base, None), (62, base, None), (None, words(rng, 70), "c")]
    return rows


def frame(spark, rows):
    """The rows as documents with further columns whose names the operators use themselves."""
    data = [(i, t, "en", s, None if t is None else len(t), 7, "k", 3, "s", 9, "h", 1) for i, t, s in rows]
    return spark.createDataFrame(data, KIND).repartition(3)
