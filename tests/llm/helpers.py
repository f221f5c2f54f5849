"""Small tables with every odd case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, score string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(rng.choice(words) + ("." if rng.random() < 0.12 else ""))
    return " ".join(out)


def docs(spark, texts):
    """texts: (doc_id, text); the other columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), None, 1, "x") for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "One"), (4, "One"), (None, "One"), (None, None), (5, "A b c d e f. " * 5), (6, "Été \U0001f600 fin.\n"), (7, "x" * 300_000), (8, "word " * 60_000)]
