"""Tables with the awkward rows every operator must take."""

import random

FORM = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, name string, token string, key bigint"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', ',', '.'])}" for _ in range(n))


def awkward(spark):
    """Nulls in any column, empty and word-less texts, a very long text, repeated rows, a null id, clashing extra columns."""
    rng = random.Random(7)
    base = prose(rng, 80)
    long = prose(rng, 30_000)
    texts = [(1, base), (2, base.upper()), (3, base), (3, base), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "One TWO"), (None, base), (None, None), (9, long), (10, long + " tail"), (11, "é ü 漢字 🙂 x"), (12, "a" * 5000)]
    rows = [(i, t, "en" if i and i % 2 else None, None, None, 1, "n", None, 5) for i, t in texts]
    return spark.createDataFrame(rows, FORM).repartition(3)


def empty(spark):
    return spark.createDataFrame([], FORM)


def docs(spark, texts, parts=3):
    rows = [(i, t) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
