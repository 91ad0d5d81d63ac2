"""The sieve before joins gives the plain join's rows."""

import random
from collections import Counter

import pytest

from panelforge.llm import sieve
from panelforge.llm.kit import Bloom, bloom_of


@pytest.mark.parametrize("words", [1, 1 << 12])
def test_semi_and_anti_equal_plain_joins(spark, monkeypatch, words):
    monkeypatch.setattr(sieve, "LEAST_WORDS", words)
    monkeypatch.setattr(sieve, "MOST_WORDS", max(words, 2))
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(300)]), rng.randrange(3), f"t{k}") for k in range(2000)]
    keys = {(rng.choice([None, *range(300)]), rng.randrange(3)) for _ in range(150)}
    a = spark.createDataFrame(rows, "k bigint, n int, text string").repartition(4)
    b = spark.createDataFrame(sorted(keys, key=str), "k bigint, n int")
    assert Counter(map(tuple, sieve.semi(a, b, ["k", "n"]).collect())) == Counter(r for r in rows if r[:2] in keys)
    assert Counter(map(tuple, sieve.anti(a, b, ["k", "n"]).collect())) == Counter(r for r in rows if r[:2] not in keys)
    assert sieve.anti(a, b.limit(0), ["k", "n"]).count() == len(rows) and sieve.semi(a, b.limit(0), ["k", "n"]).count() == 0


def test_bloom_loses_no_key(spark):
    import numpy as np

    keys = list(range(-500, 5000, 7))
    bloom = bloom_of(spark.createDataFrame([(k,) for k in [*keys, None]], "k bigint").repartition(5), "k", 1 << 16)
    assert bloom.hit(np.array(keys, np.int64).view(np.uint64)).all()
    others = np.arange(10**6, 10**6 + 5000, dtype=np.int64).view(np.uint64)
    assert bloom.hit(others).mean() < 0.05
    assert not Bloom(1 << 10).hit(others).any()
