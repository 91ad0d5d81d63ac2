"""Operators 1, 2 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from panelforge.llm.block_naming import block_naming_dedup
from panelforge.llm.kit import components
from panelforge.llm.ngram_join import ngram_jaccard_join, prefix_len
from panelforge.llm.suffix_dedup import repeated_passages

from .common import awkward, docs, empty, prose

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(sets)):
        groups[find(a)].append(sets[a][0])
    least = {a: min((i for i in groups[find(a)] if i is not None), default=None) for a in range(len(sets))}
    return Counter((i, len(s), least[a] if s else i) for a, (i, s) in enumerate(sets))


def near_copies(rng, n_groups=12, size=7):
    out = []
    for _ in range(n_groups):
        base = prose(rng, rng.randrange(5, 160)).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            out.append(" ".join(w))
    shared = prose(rng, 70)
    out += [f"{prose(rng, rng.randrange(30, 120))} {shared} {prose(rng, 40)}" for _ in range(30)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    texts = near_copies(random.Random(seed))
    got = Counter(map(tuple, ngram_jaccard_join(docs(spark, texts), slots=1 << 20).collect()))
    assert got == brute_components(list(enumerate(texts)))


def test_join_result_does_not_depend_on_the_sketch(spark):
    texts = near_copies(random.Random(3), 4)
    one = ngram_jaccard_join(docs(spark, texts), slots=1 << 10).orderBy("doc_id").collect()
    assert one == ngram_jaccard_join(docs(spark, texts, 5), slots=1 << 20).orderBy("doc_id").collect()


def test_join_on_awkward_rows(spark):
    table = awkward(spark)
    got = Counter(map(tuple, ngram_jaccard_join(table).collect()))
    assert got == brute_components([(r.doc_id, r.text) for r in table.collect()])
    assert ngram_jaccard_join(empty(spark)).count() == 0


def test_join_links_through_near_copies_with_a_null_id(spark):
    w = prose(random.Random(11), 100, 5000).split()

    def edited(*places):
        return " ".join("other" if i in places else x for i, x in enumerate(w))

    rows = [(1, edited()), (None, edited(20, 50)), (2, edited(20, 50, 70, 90)), (3, prose(random.Random(12), 100, 5000))]
    want = brute_components(rows)
    assert want[2, 96, 1] == 1
    assert Counter(map(tuple, ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())) == want


def test_prefix_length_never_loses_a_partner():
    for m in range(1, 200):
        assert prefix_len(m, 4, 5) == m - -(-8 * m // 10) + 1 >= 1


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys((200, 201, 202), 200)}


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(_LOWER)].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    return out


def test_block_naming_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(40)]
    texts += [t.upper() for t in texts[:15]] + texts[5:20] + ["É" + texts[0], "é" + texts[0], texts[0] + " ", "ab", "abab", "abababab"]
    for block in (2, 16, 4096):
        assert Counter(map(tuple, block_naming_dedup(docs(spark, texts), block=block).collect())) == brute_exact(list(enumerate(texts)))


def test_block_naming_on_awkward_rows(spark):
    table = awkward(spark)
    assert Counter(map(tuple, block_naming_dedup(table).collect())) == brute_exact([(r.doc_id, r.text) for r in table.collect()])
    assert block_naming_dedup(empty(spark)).count() == 0


def covered(texts, size=50):
    """Words of each document that lie in a window another document has too."""
    holders = defaultdict(set)
    split = {i: words(t) for i, t in texts.items()}
    for i, w in split.items():
        for p in range(len(w) - size + 1):
            holders[tuple(w[p:p + size])].add(i)
    out = defaultdict(set)
    for i, w in split.items():
        for p in range(len(w) - size + 1):
            if len(holders[tuple(w[p:p + size])]) > 1:
                out[i].update(range(p, p + size))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_passages_equal_brute_force(spark, parts):
    rng = random.Random(5)
    shared = [prose(rng, n, 5000) for n in (50, 51, 60, 90, 200)]
    texts = {}
    for i in range(120):
        inner = " ".join(rng.sample(shared, rng.randrange(0, 3)))
        texts[i] = f"{prose(rng, rng.randrange(0, 90), 5000)} {inner} {prose(rng, rng.randrange(0, 90), 5000)}"
    texts |= {200: texts[3], 201: texts[3].upper(), 202: " ".join(texts[4].split()[:49]), 203: prose(rng, 300, 5000)}
    got = defaultdict(set)
    for r in repeated_passages(docs(spark, texts, parts)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.partner_id != r.doc_id
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == covered(texts)


def found(table):
    got = defaultdict(set)
    for r in repeated_passages(table).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.partner_id != r.doc_id
        got[r.doc_id].update(range(r.start_word, r.end_word))
    return got


@pytest.mark.parametrize("lead, tail", [(2, 49), (6, 48), (10, 45), (12, 40)])
def test_passages_with_a_common_tail_equal_brute_force(spark, lead, tail):
    rng = random.Random(lead)
    notice = prose(rng, tail, 5000)
    sites = [prose(rng, lead, 5000) for _ in range(40)]
    texts = {i: f"{prose(rng, 60, 5000)} {sites[i % 40]} {notice} {prose(rng, 60, 5000)}" for i in range(200)}
    want = covered(texts)
    assert len(want) == (200 if lead + tail >= 50 else 0) and found(docs(spark, texts)) == want
    # the same with site-specific ends
    texts = {i: f"{prose(rng, 60, 5000)} {notice} {sites[i % 40]} {prose(rng, 60, 5000)}" for i in range(200)}
    assert found(docs(spark, texts)) == covered(texts)


def test_passages_that_one_document_repeats_beyond_a_batch(spark):
    rng = random.Random(3)
    passage = prose(rng, 60, 5000)
    texts = {i: f"{prose(rng, 60, 5000)} {passage} {prose(rng, 60, 5000)}" for i in (1, 9)}
    # one document holds it 12,000 times (a batch has 10,000 rows), each time with other words around
    table = docs(spark, texts | {5: " ".join(f"{passage} x{i}" for i in range(12_000))})
    want = {p for i in range(12_000) for p in range(61 * i, 61 * i + 60)}
    got = found(table)
    assert got[5] == want and got[1] == got[9] == set(range(60, 120))
    # rows with a null id are one document: only their common words with others count
    lone = [(None, f"{passage} y{i}") for i in range(300)]
    assert not found(spark.createDataFrame(lone, "doc_id bigint, text string"))
    assert found(spark.createDataFrame([*lone, (1, texts[1])], "doc_id bigint, text string")) == {None: set(range(60)), 1: set(range(60, 120))}


def test_passages_on_awkward_rows(spark):
    ids = {r.doc_id for r in repeated_passages(awkward(spark)).collect()}
    assert ids == {1, 2, 3, 9, 10, None}
    assert repeated_passages(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        repeated_passages(empty(spark), min_words=20)
