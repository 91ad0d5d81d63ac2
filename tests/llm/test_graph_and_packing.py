"""Operators 6 and 8 and the pipeline."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from panelforge.llm import linkgraph, queries
from panelforge.llm.packing import best_bounds, pack, token_estimates
from panelforge.llm.pii import find_pii, mask_pii
from panelforge.llm.quality import fit_quality, fold, quality_scores

from .common import awkward, empty
from .test_dedup import brute_components, words

SF = "/root/testdata/sf0.001"


def fits(rule, host, path):
    h, _, p = rule.partition("/")
    return (host == h or host.endswith("." + h)) and path.startswith("/" + p)


def brute_verdicts(pages, damping, rounds=400):
    """pages: (id, host, path, linked hosts)."""
    judged = []
    for i, host, path, links in pages:
        rules = sorted((r for r in linkgraph.RULES if fits(r[1], host, path)), key=lambda r: -len(r[1]))
        judged.append((i, host, path, rules[0] if rules else None, links))
    n, good, bad = Counter(), Counter(), Counter()
    edges = Counter()
    for _, host, _, rule, links in judged:
        n[host] += 1
        good[host] += bool(rule and rule[0] == "allow")
        bad[host] += bool(rule and rule[0] == "block")
        for x in links:
            if host and x != host:
                edges[host, x] += 1
    for host in list(n):
        if host:
            above = [x for k in range(1, host.count(".") + 1) if (x := host.split(".", k)[k]) in n]
            if above:
                edges[host, above[0]] += 1
    score = defaultdict(float)
    for sign, seeds, graph in ((1, good, edges), (-1, bad, Counter({(b, a): w for (a, b), w in edges.items()}))):
        start = {h: float(n[h]) for h in n if h and seeds[h] >= n[h] * 0.5}
        out = Counter()
        for (a, _), w in graph.items():
            out[a] += w
        rank, walk = defaultdict(float), dict(start)
        for _ in range(rounds):
            for h, m in walk.items():
                rank[h] += m
            step = defaultdict(float)
            for (a, b), w in graph.items():
                if a in walk:
                    step[b] += damping * walk[a] * w / out[a]
            walk = step
        whole = sum(rank.values())
        for h, m in rank.items():
            score[h] += sign * m / whole
    return {i: (host, path, rule[1] if rule else None, rule[0] if rule else ("block" if score[host] < -1e-12 else "allow")) for i, host, path, rule, _ in judged}


def test_link_graph_equals_brute_force(spark):
    rng = random.Random(1)
    hosts = [f"h{i}.example.{rng.choice(['com', 'org', 'net'])}" for i in range(25)] + ["plain.io", "other.io", "www.h1.example.com", "a.b.plain.io", "b.plain.io", "org.plain.io"]
    pages, rows = [], []
    for i in range(300):
        host, path = rng.choice(hosts), rng.choice(["", "/", "/en/1", "/de/2", "/fr/3"])
        links = rng.choices(hosts, k=rng.randrange(0, 4))
        html = " ".join(f'<a class=x href="HTTPS://{x.upper()}/p?q=1">t</a>' for x in links) + '<a href="/inside">'
        rows.append((i, f"https://{host.upper()}{path}?x=//no#f", html))
        pages.append((i, host, path, links))
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: tuple(r)[1:] for r in linkgraph.link_filter(table, damping=0.6).collect()}
    want = brute_verdicts(pages, 0.6)
    assert got == want and {v[3] for v in want.values() if v[2] is None} == {"allow", "block"}


def test_propagation_goes_round_a_long_cycle(spark):
    """A ring of hosts, one blocked seed: every host is reached, and the mass left is as small as stated."""
    hosts = [f"c{k}.example.com" if k else "c0.example.net" for k in range(30)]
    rows = [(k, f"http://{h}/", f'<a href="http://{hosts[(k + 1) % 30]}/">') for k, h in enumerate(hosts)]
    table = spark.createDataFrame([*rows, (99, f"http://{hosts[5]}/x", None)], "page_id bigint, url string, html string")
    assert {r.verdict for r in linkgraph.link_filter(table, damping=0.5, margin=1e-12).collect()} == {"block"}
    edges = spark.createDataFrame([("x", h, hosts[(k + 1) % 30], 1.0) for k, h in enumerate(hosts)], "kind string, src string, dst string, w double")
    ranks, left = linkgraph.propagate(edges, spark.createDataFrame([("x", hosts[0], 7.0)], "kind string, host string, s double"), damping=0.5)
    got = {r.host: r["rank"] for r in ranks.collect()}
    assert left <= 1e-10 and all(abs(got[h] - 0.5**k / 2 / (1 - 0.5**30)) < 1e-9 for k, h in enumerate(hosts))


def test_link_graph_on_awkward_rows(spark):
    rows = [(1, None, None), (2, "no scheme", "x"), (None, "http://A.net", ""), (3, "x://", None), (3, "x://", None), (4, "http://a.com", '<a href="//b.net/x">'), (5, "http://É.ORG/fr/é\n?", "<a href=")]
    table = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id bigint, url string, html string, host string, rule int")
    got = sorted((tuple(r) for r in linkgraph.link_filter(table).collect()), key=str)
    assert (1, "", "", None, "allow") in got and (2, "", "", None, "allow") in got and got.count((3, "", "", None, "allow")) == 2
    assert (None, "a.net", "", None, "allow") in got and (5, "É.org", "/fr/é\n", "org/fr/", "allow") in got
    assert linkgraph.link_filter(table.limit(0)).count() == 0


def tokens_of(text):
    return sum(-(-len(w.encode()) // 2) for w in words(text))


def brute_bounds(lengths, buckets):
    values = sorted(set(lengths))
    best = None
    for k in range(1, buckets + 1):
        for cut in itertools.combinations(values[:-1], min(k, len(values)) - 1):
            bounds = [*cut, values[-1]]
            waste = sum(next(b for b in bounds if b >= x) - x for x in lengths)
            best = waste if best is None else min(best, waste)
    return best


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randrange(0, 30) for _ in range(rng.randrange(1, 25))]
        values = sorted(set(lengths))
        n = Counter(lengths)
        bounds, waste = best_bounds(values, [n[v] for v in values], 3)
        assert waste == brute_bounds(lengths, 3) == sum(next(b for b in bounds if b >= x) - x for x in lengths)
        assert len(bounds) <= 3 and bounds == sorted(bounds) and bounds[-1] == values[-1]


def test_bounds_of_many_long_lengths_are_optimal():
    """Against the plain program that tries every cut, on lengths up to a million."""
    rng = np.random.default_rng(8)
    values = np.unique((10 ** rng.uniform(0, 6, 300)).astype(int)).tolist()
    n = rng.integers(1, 50, len(values)).tolist()
    best = {(0, 0): 0}
    cost = lambda i, j: sum(n[k] * (values[j - 1] - values[k]) for k in range(i, j))
    table = [[cost(i, j) if i < j else 0 for j in range(len(values) + 1)] for i in range(len(values))]
    for k in range(1, 7):
        for j in range(1, len(values) + 1):
            best[k, j] = min(best.get((k - 1, i), np.inf) + table[i][j] for i in range(j))
    bounds, waste = best_bounds(values, n, 6)
    assert waste == min(best[k, len(values)] for k in range(1, 7)) == sum(c * (next(b for b in bounds if b >= v) - v) for v, c in zip(values, n, strict=True))


@pytest.mark.parametrize("slice_rows", [7, 50_000])
def test_batches_keep_budget_and_every_row(spark, slice_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice([3, 3, 3, rng.randrange(0, 400), rng.randrange(0, 5000)])) for i in range(500)] + [(7, 3), (7, 3), (None, 9), (1000, None), (1001, 10**6)]
    out = pack(spark.createDataFrame(rows, "doc_id bigint, length bigint").repartition(4), budget=2000, buckets=5, slice_rows=slice_rows).collect()
    assert Counter((r.doc_id, r.length) for r in out) == Counter((i, x or 0) for i, x in rows)
    batches = defaultdict(list)
    for r in out:
        assert r.length <= r.bucket_len and r.padding == r.bucket_len - r.length
        batches[r.batch_id].append(r)
    for rs in batches.values():
        assert len({r.bucket for r in rs}) == 1 and sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or len(rs) * rs[0].bucket_len <= 2000
    for b in {r.bucket for r in out}:
        sizes = sorted(len(rs) for rs in batches.values() if rs[0].bucket == b)
        assert len(set(sizes[1:])) <= 1
    assert sorted(batches) == list(range(len(batches)))


def test_packing_on_awkward_rows(spark):
    table = awkward(spark)
    got = pack(token_estimates(table)).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((r.doc_id, tokens_of(r.text)) for r in table.collect())
    assert pack(token_estimates(empty(spark))).count() == 0


def test_every_stage_of_the_pipeline(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "PII", "packing"]
    rows = {r.doc_id: r for r in table.collect()}
    good = stages["quality classifier"](spark, table, SF)
    scores = {r.doc_id: r.predicted for r in quality_scores(table, fit_quality(table, labels, train=fold("doc_id", 3) != 1)).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i in rows if scores[i]}

    unique = stages["exact dedup"](spark, good, SF)
    last = {}
    for i in sorted(r.doc_id for r in good.collect()):
        last["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rows[i].text or "")] = i
    assert {r.doc_id for r in unique.collect()} == set(last.values())

    alone = stages["n-gram Jaccard join"](spark, unique, SF)
    want = brute_components([(r.doc_id, r.text) for r in unique.collect()])
    assert {r.doc_id for r in alone.collect()} == {i for i, _, c in want if i == c}

    masked = stages["PII"](spark, alone, SF)
    assert {r.doc_id: (r.text, r.n_chars) for r in masked.collect()} == {r.doc_id: (t := mask_pii(r.text, find_pii(r.text)), len(t)) for r in alone.collect()}
    for step in (good, unique, alone, masked):
        assert step.columns == table.columns
    assert {r.doc_id: r.length for r in stages["packing"](spark, masked, SF).collect()} == {r.doc_id: tokens_of(r.text) for r in masked.collect()}
    whole = queries.queries()["pipeline"](spark, SF)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in masked.collect()}


def test_pipeline_on_awkward_rows(spark):
    for make in (awkward, empty):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == make(spark).columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


CLASHES = ("text_hash", "_sha", "_id", "_gone", "h", "row", "n", "len", "norm", "cls", "go", "component_id", "length", "score", "kept", "doc_id_key", "masked", "i")


def test_stages_decide_rows_whatever_their_other_columns(spark):
    """Extra columns named as the stages' own, repeated rows and ids, null ids and texts: which rows stay, by value."""
    base, other = "one two three four five six seven eight nine ten", "eleven twelve thirteen fourteen fifteen"
    rows = [(1, base), (2, base.upper()), (2, base.upper()), (2, other), (3, None), (4, ""), (None, base), (None, "alone"), (5, base + " eleven")]
    form = "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    table = spark.createDataFrame([(*r, *([f"v{k}"] * len(CLASHES))) for k, r in enumerate(rows)], form)
    stages = dict(corpus_pipeline.STAGES)
    unique = stages["exact dedup"](spark, table, SF)
    assert unique.columns == table.columns
    assert sorted(((r.doc_id, r.text, r["_sha"]) for r in unique.collect()), key=str) == sorted([(2, base.upper(), "v1"), (2, other, "v3"), (4, "", "v5"), (None, "alone", "v7"), (5, base + " eleven", "v8")], key=str)
    alone = stages["n-gram Jaccard join"](spark, unique, SF)
    # 5 is linked with one text of id 2 only, so the least id of the group, 2, stays and 5 goes
    assert alone.columns == table.columns and sorted((r.doc_id or 0, r.text) for r in alone.collect()) == sorted([(2, base.upper()), (2, other), (4, ""), (0, "alone")])
    masked = stages["PII"](spark, alone, SF)
    assert masked.columns == table.columns and masked.count() == 4
    assert stages["quality classifier"](spark, table, SF).columns == table.columns
    assert stages["packing"](spark, masked, SF).count() == 4
