"""Forms of the clusterings for larger graphs, against the plain ones."""

import numpy as np
import pytest

from panelforge.operators import communities


def _ring_of_blobs(parts, size, bridges, seed=0):
    rng, edges = np.random.default_rng(seed), {}
    for p in range(parts):
        for i in range(size):
            for j in rng.choice(size, 6, replace=False):
                if i != j:
                    edges[min(p * size + i, p * size + int(j)), max(p * size + i, p * size + int(j))] = float(rng.uniform(0.5, 1))
    for p in range(bridges):
        edges[p * size, (p + 1) % parts * size + 1] = 0.3 + 0.1 * p
    return [(0, min(a, b), max(a, b), w) for (a, b), w in edges.items()]


@pytest.mark.parametrize("bridges", [4, 3, 2, 0])
def test_leading_vectors_span_those_of_the_full_matrix(bridges):
    import pandas as pd

    t = pd.DataFrame(_ring_of_blobs(4, 40, bridges), columns=["g", "src", "dst", "weight"])
    names, g = communities._graph(t)
    a = np.zeros((len(g), len(g)))
    for i, row in enumerate(g):
        for j, w in row.items():
            a[i, j] = w
    s = 1 / np.sqrt(a.sum(axis=1))
    value, vec = np.linalg.eigh(s[:, None] * a * s[None, :])
    x = communities._leading(g, s, 4)
    assert np.allclose(x.T @ x, np.eye(4), atol=1e-9)
    assert value[-5] < value[-4] - 1e-3 and np.allclose(x @ x.T, vec[:, -4:] @ vec[:, -4:].T, atol=1e-7)


def test_spectral_without_a_full_matrix_gives_the_same_classes(spark):
    edges = spark.createDataFrame(_ring_of_blobs(4, 40, 4), "g int, src bigint, dst bigint, weight double")
    plain, sparse = ({r.i: r.label for r in communities.spectral(edges, 4, dense=d).collect()} for d in (2_000, 0))
    assert plain == sparse and len(set(plain.values())) == 4


def _ward_plainly(x, k):
    """Labels by merging the cheapest pair of all, again and again."""
    member, classes = list(range(len(x))), {i: (1, x[i]) for i in range(len(x))}
    while len(classes) > k:
        ids = sorted(classes)
        cost = {(a, b): classes[a][0] * classes[b][0] / (classes[a][0] + classes[b][0]) * float(((classes[a][1] - classes[b][1]) ** 2).sum()) for a in ids for b in ids if a < b}
        a, b = min(cost, key=lambda p: (cost[p], p))
        (m, u), (n, v) = classes[a], classes.pop(b)
        classes[a] = (m + n, (m * u + n * v) / (m + n))
        member = [a if c == b else c for c in member]
    return member


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_ward_equals_merging_the_cheapest_pair(spark, shift):
    # far from the origin products lose the distances
    x = np.random.default_rng(5).normal(size=(60, 3)).round(3) + shift
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, i bigint, vec array<double>")
    got = {r.i: r.label for r in communities.ward(df, 6).collect()}
    want = _ward_plainly(x - shift, 6)
    assert len({(got[i], want[i]) for i in range(60)}) == 6


def _greedy_plainly(g):
    """Classes by merging the pair of largest gain, all gains computed anew each time; and the order of merges."""
    two_m = sum(sum(r.values()) for r in g)
    name = list(range(len(g)))
    while True:
        ids = sorted(set(name))
        k = {c: sum(sum(g[i].values()) for i in range(len(g)) if name[i] == c) for c in ids}
        w = {}
        for i, r in enumerate(g):
            for j, x in r.items():
                if name[i] < name[j]:
                    w[name[i], name[j]] = w.get((name[i], name[j]), 0.0) + x
        gain = {p: x / two_m - k[p[0]] * k[p[1]] / two_m**2 for p, x in w.items()}
        a, b = min(gain, key=lambda p: (-gain[p], p), default=(0, 0))
        if a == b or gain[a, b] <= 1e-15:
            return name
        name = [a if c == b else c for c in name]


def test_greedy_equals_valuing_every_pair_anew():
    import pandas as pd

    t = pd.DataFrame(_ring_of_blobs(4, 12, 4, seed=2), columns=["g", "src", "dst", "weight"])
    _, g = communities._graph(t)
    assert communities.greedy_modularity(g) == _greedy_plainly(g)


def test_greedy_values_few_pairs_again(monkeypatch):
    # chains hung on a hub: every merge with the hub used to bring a new entry for each of its links
    import heapq

    pushed, push = [0], heapq.heappush
    monkeypatch.setattr(heapq, "heappush", lambda h, x: (pushed.__setitem__(0, pushed[0] + 1), push(h, x))[1])
    n = 400
    g = [{} for _ in range(3 * n + 1)]
    for i in range(n):
        for a, b, w in ((0, 3 * i + 1, 5.0 + i / n), (3 * i + 1, 3 * i + 2, 0.1), (3 * i + 2, 3 * i + 3, 9.0)):
            g[a][b] = g[b][a] = w
    communities.greedy_modularity(g)
    assert pushed[0] < 20 * n


def test_perturbed_graphs_are_left_to_spread_louvain(spark, monkeypatch):
    # beyond a million edges it moves nodes in joint rounds; each graph was one task's, whatever its size
    from panelforge.plans import catalog_inference

    whole, calls = catalog_inference.spread_louvain, []
    monkeypatch.setattr(catalog_inference, "spread_louvain", lambda *a, **k: calls.append(a[0].columns) or whole(*a, **k))
    rows = catalog_inference.perturbation_runs(spark, "/root/testdata/sf0.001").collect()
    assert calls == [["g", "src", "dst", "weight"]] and sorted(r.seed for r in rows) == [1, 2, 3, 4, 5]


def test_a_joint_round_writes_two_tables(spark, monkeypatch):
    # it wrote three: links' sums for each class are now handed on to the choice without a table between
    from panelforge.operators import spread

    edges = spark.createDataFrame(_ring_of_blobs(4, 12, 4), "g int, src bigint, dst bigint, weight double")
    write, written = spread.stash, []
    monkeypatch.setattr(spread, "stash", lambda df: (written.append(1), write(df))[1])
    counts = []
    for rounds in (1, 2):
        written.clear()
        spread._moves(edges, 1.0, rounds, 0.0)
        counts.append(len(written))
    assert counts[1] - counts[0] == 2


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_rounds_in_one_task_are_those_over_the_cluster(spark, kind, monkeypatch):
    from panelforge.operators import spread

    draw = np.random.default_rng(3)
    rows = [(g, int(a), int(b), float(w)) for g in (1, 2) for a, b, w in zip(draw.integers(0, 300, 1500), draw.integers(0, 300, 1500), draw.uniform(0.1, 1, 1500), strict=True) if a // 20 == b // 20 or draw.random() < 0.15]
    edges = spark.createDataFrame(rows, "g int, src bigint, dst bigint, weight double").selectExpr("g", f"cast(src as {kind}) as src", f"cast(dst as {kind}) as dst", "weight").cache()
    labels = lambda **k: {(r.g, r.i): r.label for r in spread.spread_louvain(edges, few=100, **k).collect()}
    joined = labels(held=0)
    monkeypatch.setattr(spread, "_moves", None)  # no round is a join of its own any more
    assert labels() == joined and len(set(joined.values())) > 3
    assert labels(rounds=1) != joined


def _ward_by_hand(x, k):
    """All pairs of classes measured for every merge; labels by size, then least point."""
    parts = [[i] for i in range(len(x))]
    while len(parts) > k:
        best = min((len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum(), p, q) for p, a in enumerate(parts) for q, b in enumerate(parts[:p]))
        parts[best[2]] += parts.pop(best[1])
    return {i: n for n, p in enumerate(sorted(parts, key=lambda p: (-len(p), min(p))), 1) for i in p}


@pytest.mark.parametrize("shape", ["cloud", "copies", "far"])
def test_ward_merges_all_mutually_nearest_classes(spark, shape):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(90, 6)) * draw.uniform(0.1, 9, (90, 1))
    x = {"cloud": x, "copies": np.vstack((x[:40], x[:40], x[:10])), "far": x + 1e5}[shape]
    points = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, i bigint, vec array<double>")
    for k in (1, 5, 20):
        assert {r.i: r.label for r in communities.ward(points, k).collect()} == _ward_by_hand(x, k)


def test_ward_merges_form_one_tree():
    merges = communities._ward_merges(np.random.default_rng(6).normal(size=(4000, 16)))
    assert len(merges) == 3999 and len({b for _, _, b in merges}) == 3999 and all(a < b for _, a, b in merges)


def test_benchmark_writes_all_methods_in_one_job(spark, monkeypatch):
    from panelforge.operators import validity
    from panelforge.plans import bindings, catalog_inference

    d, whole, calls = "/root/testdata/sf0.001", catalog_inference.stash, []
    monkeypatch.setattr(catalog_inference, "stash", lambda df: calls.append(df.columns) or whole(df))
    got = {r.method: (r.modularity, r.silhouette) for r in catalog_inference.method_benchmark(spark, d).collect()}
    assert calls[1:] == [["g", "i", "label"]] and set(got) == {"louvain", "leiden", "greedy", "spectral", "ward"}
    edges, pts = catalog_inference._edges_e(spark, d), bindings.points_e(spark, d)
    for name, labels in (("leiden", communities.detect(edges, "leiden")), ("ward", communities.ward(pts, 8))):
        q, s = validity.modularity(edges, labels).first().modularity, validity.silhouette(pts.drop("label").join(labels, ["g", "i"])).first().silhouette
        assert got[name] == pytest.approx((q, s), abs=1e-9)
