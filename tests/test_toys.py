"""Small inputs with results worked out by hand."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import columns as C
from panelforge.operators import alignment, communities, consensus, graphs, inference, ml, panel, partitions, relational, spread, synthetic, validity, windows
from panelforge.operators.pairs import group_sums, knn, median_pair_distance, order_statistics


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def points(spark, xs, labels=None):
    rows = [(0, i, [float(v) for v in (x if isinstance(x, (list, tuple)) else [x])], labels[i] if labels else 0) for i, x in enumerate(xs)]
    return frame(spark, rows, "g int, i bigint, vec array<double>, label bigint")


def edge_table(spark, rows):
    return frame(spark, [(0, a, b, float(w), 0.0, False) for a, b, w in rows], "g int, src bigint, dst bigint, weight double, distance double, fallback boolean")


def strict(spark, rows, periods):
    return panel.strict_panel(frame(spark, rows, "unit string, t int, category string, value double"), categories=["total", "food"], periods=periods)


def test_strict_panel(spark):
    rows = [("x", t, c, 1.0) for t in range(24) for c in ("total", "food")]
    assert [r.unit for r in strict(spark, rows, list(range(24))).units.collect()] == ["x"]
    assert strict(spark, [*rows[:-1], ("y", 23, "food", 1.0)], list(range(24))).units.count() == 0
    with pytest.raises(ValueError):
        strict(spark, rows, list(range(1, 25)))
    twice = strict(spark, [*rows, ("x", 3, "other", 1.0), ("x", 3, "other", 1.0)], list(range(24)))
    assert twice.units.count() == 0 and twice.audit.first().ambiguous == 1


def test_numbered_is_the_place_in_the_sorted_list(spark):
    names = [f"u{k:03d}" for k in random.Random(1).sample(range(500), 200)]
    got = {r.k: r.idx for r in panel.numbered(frame(spark, [(n,) for n in names], "k string").repartition(5), "k").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_clr_and_robust_z(spark):
    x = frame(spark, [("a", 0, c, v) for c, v in zip("pqr", (0.2, 0.3, 0.5), strict=True)], "unit string, t int, category string, value double")
    assert sum(r.clr for r in panel.clr_parts(x).collect()) == pytest.approx(0)
    with pytest.raises(Exception, match="positive"):
        panel.clr_parts(x.withColumn("value", F.lit(0.0))).collect()
    z = panel.robust_z(frame(spark, [(float(v),) for v in range(1, 6)], "x double"), "x").collect()
    assert sorted(r.z for r in z)[2] == 0
    with pytest.raises(Exception, match="zero MAD"):
        panel.robust_z(frame(spark, [(1.0,), (1.0,)], "x double"), "x").collect()


def test_neighbours_on_a_line(spark):
    near = knn(points(spark, [0, 1.1, 2.0, 10.0]), 1, group="g", key="i", vec="vec")
    union = {(r.src, r.dst) for r in graphs.knn_graph(near, mutual=False).collect()}
    mutual = {(r.src, r.dst) for r in graphs.knn_graph(near).collect()}
    assert {(0, 1), (2, 3)} <= union and mutual and mutual < union
    whole = {v for r in graphs.knn_graph(near, fallback=True).collect() for v in (r.src, r.dst)}
    assert whole == {0, 1, 2, 3}


def test_epsilon_graph_takes_ties(spark):
    pts = points(spark, [0, 1, 2, 20])
    edges, row = graphs.epsilon_graph(pts, knn(pts, 1, group="g", key="i", vec="vec"), 1, key="i", vec="vec")
    assert {(r.src, r.dst) for r in edges.collect()} == {(0, 1), (1, 2)}
    r = row.first()
    assert (r.eps, r.edges, r.excess, r.isolates) == (1.0, 2, 1, 1)


@pytest.mark.parametrize("block", [3, 1000])
def test_blocked_pairs_equal_numpy(spark, block, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(23, 4))
    pts = points(spark, x.tolist(), [k % 3 for k in range(23)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r.i, r["rank"]): (r.j, r.d) for r in knn(pts, 4, group="g", key="i", vec="vec", block=block).collect()}
    for i in range(23):
        order = sorted((d[i, j], j) for j in range(23) if j != i)[:4]
        assert [got[i, k + 1][0] for k in range(4)] == [j for _, j in order]
    flat = np.sort(d[np.triu_indices(23, 1)])
    ranks = frame(spark, [(0, k) for k in (1, 7, 126, 253)], "g int, rank bigint")
    for few in (1, 10**6):
        assert {r["rank"]: r.distance for r in order_statistics(pts, ranks, group="g", key="i", vec="vec", few=few).collect()} == {k: flat[k - 1] for k in (1, 7, 126, 253)}
    assert median_pair_distance(pts, "g", "i", "vec").first().distance == pytest.approx(np.median(flat))
    for r in group_sums(pts, "label", group="g", key="i", vec="vec").collect():
        a, b = np.arange(23) % 3 == r.gi, np.arange(23) % 3 == r.gj
        assert r.s == pytest.approx(d[np.ix_(a, b)].sum()) and r.n == a.sum() * b.sum() - (a.sum() if r.gi == r.gj else 0)


def test_block_indices(spark):
    edges = edge_table(spark, [(0, 1, 4), (2, 3, 2), (1, 2, 1)])
    labels = frame(spark, [(0, 0, 10), (0, 1, 10), (0, 2, 20), (0, 3, 20)], "g int, i bigint, label bigint")
    s = {(r.ci, r.cj): r.s for r in graphs.block_matrix(edges, labels).collect()}
    assert s == {(10, 10): 8, (10, 20): 1, (20, 10): 1, (20, 20): 4}
    r = validity.block_indices(graphs.block_matrix(edges, labels)).first()
    avi = (8 / 9 + 4 / 5) / 2
    assert (r.avi, r.avu) == (pytest.approx(avi), pytest.approx(1)) and r.anui == pytest.approx(1 / (1 + 1 / avi))
    three = edge_table(spark, [(0, 1, 1), (2, 3, 1), (4, 5, 1)])
    six = frame(spark, [(0, k, k // 2) for k in range(6)], "g int, i bigint, label bigint")
    assert validity.block_indices(graphs.block_matrix(three, six)).first().turbo_mq == 3
    more = edge_table(spark, [(0, 1, 1), (2, 3, 1), (4, 5, 1), (1, 2, 0.5), (3, 4, 0.5)])
    assert validity.block_indices(graphs.block_matrix(more, six)).first().turbo_mq < 3


def test_s_dbw_zero_rules(spark):
    form = {"spread": "var", "radius": "root"}
    zero = points(spark, [-1, 1, 9, 11], [0, 0, 1, 1])
    strict_ = validity.s_dbw(zero, **form, zero="undefined").first()
    assert strict_.s_dbw is None and strict_.zero_pairs == 1
    assert validity.s_dbw(zero, **form).first().s_dbw == pytest.approx(1 / 26)
    some = points(spark, [-2, 2, 1, 5], [0, 0, 1, 1])
    r = validity.s_dbw(some, **form).first()
    assert r.s_dbw is None and r.undefined_pairs == 1 and r.zero_pairs == 0


def test_one_cluster_is_undefined(spark):
    one = points(spark, [0, 1, 2], [1, 1, 1])
    assert validity.calinski_harabasz(one).first().calinski_harabasz is None
    assert validity.silhouette(one).count() == 0


def test_pair_agreement_equals_counting(spark):
    a, b = [0, 0, 0, 1, 1, 2, 2, 2], [4, 4, 5, 5, 5, 6, 4, 6]
    cont = partitions.contingency(frame(spark, [(0, x, y) for x, y in zip(a, b, strict=True)], "g int, ref bigint, cand bigint"))
    pairs = list(itertools.combinations(range(8), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    r = partitions.pair_agreement(cont).first()
    assert (r.both_pairs, r.retention, r.precision) == (both, both / sum(a[i] == a[j] for i, j in pairs), both / sum(b[i] == b[j] for i, j in pairs))


def test_coarsening(spark):
    cont = partitions.contingency(frame(spark, [(0, k // 2, 7 + (k > 3)) for k in range(6)], "g int, ref bigint, cand bigint"))
    r = partitions.structural_metrics(cont).first()
    assert r.micro_purity == 1 and r.retention == 1 and r.precision < 1 and r.h_cand_given_ref == pytest.approx(0)
    one = partitions.profile_diagnostics(partitions.contingency(frame(spark, [(0, k // 2, 9) for k in range(4)], "g int, ref bigint, cand bigint"))).first()
    assert (one.retention, one.precision, one.jaccard, one.within_pairs) == (1, 0.5, 0.5, 1)


def test_identical_partitions_score_one(spark):
    for rows in ([(0, k % 3, k % 3 + 5) for k in range(9)], [(0, 1, 1)] * 4, [(0, k, k) for k in range(4)]):
        r = partitions.similarity(partitions.contingency(frame(spark, rows, "g int, ref bigint, cand bigint"))).first()
        assert (r.ari, r.nmi) == (pytest.approx(1), pytest.approx(1))


def test_family_balance(spark):
    runs = [(0, 0, i, 1) for i in range(3)] + [(f, f, i, i) for f in (1, 2, 3) for i in range(3)]
    runs = frame(spark, runs, "run int, family int, i bigint, label bigint")
    pairs = consensus.coassignment(runs, frame(spark, [(i,) for i in range(3)], "i bigint"))
    assert {r.p for r in consensus.balanced_consensus(pairs, 4).collect()} == {0.25}


def test_affinities_leave_the_unit_out(spark):
    runs = frame(spark, [(0, 0, i, i // 2) for i in range(4)], "run int, family int, i bigint, label bigint")
    members = frame(spark, [(0, 1), (1, 1), (2, 2), (3, 2)], "i bigint, cls bigint")
    got = {(r.i, r.cls): r.affinity for r in consensus.family_affinities(runs, members).collect()}
    assert got == {(0, 1): 1, (1, 1): 1, (2, 2): 1, (3, 2): 1, (0, 2): 0, (1, 2): 0, (2, 1): 0, (3, 1): 0}
    m = consensus.membership(consensus.affinities(consensus.family_affinities(runs, members))).first()
    assert m.entropy == pytest.approx(0) and m.status == "resolved"
    none = frame(spark, [(9, 1, 0.0, None), (9, 2, 0.0, None)], "i bigint, cls bigint, affinity double, share double")
    assert consensus.membership(none).first().status == "unresolved"


def test_votes_to_directions(spark):
    x = frame(spark, [(k, k, 4 - k) for k in range(5)], "i int, r int, l int")
    got = [r.d for r in x.select("i", C.transition_direction(F.col("l"), F.col("r"), "F", "D").alias("d")).orderBy("i").collect()]
    assert got == ["D->F", "D->F", "F-D-middle", "F->D", "F->D"]


def test_canonical_relabel(spark):
    x = frame(spark, [(0, v) for v in (9, 9, 4, 4, 4)], "g int, label bigint")
    assert {r.label: r.new for r in partitions.canonical_relabel(x).collect()} == {4: 1, 9: 2}


def test_corrections(spark):
    x = frame(spark, [("f", k, p) for k, p in enumerate((0.04, 0.01, 0.03))], "f string, k int, p double")
    assert [r.q for r in windows.holm(x, "p", ["f"], "k").orderBy("k").collect()] == pytest.approx([0.06, 0.03, 0.06])
    assert [r.q for r in windows.benjamini_hochberg(x, "p", ["f"], "k").orderBy("k").collect()] == pytest.approx([0.04, 0.03, 0.04])


def test_greedy_pairs(spark):
    got = alignment.greedy_pairs(points(spark, [0, 0.1, 1, 1.2]), 0.5).collect()
    assert {(r.i, r.j) for r in got} == {(0, 1), (2, 3)} and all(r.mutual for r in got)
    rng = random.Random(5)
    xs = [rng.random() * 4 for _ in range(40)]
    near = {i: min((abs(xs[i] - xs[j]), j) for j in range(40) if j != i)[1] for i in range(40)}
    order = sorted((not (near[i] == j and near[j] == i), abs(xs[i] - xs[j]), i, j) for i, j in itertools.combinations(range(40), 2) if abs(xs[i] - xs[j]) <= 0.2)
    used, want = set(), set()
    for _, _, i, j in order:
        if not {i, j} & used:
            used |= {i, j}
            want.add((i, j))
    assert {(r.i, r.j) for r in alignment.greedy_pairs(points(spark, xs), 0.2).collect()} == want


def test_assignment_equals_enumeration():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 6)):
        for _ in range(20):
            gain = rng.integers(0, 6, (n, m)).astype(float)
            best = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            got = alignment.assignment(gain)
            assert len(set(got.tolist())) == n and gain[np.arange(n), got].sum() == best


def test_label_alignment(spark):
    cont = partitions.contingency(frame(spark, [(0, a, b) for a, b in zip((0, 0, 1, 1, 2), (9, 9, 4, 4, 8), strict=True)], "g int, ref bigint, cand bigint"))
    m = alignment.align_labels(cont)
    assert {r.cand: r.aligned for r in m.collect()} == {9: 0, 4: 1, 8: 2}
    with pytest.raises(Exception, match="without a match"):
        alignment.apply_alignment(frame(spark, [(77,)], "label bigint"), m).collect()


def test_geography_and_names(spark):
    one = spark.range(1)
    km = one.select(C.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("km")).first().km
    assert km == pytest.approx(111.195, abs=0.01)
    assert one.select(C.normal_name(F.lit("  Ёлкинский—район ")).alias("n")).first().n == "елкинский район"


def test_snapshot(spark):
    rows = [(1, 2018, 2024), (1, 2024, 9999), (2, 2018, 2020)]
    x = frame(spark, rows, "id bigint, year_from int, year_to int")
    assert [tuple(r) for r in panel.snapshot(x, 2024, "id").collect()] == [(1, 2024, 9999)]
    with pytest.raises(Exception, match="not unique"):
        panel.snapshot(frame(spark, [(1, 2018, 2030), (1, 2020, 2030)], "id bigint, year_from int, year_to int"), 2024, "id").collect()


def test_cardinality_checks(spark):
    a, b = frame(spark, [(1, 1), (1, 2)], "k int, x int"), frame(spark, [(1, 5)], "k int, y int")
    assert relational.checked_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(Exception, match="not unique"):
        relational.checked_join(a, b, ["k"]).collect()


def test_exact_stratified_null_equals_enumeration(spark):
    x, strata = [0, 1, 3, 10, 12], [0, 0, 0, 1, 1]
    sums = group_sums(points(spark, x, strata), "label", group="g", key="i", vec="vec")
    sizes = frame(spark, [(0, 3, 2), (1, 2, 1)], "label bigint, n bigint, m bigint")
    draws = [a + (b,) for a in itertools.combinations((0, 1, 2), 2) for b in (3, 4)]
    want = np.mean([np.mean([abs(x[i] - x[j]) for i, j in itertools.combinations(s, 2)]) for s in draws])
    assert inference.stratified_null(sums, sizes).first().expected == pytest.approx(want)


def test_perturbation_ignores_order_and_spares_temporal_edges(spark):
    rows = [(0, i, 0, j, (i + j + 1) / 100, "intra") for i, j in itertools.combinations(range(20), 2)] + [(0, i, 1, i, 1.031, "temporal") for i in range(30)]
    x = frame(spark, rows, "t int, src bigint, t2 int, dst bigint, weight double, kind string")
    a = sorted(map(tuple, graphs.perturb(x, 1).collect()))
    assert a == sorted(map(tuple, graphs.perturb(x.orderBy(F.desc("weight")).repartition(7), 1).collect()))
    assert [r for r in a if r[5] == "temporal"] == sorted(r for r in rows if r[5] == "temporal") and len(a) < len(rows)


def test_hash_draws_look_uniform_and_normal(spark):
    x = spark.range(20000).select(C.hash_uniform(3, F.col("id")).alias("u"), C.hash_normal(3, F.col("id")).alias("z")).agg(F.avg("u").alias("u"), F.stddev("u").alias("su"), F.avg("z").alias("z"), F.stddev("z").alias("sz")).first()
    assert x.u == pytest.approx(0.5, abs=0.01) and x.su == pytest.approx(1 / math.sqrt(12), abs=0.01)
    assert x.z == pytest.approx(0, abs=0.03) and x.sz == pytest.approx(1, abs=0.03)


def modularity(rows, label):
    m2 = 2 * sum(w for _, _, w in rows)
    k, inner = {}, {}
    for a, b, w in rows:
        for v in (a, b):
            k[label[v]] = k.get(label[v], 0) + w
        if label[a] == label[b]:
            inner[label[a]] = inner.get(label[a], 0) + 2 * w
    return sum(inner.get(c, 0) / m2 - (k[c] / m2) ** 2 for c in k)


@pytest.mark.parametrize("method", ["louvain", "leiden", "greedy"])
def test_communities_find_planted_groups(spark, method):
    rng = random.Random(4)
    rows = [(a, b, 1.0) for a, b in itertools.combinations(range(60), 2) if rng.random() < (0.6 if a // 15 == b // 15 else 0.02)]
    label = {r.i: r.label for r in communities.detect(edge_table(spark, rows).repartition(4), method).collect()}
    planted = modularity(rows, {v: v // 15 for v in range(60)})
    if method == "greedy":
        assert modularity(rows, label) >= 0.95 * planted
    else:
        assert len({(label[v], v // 15) for v in label}) == 4 and modularity(rows, label) >= planted - 1e-9
    again = communities.detect(edge_table(spark, list(reversed(rows))), method).collect()
    assert {r.i: r.label for r in again} == label


def test_ward_and_spectral_find_blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    label = {r.i: r.label for r in communities.ward(points(spark, x.tolist()), 3).collect()}
    assert len({(label[v], v // 12) for v in label}) == 3
    near = knn(points(spark, x.tolist()), 6, group="g", key="i", vec="vec")
    got = {r.i: r.label for r in communities.spectral(graphs.knn_graph(near, mutual=False), 3).collect()}
    assert len({(got[v], v // 12) for v in got}) == 3


def test_combined_clusters_keep_every_class(spark):
    rng = np.random.default_rng(0)
    base = np.repeat(np.eye(3), 12, axis=0)
    x = frame(spark, [(i, (v + rng.normal(0, 0.05, 3)).tolist(), (v + rng.normal(0, 0.05, 3)).tolist()) for i, v in enumerate(base)], "i bigint, vec array<double>, net array<double>")
    seeds = communities.max_sum_seeds(x.select("i", "vec"), 3, 0)
    label = {r.i: r.label for r in communities.combined_clusters(x, seeds, 0.5, 0.5, 20).collect()}
    assert len({(label[v], v // 12) for v in label}) == 3


def test_event_scores(spark):
    truth = [[0, 0, 0, 1, 1, 1], [0] * 6, [0] * 6]
    inferred = [[0, 0, 0, 1, 1, 1], [0, 0, 1, 0, 0, 0], [0] * 6]
    rows = [(t, i, truth[i][t], inferred[i][t]) for i in range(3) for t in range(6)]
    r = synthetic.score_events(frame(spark, rows, "t int, i bigint, truth bigint, label bigint")).first()
    assert (r.true_events, r.inferred_events, r.hits, r.recall, r.delay) == (1, 3, 1, 1.0, 0.0)
    assert r.precision == pytest.approx(1 / 3) and r.f1 == pytest.approx(0.5)


def test_pareto_front_equals_definition(spark):
    rng = random.Random(9)
    rows = [(k, float(rng.randrange(12)), float(rng.randrange(12))) for k in range(80)]
    got = {r.k for r in windows.pareto_front(frame(spark, rows, "k int, a double, b double"), "k", "a", "b").where("on_front").collect()}
    assert got == {k for k, a, b in rows if not any(x >= a and y >= b and (x > a or y > b) for _, x, y in rows)}


def test_fisher_and_tails(spark):
    assert inference.fisher_exact(1, 9, 11, 3) == pytest.approx(0.002759456, abs=1e-8)
    t = inference.tails(spark)
    assert t.chi2(3.841458820694124, 1) == pytest.approx(0.05) and t.normal(1.959963984540054) == pytest.approx(0.05)


def test_components_split_a_hub(spark):
    """A node with most of the links: its rows are dealt to several tasks in the join with the minima."""
    from panelforge import durable

    tight = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in tight}
    try:
        for k, v in tight.items():
            spark.conf.set(k, v)
        rows = spark.range(60_000).selectExpr("id + 1 as a", "if(id % 3 = 0, 0, id div 2) as b").repartition(8)
        edges = durable.stash(rows.selectExpr("b as u", "a as v"))
        joined = edges.join(durable.stash(edges.groupBy("u").agg(F.min("v").alias("m"))), "u")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert durable.components(rows).agg(F.count("*"), F.max("comp")).first() == (60_001, 0)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_adjusted_test_equals_dense_least_squares(spark):
    """Partial R2, F and the permutation null against plain matrices with a dummy of each region; a signal is found, noise is not."""
    rng = np.random.default_rng(33)
    n = 180
    region, profile = rng.integers(0, 6, n), rng.integers(0, 3, n)
    x = rng.normal(10, 1, n)
    for effect in (1.5, 0.0):
        y = 0.4 * x + 0.2 * region + effect * (profile == 1) - effect * (profile == 2) + rng.normal(0, 0.5, n)
        rows = [(i, int(region[i]), float(x[i]), float(y[i]), float(profile[i] == 1), float(profile[i] == 2)) for i in range(n)]
        df = frame(spark, rows, "unit bigint, region bigint, x double, y double, p1 double, p2 double")
        row, draws = inference.freedman_lane(df, "unit", "region", ["y"], ["x"], ["p1", "p2"], 99, 5)
        r = row.first()
        reduced = np.column_stack([np.eye(6)[region], x])
        full = np.column_stack([reduced, profile == 1, profile == 2])
        rss = lambda a, v: float(((v - a @ np.linalg.lstsq(a, v, rcond=None)[0]) ** 2).sum())
        a, b = rss(reduced, y), rss(full, y)
        assert (r.n, r.strata, r.q, r.dof) == (n, 6, 2, n - 9)
        assert math.isclose(r.partial_r2, (a - b) / a, rel_tol=1e-9) and math.isclose(r.f, (a - b) / 2 / (b / (n - 9)), rel_tol=1e-8)
        assert (r.partial_r2 > 0.5 and r.p <= 0.02) if effect else (r.partial_r2 < 0.06 and r.p > 0.02)
        residual = y - reduced @ np.linalg.lstsq(reduced, y, rcond=None)[0]
        dealt = inference.permuted(frame(spark, [(i, int(region[i]), float(residual[i])) for i in range(n)], "unit bigint, region bigint, e double"), "unit", ["region"], ["e"], [], 2, 5)
        for rep in (1, 2):
            e = dict(sorted((q.unit, q.e) for q in dealt.where(F.col("rep") == rep).collect()))
            v = np.array([e[i] for i in range(n)])
            assert all(sorted(v[region == k]) == sorted(residual[region == k]) for k in range(6)) and not np.array_equal(v, residual)
            s, t = rss(reduced, v), rss(full, v)
            assert math.isclose(draws.where(F.col("rep") == rep).first().partial_r2, (s - t) / s, rel_tol=1e-7)


def test_united_components_equal_the_star_steps(spark):
    from panelforge import durable

    rng = random.Random(12)
    rows = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    e = frame(spark, rows, "a bigint, b bigint").selectExpr("struct(a % 3 as g, a as i) as a", "struct(a % 3 as g, b as i) as b")
    plain = lambda df: sorted((tuple(r.node), tuple(r.comp)) for r in df.collect())
    assert plain(durable.components(e)) == plain(durable.components(e, few=10**6))


def planted(groups, size):
    """A graph of dense groups of nodes numbered from 5,000,000, with few links between groups."""
    rng, n = random.Random(3), groups * size
    return [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.4 if i // size == j // size else 0.01)]


def test_joint_rounds_come_near_the_sequential_modularity(spark):
    rows = [(0, i + 5_000_000, j + 5_000_000, 1.0) for i, j in planted(6, 20)] + [(1, i, (i + 1) % 40, 1.0) for i in range(40)]
    edges = spark.createDataFrame(rows, "g int, src bigint, dst bigint, weight double")
    q = lambda labels: {r.g: r.modularity for r in validity.modularity(edges, labels).collect()}
    want = q(communities.detect(edges))
    same = spread.spread_louvain(edges)
    assert {tuple(r) for r in same.select("g", "i", "label").collect()} == {tuple(r) for r in communities.detect(edges).select("g", "i", "label").collect()}
    got = spread.spread_louvain(edges, few=60)
    near = q(got)
    assert got.count() == 160 and near[0] >= 0.99 * want[0] and near[1] >= 0.95 * want[1]
    blocks = {}
    for r in got.where("g = 0").collect():
        blocks.setdefault(r.label, set()).add((r.i - 5_000_000) // 20)
    assert sorted(map(sorted, blocks.values())) == [[k] for k in range(6)]
    assert spread.spread_louvain(edges.limit(0), few=0).count() == 0


def test_groups_are_dealt_largest_first_to_the_lightest_fold(spark):
    sizes = {"a": 5, "b": 4, "c": 4, "d": 2, "e": 1}
    rows = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "k string").repartition(3)
    assert {r.k: r.fold for r in ml.group_folds(rows, "k", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}


def test_labels_without_a_match_get_new_ids(spark):
    cont = spark.createDataFrame([(1, 7, 5), (1, 8, 9), (2, 7, 1), (1, 9, 2)], "ref bigint, cand bigint, n bigint")
    got = {r.cand: (r.aligned, r.n) for r in alignment.align_labels(cont).collect()}
    assert got == {8: (1, 9), 7: (2, 1), 9: (3, 0)}


def test_chi_squared_tail(spark):
    x = spark.createDataFrame([(3.84145882, 1), (5.99146455, 2), (11.07049769, 5), (0.0, 3), (None, 2), (800.0, 4)], "x double, k int")
    p = [r.p for r in x.select(inference.chi2_tail("x", "k").alias("p")).collect()]
    assert p[:3] == [pytest.approx(0.05, abs=1e-8)] * 3 and p[3] == 1.0 and p[4] is None and 0 <= p[5] < 1e-100


def test_temporal_edges_trade_invented_changes_for_fidelity(spark):
    runs = {(r.scenario, r.omega): r for r in synthetic.temporal_runs(spark, [0.0, 2.0], 30, 6, 1, k=5).collect()}
    assert len(runs) == 2 * len(synthetic.SCENARIOS)
    assert all(-1 <= r.ari <= 1 and 0 <= r.false_rate <= 1 for r in runs.values())
    assert all(runs[s, 2.0].false_rate < runs[s, 0.0].false_rate for s in ("stable", "abrupt", "gradual")) and runs["stable", 2.0].ari > 0.9
