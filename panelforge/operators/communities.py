"""Community detection and clustering.

Graph algorithms that visit nodes in sequence run as one Arrow group for each graph
(a period, a parameter setting, a replicate): many graphs run at once, each in
bounded memory. They are deterministic: nodes are visited by id, ties go to
the smaller label. Geometric iterations (Lloyd, combined distance) are DataFrame joins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import release, settle, stash
from ..functions.columns import euclid

Graph = list[dict[int, float]]


def _graph(t: pd.DataFrame) -> tuple[list, Graph]:
    names = sorted(set(t.src) | set(t.dst))
    at = {v: k for k, v in enumerate(names)}
    g: Graph = [{} for _ in names]
    for a, b, w in zip(t.src, t.dst, t.weight, strict=True):
        x, y = at[a], at[b]
        g[x][y] = g[x].get(y, 0.0) + w
        if x != y:
            g[y][x] = g[y].get(x, 0.0) + w
    return names, g


def _local_moves(g: Graph, label: list[int], resolution: float, within: list[int] | None = None) -> bool:
    """Move nodes to the neighbouring class of largest gain until none gains; with ``within``, only inside its classes."""
    strength = [sum(r.values()) + r.get(i, 0.0) for i, r in enumerate(g)]
    two_m = sum(strength)
    if not two_m:
        return False
    total: dict[int, float] = defaultdict(float)
    for i, c in enumerate(label):
        total[c] += strength[i]
    moved_at_all, queue = False, list(range(len(g)))
    waiting = set(queue)
    while queue:
        following = []
        for i in queue:
            waiting.discard(i)
            to: dict[int, float] = defaultdict(float)
            for j, w in g[i].items():
                if j != i and (within is None or within[j] == within[i]):
                    to[label[j]] += w
            own = label[i]
            total[own] -= strength[i]
            gain = lambda c: to.get(c, 0.0) - resolution * strength[i] * total[c] / two_m  # noqa: B023, E731
            best, most = own, gain(own)
            for c in sorted(to):
                if gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            total[best] += strength[i]
            if best != own:
                label[i] = best
                moved_at_all = True
                for j in sorted(g[i]):
                    if label[j] != best and j not in waiting and j != i:
                        waiting.add(j)
                        following.append(j)
        queue = following
    return moved_at_all


def _merge(g: Graph, label: list[int]) -> tuple[Graph, list[int]]:
    """Graph of classes, and each node's place in it."""
    order = {c: k for k, c in enumerate(sorted(set(label)))}
    place = [order[c] for c in label]
    out: Graph = [{} for _ in order]
    for i, row in enumerate(g):
        for j, w in row.items():
            a, b = place[i], place[j]
            if j >= i:
                out[a][b] = out[a].get(b, 0.0) + w
                if a != b:
                    out[b][a] = out[b].get(a, 0.0) + w
    return out, place


def louvain(g: Graph, resolution: float = 1.0) -> list[int]:
    member, level = list(range(len(g))), g
    while True:
        label = list(range(len(level)))
        if not _local_moves(level, label, resolution):
            return member
        level, place = _merge(level, label)
        member = [place[m] for m in member]


def leiden(g: Graph, resolution: float = 1.0) -> list[int]:
    """Louvain with a refinement inside each class before merging, so that classes stay connected."""
    member, level = list(range(len(g))), g
    start = list(range(len(g)))
    while True:
        label = list(start)
        moved = _local_moves(level, label, resolution)
        fine = list(range(len(level)))
        _local_moves(level, fine, resolution, label)
        if not moved or len(set(fine)) == len(level):
            return _connected(g, [label[m] for m in member])
        merged, place = _merge(level, fine)
        coarse = [0] * len(merged)
        for i, p in enumerate(place):
            coarse[p] = label[i]
        first = {c: min(k for k, x in enumerate(coarse) if x == c) for c in set(coarse)}
        start = [first[c] for c in coarse]
        level, member = merged, [place[m] for m in member]


def _connected(g: Graph, label: list[int]) -> list[int]:
    """Split classes into their connected parts."""
    out, fresh = [-1] * len(g), 0
    for i in range(len(g)):
        if out[i] < 0:
            stack, out[i] = [i], fresh
            while stack:
                u = stack.pop()
                for v in g[u]:
                    if out[v] < 0 and label[v] == label[u]:
                        out[v] = fresh
                        stack.append(v)
            fresh += 1
    return out


def greedy_modularity(g: Graph, resolution: float = 1.0) -> list[int]:
    """Agglomerate the pair of classes with the largest gain until none gains."""
    import heapq

    strength = [sum(r.values()) + r.get(i, 0.0) for i, r in enumerate(g)]
    two_m = sum(strength) or 1.0
    links = [{c: w for c, w in r.items() if c != i} for i, r in enumerate(g)]
    alive = [True] * len(g)
    member = list(range(len(g)))
    value = lambda a, b: 2 * (links[a][b] / two_m - resolution * strength[a] * strength[b] / two_m**2)
    heap = [(-value(a, b), a, b) for a in range(len(g)) for b in links[a] if a < b]
    heapq.heapify(heap)
    # While a link stays as it is, its gain only falls, as strengths grow: an older entry is a bound and is valued
    # again when its turn comes. Only changed links need new entries, unless weights may be negative.
    falls = all(w >= 0 for r in g for w in r.values())
    while heap:
        gain, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]):
            continue
        now = -value(a, b)
        if now != gain:
            if now > gain:
                heapq.heappush(heap, (now, a, b))
            continue
        if -gain <= 1e-15:
            break
        own, gone = links[a], links[b]
        links[b] = {}
        for c, w in gone.items():
            if c != a:
                own[c] = links[c][a] = own.get(c, 0.0) + w
                del links[c][b]
        del own[b]
        strength[a] += strength[b]
        alive[b] = False
        member[b] = a
        for c in gone if falls else list(own):
            if c != a:
                pair = (a, c) if a < c else (c, a)
                heapq.heappush(heap, (-value(*pair), *pair))
    for i in range(len(member)):
        root = i
        while member[root] != root:
            root = member[root]
        while member[i] != root:
            member[i], i = root, member[i]
    return member


def _relabelled(names: list, label: list[int]) -> pd.DataFrame:
    """Labels from 1 by size descending, then by least member."""
    groups: dict[int, list] = defaultdict(list)
    for v, c in zip(names, label, strict=True):
        groups[c].append(v)
    order = sorted(groups.values(), key=lambda m: (-len(m), min(m)))
    return pd.DataFrame([(v, k) for k, m in enumerate(order, 1) for v in m], columns=["i", "label"])


_METHODS = {"louvain": louvain, "leiden": leiden, "greedy": greedy_modularity}


def detect(edges: DataFrame, method: str = "louvain", resolution: float = 1.0) -> DataFrame:
    """(g, i, label) communities of each graph of an edge table (g, src, dst, weight)."""
    kinds = dict(edges.dtypes)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        names, g = _graph(t)
        out = _relabelled(names, _METHODS[method](g, resolution))
        out.insert(0, "g", t.g.iloc[0])
        return out

    return edges.select("g", "src", "dst", "weight").groupBy("g").applyInPandas(run, f"g {kinds['g']}, i {kinds['src']}, label bigint")


def parameter_grid(edges: DataFrame, resolutions: list[float], method: str = "louvain") -> DataFrame:
    """(g, resolution, i, label): all settings at once, each its own group."""
    kinds = dict(edges.dtypes)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        names, g = _graph(t)
        out = _relabelled(names, _METHODS[method](g, float(t.resolution.iloc[0])))
        out.insert(0, "resolution", t.resolution.iloc[0])
        out.insert(0, "g", t.g.iloc[0])
        return out

    grid = edges.select("g", "src", "dst", "weight", F.explode(F.array(*map(F.lit, resolutions))).alias("resolution"))
    return grid.groupBy("g", "resolution").applyInPandas(run, f"g {kinds['g']}, resolution double, i {kinds['src']}, label bigint")


def _leading(g: Graph, s: np.ndarray, k: int, tolerance: float = 1e-9) -> np.ndarray:
    """Eigenvectors of the k largest eigenvalues of a normalised adjacency, from products with its links only.

    Each connected part has the eigenvalue 1 with a known vector, the roots of its strengths; the k largest parts go first (then by
    least member). What is left of k is found by a block Krylov method with restarts in the space beside them.
    """
    n = len(g)
    rows = np.repeat(np.arange(n), [len(r) for r in g])
    columns = np.fromiter((j for r in g for j in r), np.int64, len(rows))
    links = s[rows] * np.fromiter((w for r in g for w in r.values()), float, len(rows)) * s[columns]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    filled = rows[starts]

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        out[filled] = np.add.reduceat(links[:, None] * x[columns], starts, axis=0)
        return out

    part = np.array(_connected(g, [0] * n))
    order = np.argsort(-np.bincount(part), kind="stable")[:k]
    known = np.zeros((n, len(order)))
    for c, p in enumerate(order):
        known[part == p, c] = 1 / s[part == p]
    known /= np.linalg.norm(known, axis=0)
    if part.max() + 1 >= k:
        return known[:, ::-1]

    def beside(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - known @ (known.T @ x)
            x = x - basis @ (basis.T @ x)
        norm = np.linalg.norm(x, axis=0)
        q, r = np.linalg.qr(x[:, norm > 1e-13] / norm[norm > 1e-13])
        return q[:, np.abs(np.diag(r)) > 1e-8]

    want = min(k - len(order), n - len(order))
    width = want + 4
    v = beside(np.random.default_rng(0).normal(size=(n, width)), np.zeros((n, 0)))
    av = times(v)
    for _ in range(2000):
        h = v.T @ av
        w, u = np.linalg.eigh((h + h.T) / 2)
        x, ax = v @ u[:, -width:], av @ u[:, -width:]
        left = ax - x * w[-width:]
        if np.linalg.norm(left[:, -want:], axis=0).max() < tolerance:
            break
        if v.shape[1] + width > 20 * width:
            v, av = v @ u[:, -3 * width:], av @ u[:, -3 * width:]
        more = beside(left, v)
        if not more.shape[1]:
            break
        v, av = np.hstack((v, more)), np.hstack((av, times(more)))
    else:
        raise ValueError("eigenvectors have not converged")
    return np.hstack((x[:, -want:], known[:, ::-1]))


def spectral(edges: DataFrame, k: int, dense: int = 2_000) -> DataFrame:
    """(g, i, label): normalised-Laplacian eigenvectors of each graph, rows scaled to unit length, then deterministic Lloyd.

    Graphs of more than ``dense`` nodes are never made a full matrix.
    """
    kinds = dict(edges.dtypes)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        names, g = _graph(t)
        s = 1 / np.sqrt(np.maximum([sum(row.values()) for row in g], 1e-12))
        if len(g) > dense:
            x = _leading(g, s, k)
        else:
            a = np.zeros((len(g), len(g)))
            for i, row in enumerate(g):
                for j, w in row.items():
                    a[i, j] = w
            s = 1 / np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
            _, vec = np.linalg.eigh(s[:, None] * a * s[None, :])
            x = vec[:, -min(k, len(g)):]
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        out = _relabelled(names, _lloyd(x, k))
        out.insert(0, "g", t.g.iloc[0])
        return out

    return edges.select("g", "src", "dst", "weight").groupBy("g").applyInPandas(run, f"g {kinds['g']}, i {kinds['src']}, label bigint")


def _lloyd(x: np.ndarray, k: int, rounds: int = 100) -> list[int]:
    """Farthest-first seeds from the first point, then Lloyd; an empty class keeps its centre."""
    seeds = [0]
    d = ((x - x[0]) ** 2).sum(axis=1)
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmax(d)))
        d = np.minimum(d, ((x - x[seeds[-1]]) ** 2).sum(axis=1))
    centre = x[seeds].copy()
    label = None
    for _ in range(rounds):
        new = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        if label is not None and np.array_equal(new, label):
            break
        label = new
        for c in range(len(centre)):
            if (label == c).any():
                centre[c] = x[label == c].mean(axis=0)
    return label.tolist()


def _ward_merges(x: np.ndarray, near: int = 8, tile: int = 8192, strip: int = 128) -> list[tuple[float, int, int]]:
    """(cost, least point, least point of the other) of every Ward merge, points in order of their numbers.

    Equal points merge first, at no cost. Then all pairs of classes that are each other's nearest merge at once: such pairs merge in any
    order of work. A class keeps a few nearest candidates with exact costs and a bound under which no other class lies. A merge
    costs no less than the nearer of its parts, so bounds hold on; a candidate that merges is measured again as the merged class,
    and only a class whose candidates all pass its bound is compared with all. That goes by single-precision products whose error widens the bound.
    """
    n, merges = len(x), []
    if n < 2:
        return merges
    _, first, place, count = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    place = place.ravel()
    order = np.argsort(first)
    first, size = first[order], count[order].astype(float)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    same = first[at[place]]
    merges.extend((0.0, int(a), int(b)) for a, b in zip(same, range(n), strict=True) if a != b)
    centre = x[first] - x.mean(axis=0)
    m = len(first)
    alive, found, cost, bound = np.ones(m, bool), np.full((m, near), -1), np.full((m, near), np.inf), np.full(m, -np.inf)

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        for k in range(0, len(a), 20_000):
            p, q = a[k:k + 20_000], b[k:k + 20_000]
            gap = centre[p] - centre[q]
            out[k:k + 20_000] = size[p] * size[q] / (size[p] + size[q]) * np.einsum("ij,ij->i", gap, gap)
        return out

    def ask(rows: np.ndarray) -> None:
        """New candidates and bounds of ``rows`` among all living classes."""
        live = np.flatnonzero(alive)
        if len(live) <= max(64, 4 * near):  # few: all pairs exactly
            for r in rows:
                others = live[live != r]
                c = exact(np.full(len(others), r), others)
                best = np.lexsort((others, c))[:near]
                found[r], cost[r], bound[r] = -1, np.inf, np.inf if len(others) <= near else c[best[-1]]
                found[r, :len(best)], cost[r, :len(best)] = others[best], c[best]
            return
        wide = min(128, max(1, len(live) // (4 * near)))
        cols = -(-len(live) // wide) * wide
        square = np.full(cols, 1e30, np.float32)  # places beyond the living are far away
        square[:len(live)] = (centre[live] ** 2).sum(axis=1)
        slim = np.zeros((cols, x.shape[1] + 2), np.float32)  # squares ride along in the products
        slim[:len(live), :-2], slim[:, -2], slim[:, -1] = centre[live], square, 1
        even = (size[live] == size[live[0]]).all()
        inverse = np.ones(cols, np.float32)
        inverse[:len(live)] = 1 / size[live]
        spot = np.full(len(alive), -1)
        spot[live] = np.arange(len(live))
        top = float(square[:len(live)].max())
        step = max(wide, tile // wide * wide)
        rough, scale = np.empty((strip, cols), np.float32), np.empty((strip, step), np.float32)
        for k in range(0, len(rows), strip):
            r = rows[k:k + strip]
            own = spot[r]
            d = rough[:len(r)]
            left, ls, li = -2 * slim[own], square[own, None], inverse[own, None]
            left[:, -2], left[:, -1] = 1, ls[:, 0]
            if even:
                left /= 2 * li
            for c in range(0, cols, step):
                part = d[:, c:c + step]
                np.matmul(left, slim[c:c + step].T, out=part)
                if not even:
                    part /= np.add(inverse[c:c + step], li, out=scale[:len(r), :part.shape[1]])
            d[np.arange(len(r)), own] = np.inf
            least = d.reshape(len(r), -1, wide).min(axis=2)
            blocks = np.argpartition(least, near, axis=1)[:, :near + 1]
            limit = np.take_along_axis(least, blocks[:, near:], axis=1)[:, 0]  # what is under it lies in the other blocks
            blocks = blocks[:, :near]
            inside = np.take_along_axis(d.reshape(len(r), -1, wide), blocks[:, :, None], axis=1).reshape(len(r), -1)
            pick = np.argpartition(inside, near - 1, axis=1)[:, :near + 1]
            values = np.take_along_axis(inside, pick, axis=1)
            limit = np.minimum(limit, values[:, near:].min(axis=1, initial=np.inf))
            pick = pick[:, :near]
            chosen = np.take_along_axis(blocks, pick // wide, axis=1) * wide + pick % wide
            chosen = live[np.minimum(chosen, len(live) - 1)]
            norm = np.sqrt(ls[:, 0].astype(float))
            # of classes four times as far out the error is a small share of the cost itself
            slack = 4e-6 * max(1.0, x.shape[1] / 64) * (size[r] * np.minimum((norm + np.sqrt(top)) ** 2, 25 * norm**2) + 5 * np.where(limit < np.inf, limit, 0.0))
            found[r], bound[r] = chosen, limit - slack
            cost[r] = exact(np.repeat(r, near), chosen.ravel()).reshape(len(r), near)
            wrong = r[cost[r].min(axis=1) > bound[r]]
            for w in wrong:  # the error leaves the nearest open
                others = live[live != w]
                c = exact(np.full(len(others), w), others)
                best = np.argpartition(c, near)[:near + 1]
                best = best[np.argsort(c[best], kind="stable")]
                found[w], cost[w], bound[w] = others[best[:near]], c[best[:near]], c[best[near]]

    ask(np.arange(m))
    living = m
    while living > 1:
        live = np.flatnonzero(alive)
        least = cost[live].min(axis=1)
        nearest = np.full(len(alive), -1)
        nearest[live] = np.where(cost[live] == least[:, None], found[live], len(alive)).min(axis=1)
        a = live[(nearest[nearest[live]] == live) & (live < nearest[live])]
        if not len(a):  # ties in a ring: the cheapest of all may merge
            best = live[np.argmin(least)]
            a = np.array([min(best, nearest[best])])
            nearest[a] = max(best, nearest[best])
        b = nearest[a]
        price = exact(a, b)
        merges.extend(zip(price.tolist(), first[a].tolist(), first[b].tolist(), strict=True))
        both = size[a] + size[b]
        centre[a] = (size[a, None] * centre[a] + size[b, None] * centre[b]) / both[:, None]
        size[a] = both
        alive[b] = False
        living -= len(a)
        if living == 1:
            break
        to, touched = np.arange(len(alive)), np.zeros(len(alive), bool)
        to[b] = a
        touched[a] = touched[b] = True
        merged = np.zeros(len(alive), bool)
        merged[a] = True
        rest = np.flatnonzero(alive & ~merged)
        hit = (found[rest] >= 0) & touched[found[rest]]
        row, col = np.nonzero(hit)
        row = rest[row]
        found[row, col] = to[found[row, col]]
        cost[row, col] = exact(row, found[row, col])
        out = rest[cost[rest].min(axis=1) > bound[rest]]
        ask(np.concatenate((a, out)))
        if living <= len(alive) // 2:
            keep = np.flatnonzero(alive)
            new = np.full(len(alive), -1)
            new[keep] = np.arange(len(keep))
            found = np.where(found[keep] >= 0, new[found[keep]], -1)
            size, centre, first, cost, bound, alive = size[keep], centre[keep], first[keep], cost[keep], bound[keep], np.ones(len(keep), bool)
    return merges


def ward(points: DataFrame, k: int) -> DataFrame:
    """(g, i, label): Ward agglomeration of each group (g, i, vec) to k classes, by merging all mutually nearest classes at once."""
    kinds = dict(points.dtypes)

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("i")
        n = len(t)
        merges = _ward_merges(np.array([np.asarray(v, float) for v in t.vec]))
        root = list(range(n))

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = v = root[root[v]]
            return v

        for _, a, b in sorted(merges)[:max(0, n - k)]:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        out = _relabelled(t.i.tolist(), [find(v) for v in range(n)])
        out.insert(0, "g", t.g.iloc[0])
        return out

    return points.select("g", "i", "vec").groupBy("g").applyInPandas(run, f"g {kinds['g']}, i {kinds['i']}, label bigint")


def _mean_vector(df: DataFrame, by: list[str], vec: str, name: str) -> DataFrame:
    x = df.select(*by, F.posexplode(vec).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("x"))
    return x.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias(name))


def lloyd(points: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(i, label): fixed number of Lloyd rounds from given seeds (label, centre); k centres are broadcast, ties go to the smaller label."""
    centres = seeds
    for _ in range(rounds):
        labelled = _nearest(points, centres)
        centres = _mean_vector(labelled, ["label"], "vec", "centre")
    return _nearest(points, centres).select("i", "label")


def _nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    table = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct("label", "centre"))).alias("cs")))  # k centres in one row
    pick = F.array_min(F.transform("cs", lambda c: F.struct(F.round(euclid(F.col("vec"), c["centre"]), 9).alias("d"), c["label"].alias("label"))))["label"]
    return points.crossJoin(table).select("i", "vec", pick.alias("label"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array column as rows of a matrix; every row has the same length."""
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def _cosines(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """1 - cosine of each row with each centre, clipped to [0, 2]; zero vectors are at distance 1."""
    scale = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(centres, axis=1)[None, :]
    return np.where(scale > 0, np.clip(1 - x @ centres.T / np.where(scale > 0, scale, 1), 0, 2), 1.0)


def max_sum_seeds(points: DataFrame, k: int, first: int) -> DataFrame:
    """(label, i, vec): a given first point, then the point with the largest summed distance to the chosen ones.

    Each choice is one pass; a task sends its own best point only. Ties at nine digits go to the smaller id.
    """
    points = points.select("i", F.col("vec").cast("array<double>").alias("vec"))
    rows = [(int(r.i), list(r.vec)) for r in points.where(F.col("i") == first).limit(1).collect()]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        taken, centres = [i for i, _ in rows], np.array([v for _, v in rows], float)
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b, "vec")
            total = np.round(_cosines(x, centres).sum(axis=1), 9)
            total[np.isin(ids, taken)] = -1
            for at in np.flatnonzero(total == total.max(initial=-1)):
                if total[at] >= 0 and (top is None or (-total[at], ids[at]) < (-top[0], top[1])):
                    top = (float(total[at]), int(ids[at]), x[at].tolist())
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array([top[0]]), pa.array([top[1]]), pa.array([top[2]], pa.list_(pa.float64()))], ["s", "i", "vec"])

    while len(rows) < k:
        r = points.mapInArrow(best, "s double, i bigint, vec array<double>").orderBy(F.desc("s"), "i").first()
        if r is None:
            break
        rows.append((int(r.i), list(r.vec)))
    return points.sparkSession.createDataFrame([(c, i, v) for c, (i, v) in enumerate(rows)], "label bigint, i bigint, vec array<double>")


def combined_clusters(points: DataFrame, seeds: DataFrame, rho: float, xi: float, rounds: int) -> DataFrame:
    """(i, label): attributed-network clusters. points: (i, vec, net): alternate assignment by rho x cosine distance of features
    plus xi x cosine distance of network rows, and means; stops when no centre changes; an empty class is an error.

    A round is one job: a task sends the sums of each class, and k centres reach the driver. Distances are
    compared at nine digits, ties go to the smaller label. Labels are written once, at the end.
    """
    points = stash(points.select("i", F.col("vec").cast("array<double>").alias("vec"), F.col("net").cast("array<double>").alias("net")))
    rows = points.join(F.broadcast(seeds.select("label", "i")), "i").select("label", "vec", "net").collect()  # k seeds
    centres = sorted((int(r.label), np.array(r.vec), np.array(r.net)) for r in rows)
    names, own = np.array([c for c, _, _ in centres]), [np.array([c[1] for c in centres]), np.array([c[2] for c in centres])]

    def nearest(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = _matrix(b, "vec"), _matrix(b, "net")
        return np.round(rho * _cosines(x, own[0]) + xi * _cosines(y, own[1]), 9).argmin(axis=1), x, y

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(names), np.int64), None
        for b in batches:
            at, x, y = nearest(b)
            both = np.hstack((x, y))
            total = np.zeros((len(names), both.shape[1])) if total is None else total
            np.add.at(total, at, both)
            n += np.bincount(at, minlength=len(names))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], ["c", "n", "s"])

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[nearest(b)[0]])], ["i", "label"])

    for _ in range(rounds - 1):
        parts = points.mapInArrow(sums, "c bigint, n bigint, s array<double>")
        each = parts.select("c", "n", F.posexplode("s").alias("dim", "x")).groupBy("c", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # k rows of a point's length
        total = np.zeros((len(names), own[0].shape[1] + own[1].shape[1]))
        for r in each:
            if not r.n:
                raise ValueError("empty class")
            total[r.c, r.dim] = r.x / r.n
        new = [total[:, :own[0].shape[1]], total[:, own[0].shape[1]:]]
        same = all(np.allclose(a, b, rtol=0, atol=1e-13) for a, b in zip(new, own, strict=True))
        own = new
        if same:
            break
    return settle(points.mapInArrow(labels, f"i {dict(points.dtypes)['i']}, label bigint"), points)


def kmeans(points: DataFrame, k: int, restarts: int = 5, seed: int = 0) -> DataFrame:
    """(i, label, cost): the cheapest of several k-means runs, each seeded by distance-weighted draws; labels from 1 by size, then least id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = stash(points.select("i", F.col("vec").cast("array<double>").alias("vec")))
    data = x.select("i", array_to_vector("vec").alias("features"))
    fits = [KMeans(k=k, seed=seed + r, maxIter=100, tol=1e-6).fit(data) for r in range(restarts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    out = stash(best.transform(data).select("i", F.col("prediction").alias("c")))
    order = out.groupBy("c").agg(F.count("*").alias("n"), F.min("i").alias("least")).collect()  # k rows
    place = {r.c: n for n, r in enumerate(sorted(order, key=lambda r: (-r.n, r.least)), 1)}
    name = F.element_at(F.create_map(*(F.lit(v) for kv in place.items() for v in kv)), F.col("c"))
    return settle(out.select("i", name.cast("bigint").alias("label"), F.lit(float(best.summary.trainingCost)).alias("cost")), x, out)
