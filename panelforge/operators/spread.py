"""Communities of graphs too large for one task: rounds of local moves as joins and grouped sums; the same rounds in arrays for a graph that one task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType, TimestampType

from ..durable import release, settle, stash
from .communities import Graph, detect, louvain


def _moves(level: DataFrame, resolution: float, rounds: int, still: float) -> tuple[DataFrame, int]:
    """(g, a, c) classes of a graph's nodes after rounds of simultaneous moves, and how many moves there were.

    In each round half of the nodes, by hash, may move: two that would swap classes seldom
    both do. A round is one scan of the edges; rounds end when two in a row move less than ``still`` of the nodes.
    A node's strength doesn't change in a level, so links carry it; a link of no weight to itself brings each node its own class.
    """
    inner = F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(F.col("weight"))
    ends = level.select("g", F.col("src").alias("a"), inner.alias("w")).union(level.where("src <> dst").select("g", "dst", "weight"))
    strength = stash(ends.groupBy("g", "a").agg(F.sum("w").alias("k")))
    whole = stash(strength.groupBy("g").agg(F.sum("k").alias("two_m")))  # one row for each graph
    start = strength.join(whole, "g").select("g", "a", "k", "two_m")
    links = level.where("src <> dst").selectExpr("g", "src as a", "dst as b", "weight as w").union(level.where("src <> dst").selectExpr("g", "dst", "src", "weight"))
    links = stash(links.union(strength.selectExpr("g", "a", "a", "0.0d")).join(start, ["g", "a"]))
    node, nodes, moves, quiet = start.withColumn("c", F.col("a")), strength.count(), 0, 0
    for r in range(rounds):
        # the sums are written first: a join on a hot class is then split over tasks
        total = stash(node.groupBy("g", "c").agg(F.sum("k").alias("total")))
        held = node.join(total, ["g", "c"]).select("g", F.col("a").alias("b"), "c", "total")
        to = links.join(held, ["g", "b"]).groupBy("g", "a", "c").agg(F.sum("w").alias("w"), *(F.max(x).alias(x) for x in ("k", "two_m", "total")), F.max(F.col("a") == F.col("b")).alias("mine"))
        x = to.withColumn("gain", F.expr(f"w - {resolution} * k * (total - if(mine, k, 0.0)) / two_m"))
        best = x.groupBy("g", "a").agg(*(F.max(x).alias(x) for x in ("k", "two_m")), F.max(F.expr("if(mine, c, null)")).alias("own"), F.max(F.expr("if(mine, gain, null)")).alias("stay"), F.max("gain").alias("most"), F.min_by("c", F.struct(-F.col("gain"), F.col("c"))).alias("to"))
        go = (F.col("most") > F.col("stay") + 1e-9) & (F.pmod(F.xxhash64("a", F.lit(r)), F.lit(2)) == 0)
        after = stash(best.select("g", "a", "k", "two_m", F.when(go, F.col("to")).otherwise(F.col("own")).alias("c"), go.alias("moved")))
        release(total, node)
        node = after
        n = node.where("moved").count()
        moves += n
        quiet = quiet + 1 if n <= still * nodes else 0
        if quiet == 2:
            break
    out = settle(node.select("g", "a", "c"), node, strength, whole, links)
    return out, moves


def _array_moves(a: np.ndarray, b: np.ndarray, w: np.ndarray, held: np.ndarray, resolution: float, rounds: int, still: float) -> np.ndarray:
    """``_moves`` of one graph in arrays: the class of each node. A node may move in round r unless bit r of ``held`` is set."""
    n = len(held)
    k = np.bincount(a, w, n) + np.bincount(b, w, n)
    two_m, c, quiet = k.sum(), np.arange(n), 0
    if not two_m:
        return c
    off = a != b
    x, y, w = np.concatenate((a[off], b[off])), np.concatenate((b[off], a[off])), np.concatenate((w[off], w[off]))
    for r in range(rounds):
        may = (held >> r) & 1 == 0
        nodes, use = np.flatnonzero(may), may[x]
        if len(nodes):
            total = np.bincount(c, k, n)
            key = np.concatenate((x[use] * np.int64(n) + c[y[use]], nodes * np.int64(n) + c[nodes]))
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            to = np.add.reduceat(np.concatenate((w[use], np.zeros(len(nodes))))[order], starts)
            node, cls = np.divmod(key[starts], n)
            mine = cls == c[node]
            gain = to - resolution * k[node] * (total[cls] - np.where(mine, k[node], 0.0)) / two_m
            first = np.flatnonzero(np.diff(node, prepend=-1))
            most = np.maximum.reduceat(gain, first)
            best = np.flatnonzero(gain == np.repeat(most, np.diff(first, append=len(node))))
            best = best[np.flatnonzero(np.diff(node[best], prepend=-1))]  # of equal gains the least class
            go = most > gain[mine] + 1e-9
            c[nodes[go]] = cls[best[go]]
        quiet = quiet + 1 if not len(nodes) or go.sum() <= still * n else 0
        if quiet == 2:
            break
    return c


def _array_louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, held: np.ndarray, resolution: float, few: int, rounds: int, still: float) -> np.ndarray:
    """Label of each node, from 1 by size, then least node: joint rounds and merges while there are more than ``few`` links, then ``louvain``."""
    member = np.arange(len(held))
    while len(a) > few:
        c = _array_moves(a, b, w, held, resolution, rounds, still)
        names, place = np.unique(c, return_inverse=True)
        if len(names) == len(c):
            break
        member, held, n = place[member], held[names], len(names)
        a, b = place[a], place[b]
        key, at = np.unique(np.minimum(a, b) * np.int64(n) + np.maximum(a, b), return_inverse=True)
        (a, b), w = np.divmod(key, n), np.bincount(at, w)
    if len(a) <= few:
        g: Graph = [{} for _ in held]
        for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            g[x][y] = g[y][x] = z
        member = np.array(louvain(g, resolution))[member]
    _, least, place, size = np.unique(member, return_index=True, return_inverse=True, return_counts=True)
    label = np.empty(len(size), np.int64)
    label[np.lexsort((least, -size))] = np.arange(1, len(size) + 1)
    return label[place]


def _in_one_task(level: DataFrame, resolution: float, few: int, rounds: int, still: float) -> DataFrame:
    """(g, a, c): ``_array_louvain`` of each graph of a table of distinct links."""
    kinds = dict(level.dtypes)
    # the same draws as in ``_moves``, as bits
    bits = lambda v: F.expr(" + ".join(["0L", *(f"shiftleft(pmod(xxhash64({v}, {r}), 2), {r})" for r in range(rounds))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        g, m = t.column("g")[:1].combine_chunks(), len(t)
        ends = pa.chunked_array(t.column("src").chunks + t.column("dst").chunks).combine_chunks().dictionary_encode()
        held = np.concatenate((t.column("sb").to_numpy(), t.column("db").to_numpy()))
        w = t.column("weight").to_numpy()
        del t
        order = pc.sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[ends.indices.to_numpy()]
        own = np.zeros(len(order), np.int64)
        own[at] = held
        names = ends.dictionary.take(pa.array(order))
        label = _array_louvain(at[:m], at[m:], w, own, resolution, few, rounds, still)
        for k in range(0, len(label), 100_000):
            part = names[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([g.take(pa.array(np.zeros(len(part), np.int64))), part, pa.array(label[k:k + 100_000])], ["g", "a", "c"])

    x = level.select("g", "src", "dst", "weight", bits("src").alias("sb"), bits("dst").alias("db"))
    return x.groupBy("g").applyInArrow(run, f"g {kinds['g']}, a {kinds['src']}, c bigint")


def spread_louvain(edges: DataFrame, resolution: float = 1.0, *, few: int = 1_000_000, rounds: int = 20, still: float = 0.005, held: int = 3_000_000) -> DataFrame:
    """(g, i, label) communities of each graph of an edge table (g, src, dst, weight), of any size.

    While a graph has more than ``few`` edges, its nodes move in joint rounds over the cluster and
    classes become the nodes of the next, smaller graph; once all graphs have at most ``few``,
    each is one task's work, as in ``detect``. Once all graphs have at most ``held`` edges, the rounds
    too are one task's work for each graph, with the same draws, in arrays. Graphs of at most ``few`` from the start therefore get the
    labels of ``detect``; larger ones a partition of nearly the same modularity. Labels go from 1 by size,
    then least member; nodes may be of any type that can be ordered; an empty table gives an empty result.
    """
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    level = stash(edges.groupBy("g", *ends).agg(F.sum(F.col("weight").cast("double")).alias("weight")))
    member = None
    plain = isinstance(level.schema["src"].dataType, (IntegralType, StringType, DateType, TimestampType)) and rounds < 63
    while True:
        most = level.groupBy("g").count().agg(F.max("count")).first()[0] or 0
        top, moves = None, 0
        small = plain and most <= held
        if small:
            top = stash(_in_one_task(level, resolution, few, rounds, still))
            if member is None:  # labels are by size and least member already
                release(level)
                return top.toDF("g", "i", "label")
        elif most > few:
            top, moves = _moves(level, resolution, rounds, still)
        if not (moves or small):
            release(*([top] if top is not None else []))
            top = stash(detect(level, "louvain", resolution).select("g", F.col("i").alias("a"), F.col("label").alias("c"))) if most <= few else stash(level.selectExpr("g", "src as a", "src as c").union(level.selectExpr("g", "dst", "dst")).distinct())
        own = top.withColumnRenamed("a", "i") if member is None else member.join(top, ["g", "a"]).select("g", "i", "c")
        if not moves:
            break
        a, b = top.toDF("g", "src", "x"), top.toDF("g", "dst", "y")
        merged = level.join(a, ["g", "src"]).join(b, ["g", "dst"]).groupBy("g", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.sum("weight").alias("weight"))
        lower, kept = stash(merged), stash(own.withColumnRenamed("c", "a"))
        release(level, top, *([member] if member is not None else []))
        level, member = lower, kept
    own = stash(own)
    sizes = own.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    # a row for each class
    order = stash(sizes.selectExpr("g", "c", "cast(row_number() over (partition by g order by n desc, least) as bigint) as label"))
    return settle(own.join(order, ["g", "c"]).select("g", "i", "label"), own, order, level, top, *([member] if member is not None else []))
