"""URL filters by link-graph propagation, in DataFrame operations only.

Rules decide the urls they fit, the longest first. For the others, trust flows
along host-to-host links from trusted seeds and distrust against them from blocked
seeds (who links to a blocked host is suspect), both as personalised PageRank; a
host with more distrust than trust is blocked. A host is a seed if rules decide at
least ``seed_share`` of its pages one way. Besides the links in pages, each host is
linked to its nearest parent domain in the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .block_naming import ascii_lower
from .kit import release, settle, stash

#: (verdict, host/path): the host and all its subdomains, paths that start with /path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or end, A-Z lower-cased; then up to ? # or end."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(F.regexp_extract(url, form, k), F.lit("")) for k in (1, 2))


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)


def host_links(pages: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, w): links between different hosts, summed before the shuffle.

    Only absolute links name a host. A null or empty html has none; a page without host
    links to nothing; each repeated row counts; an empty table gives no links.
    """
    out = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1))).alias("dst"))
    return out.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def parent_links(hosts: DataFrame) -> DataFrame:
    """(src, dst, w): each host to its nearest parent domain among ``hosts`` (a stashed table, distinct), as one link."""
    parts = hosts.select("host", F.split("host", r"\.").alias("p")).where(F.size("p") > 1)
    above = parts.select("host", F.posexplode(F.expr("transform(sequence(2, size(p)), k -> array_join(slice(p, k, size(p)), '.'))")).alias("k", "parent"))
    known = above.join(hosts.select(F.col("host").alias("parent")), "parent")
    return known.groupBy(F.col("host").alias("src")).agg(F.min_by("parent", "k").alias("dst")).select("src", "dst", F.lit(1.0).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-10) -> tuple[DataFrame, float]:
    """Personalised PageRank of each kind: edges (kind, src, dst, w), seeds (kind, host, s); (kind, host, rank) and the mass left.

    Seeds of a kind are scaled to 1. Ranks are the sum of damped walks from them, scaled to
    1 for each kind, which equals PageRank whose dead ends return to the seeds. Stops when the walks left
    weigh at most ``tolerance`` of all (damping sees to that, on cycles too). Kinds are a
    handful of values; a kind without seeds has no ranks. Repeated edges add up.
    """
    scale = lambda sums, col: col / F.element_at(F.create_map(*(F.lit(x) for kv in sums.items() for x in kv)), F.col("kind"))
    sums = {r.kind: float(r.s) for r in seeds.groupBy("kind").agg(F.sum("s").alias("s")).collect()}
    if not sums:
        return seeds.select("kind", "host", F.col("s").cast("double").alias("rank")), 0.0
    # aggregates are written before a join on their key: AQE splits a hot key only between bare shuffles
    total = stash(edges.groupBy("kind", "src").agg(F.sum("w").alias("total")))
    moves = stash(edges.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("total")).alias("p")))
    walk = stash(seeds.select("kind", "host", scale(sums, F.col("s")).alias("mass")))
    trail, left = [walk], float(len(sums))
    while True:
        step = walk.join(moves, (walk.kind == moves.kind) & (walk.host == moves.src)).groupBy(moves.kind.alias("kind"), moves.dst.alias("host")).agg((F.sum(F.col("mass") * F.col("p")) * damping).alias("mass"))
        walk = stash(step)
        trail.append(walk)
        left = walk.agg(F.sum("mass")).first()[0] or 0.0
        if left <= tolerance:
            break
        if len(trail) > 16:
            whole = stash(_added(trail[:-1]))
            release(*trail[:-1])
            trail = [whole, walk]
    ranks = stash(_added(trail))
    sums = {r.kind: float(r.s) for r in ranks.groupBy("kind").agg(F.sum("mass").alias("s")).collect()}
    out = stash(ranks.select("kind", "host", scale(sums, F.col("mass")).alias("rank")))
    release(total, moves, ranks, *trail)
    return out, left


def _added(trail: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, trail).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def link_filter(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, seed_share: float = 0.5, margin: float = 1e-9, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null) and verdict (allow or block) of each page.

    Without a rule, a page is blocked if its host's distrust exceeds its trust by
    more than ``margin`` (both are shares of their kind's total); equal shares within it, and a
    host that neither reaches, are allowed. A null url or one without ``://`` has empty
    host and path and is allowed. A null html has no links. Rows keep their number; null
    ids and repeated rows stay; other columns are ignored; an empty table gives an empty
    result.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).cast("bigint").alias("page_id"), ascii_lower(host).alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    rule = F.coalesce(*(F.when(_fits(r), F.lit(r)) for _, r in ordered))
    said = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for v, r in ordered))
    judged = stash(parts.select("page_id", "host", "path", rule.alias("rule")).withColumn("said", said))

    hosts = stash(judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad")))
    one = lambda kind, col: hosts.where(F.col(col) >= F.col("n") * seed_share).select(F.lit(kind).alias("kind"), "host", F.col("n").cast("double").alias("s"))
    seeds = stash(one("trust", "good").union(one("distrust", "bad")))
    links = stash(host_links(parts, "html").unionByName(parent_links(hosts)))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "w").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("w")))
    ranks, _ = propagate(edges, seeds, damping=damping)

    score = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(-F.col("rank"))).alias("score"))
    bad = stash(score.where(F.col("score") < -margin).select("host", F.lit("block").alias("graph")))
    out = judged.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", "graph", F.lit("allow")).alias("verdict"))
    release(hosts, seeds, links)
    return settle(out, judged, ranks, bad)
