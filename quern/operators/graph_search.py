"""Searches over graphs with a bound on what they look at: communities on several
levels, betweenness from sampled paths, best-first paths to a goal.

Loops write each step, so a lost executor costs one step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stored
from .graph import undirected
from .windows import numbered

# Communities


def weighted_links(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(src, dst, w): both directions of an undirected graph, equal edges added up; loops once."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    e = edges.select("src", "dst", w.alias("w"))
    both = e.union(e.where("src <> dst").select("dst", "src", "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def contracted(links: DataFrame, communities: DataFrame) -> DataFrame:
    """Communities (node, community) as nodes; what lay inside becomes a loop of its whole weight."""
    c = communities.select("node", "community")
    got = links.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst")
    return got.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def modularity_of(contracted_links: DataFrame) -> float:
    """Modularity of the partition whose communities are the nodes."""
    per = contracted_links.groupBy("src").agg(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("k"))
    all_of = per.agg(F.sum("inside").alias("inside"), F.sum("k").alias("m2"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares")).first()
    return float(all_of["inside"] / all_of["m2"] - all_of["squares"] / all_of["m2"] ** 2) if all_of["m2"] else 0.0


def moved(links: DataFrame, rounds: int) -> tuple[DataFrame, float]:
    """((node, community), modularity): rounds in which half of the nodes (by a hash of node and round) go to the
    neighbouring community of the largest gain, ties to the least; the better of the last two, or none if both lose."""
    degree = stored(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k").alias("m2")).first()["m2"] or 1
    now = degree.select("node", F.col("node").alias("community"))
    best, least = now, modularity_of(links)
    outside = links.where("src <> dst")
    for i in range(rounds):
        placed = now.join(degree, "node")
        size = placed.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("size"))
        near = outside.join(now, F.col("dst") == F.col("node")).groupBy("src", F.col("community").alias("c")).agg(F.sum("w").alias("w"))
        own = placed.select(F.col("node").alias("src"), F.col("community").alias("c"), F.lit(0).alias("w"))
        options = near.unionByName(own).groupBy("src", "c").agg(F.sum("w").alias("w"))
        scored = options.join(size, "c").join(placed.select(F.col("node").alias("src"), "community", "k"), "src")
        rest = F.col("size") - F.when(F.col("c") == F.col("community"), F.col("k")).otherwise(0)
        # whole numbers, so that equal gains are equal
        gain = F.col("w").cast("decimal(38,0)") * F.lit(total) - F.col("k").cast("decimal(38,0)") * rest
        chosen = scored.withColumn("gain", gain).groupBy("src", "community").agg(F.max_by("c", F.struct("gain", (-F.col("c")).alias("c"))).alias("c"))
        moves = F.pmod(F.xxhash64("src", F.lit(i)), F.lit(2)) == 0
        now = stored(chosen.select(F.col("src").alias("node"), F.when(moves, F.col("c")).otherwise(F.col("community")).alias("community")))
        if i < rounds - 2:  # early rounds are not the best
            continue
        q = modularity_of(contracted(links, now))
        if q > least:
            best, least = now, q
    return best, least


def communities(edges: DataFrame, levels: int = 10, rounds: int = 4, weight: str | None = None) -> tuple[DataFrame, list[float]]:
    """((node, community), modularity of each level): nodes move, communities become weighted nodes and move again.

    Ends when a level gains nothing. Each level's graph is the contracted one
    of the level before, so levels beyond the first are small. Node ids are
    whole numbers; a community is named by one of its nodes.
    """
    links = stored(weighted_links(edges, weight))
    found, gained = moved(links, rounds)
    reached = [gained]
    for _ in range(levels - 1):
        links = stored(contracted(links, found if len(reached) == 1 else higher))
        higher, q = moved(links, rounds)
        if q <= reached[-1]:
            break
        reached.append(q)
        found = stored(found.join(higher.toDF("community", "outer"), "community").select("node", F.col("outer").alias("community")))
    return found, reached


# Betweenness


def samples_for(error: float, failure: float, n: int, vertex_diameter: int | None = None) -> int:
    """Paths to draw so that with probability 1 - failure every node's share is within error.

    With a bound on the nodes of a shortest path the number does not depend on
    the graph (M. Riondato, E. Kornaropoulos, Fast approximation of betweenness
    centrality through sampling, 2016); else Hoeffding's bound over all nodes
    grows with the logarithm of their number.
    """
    if vertex_diameter is not None:
        depth = math.floor(math.log2(vertex_diameter - 2)) if vertex_diameter > 2 else 0
        return math.ceil(0.5 / error**2 * (depth + 1 + math.log(1 / failure)))
    return math.ceil(math.log(2 * max(n, 1) / failure) / (2 * error**2))


def _drawn(rows: DataFrame, by: list[str], weight: Column, seed: str, *columns: str) -> DataFrame:
    """One row for each key, with a chance by weight: the largest ln(u) / weight wins, u a hash of key and node."""
    u = (F.pmod(F.xxhash64(*by, "node", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.groupBy(*by).agg(F.max_by(F.struct("node", *columns), F.struct((F.log(u) / weight).alias("x"), "node")).alias("x")).select(*by, "x.*")


def sampled_betweenness(edges: DataFrame, error: float = 0.1, failure: float = 0.1, vertex_diameter: int | None = None, seed: int = 0) -> tuple[DataFrame, int]:
    """((node, betweenness), number of paths): share of ordered pairs whose shortest paths pass a node, estimated.

    Pairs of nodes are drawn by hash; of each pair's shortest paths one is
    drawn evenly, and its inner nodes count. Both ends of all pairs search
    breadth first, in turn, until they meet, so a path touches the root of what
    a search from one end would. Rows are keyed by (sample, node); their number
    does not grow with the number of nodes as sources would make it.
    """
    e = stored(undirected(edges).where("src <> dst").distinct())
    nodes = numbered(undirected(edges).select(F.col("src").alias("node")).distinct(), "node", "number_")
    nodes = stored(nodes.select("node", F.col("number_").alias("number")))
    n = nodes.count()
    r = samples_for(error, failure, n, vertex_diameter)
    if n < 2:
        return nodes.select("node", F.lit(0.0).alias("betweenness")), r
    first = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("s")), F.lit(n))
    second = F.pmod(F.xxhash64("id", F.lit(seed), F.lit("t")), F.lit(n - 1))
    picks = edges.sparkSession.range(r).select(F.col("id").alias("sample"), first.alias("a"), second.alias("b")).withColumn("b", F.col("b") + F.when(F.col("b") >= F.col("a"), 1).otherwise(0))
    sides = []
    for end in ("a", "b"):
        at = nodes.join(F.broadcast(picks.select("sample", F.col(end).alias("number"))), "number")
        sides.append([stored(at.select("sample", "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths")))])
    met = None
    fronts = [s[0] for s in sides]
    turn = 0
    while True:
        mine = sides[turn]
        seen = mine[0]
        for level in mine[1:]:
            seen = seen.unionByName(level)
        step = fronts[turn].join(e, F.col("node") == F.col("src")).groupBy("sample", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = stored(step.join(seen.select("sample", "node"), ["sample", "node"], "left_anti").select("sample", "node", F.lit(len(mine)).alias("d"), "paths"))
        if level.isEmpty():
            break
        mine.append(level)
        other = fronts[1 - turn].select("sample", "node", F.col("d").alias("e"), F.col("paths").alias("other"))
        meeting = stored(level.join(other, ["sample", "node"]).select("sample", "node", F.col("d" if turn == 0 else "e").alias("a"), F.col("e" if turn == 0 else "d").alias("b"), (F.col("paths") * F.col("other")).alias("w")))
        met = meeting if met is None else met.unionByName(meeting)
        done = meeting.select("sample").distinct()
        # a pair ends where its ends meet, or where either end has nowhere to go
        alive = level.select("sample").distinct()
        fronts[turn] = level.join(done, "sample", "left_anti")
        fronts[1 - turn] = stored(fronts[1 - turn].join(done, "sample", "left_anti").join(alive, "sample", "left_semi"))
        turn = 1 - turn
    if met is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness")), r
    middle = stored(_drawn(met, ["sample"], F.col("w"), "middle", "a", "b"))
    inner = [middle.where("a > 0 AND b > 0").select("sample", "node")]
    for side, column in zip(sides, ("a", "b")):
        known = side[0]
        for level in side[1:]:
            known = known.unionByName(level)
        now = middle.select("sample", "node", F.col(column).alias("d"))
        while True:
            steps = now.where("d > 1").join(e, F.col("node") == F.col("src")).select("sample", F.col("dst").alias("node"), (F.col("d") - 1).alias("d"))
            now = stored(_drawn(steps.join(known, ["sample", "node", "d"]), ["sample"], F.col("paths"), column, "d"))
            if now.isEmpty():
                break
            inner.append(now.select("sample", "node"))
    passed = inner[0]
    for more in inner[1:]:
        passed = passed.unionByName(more)
    counted = passed.groupBy("node").agg(F.count("*").alias("c"))
    return nodes.join(counted, "node", "left").select("node", (F.coalesce("c", F.lit(0)) / F.lit(float(r))).alias("betweenness")), r


# Paths to a goal


def best_first(edges: DataFrame, goals: DataFrame, start, depth: int, limit: int = 10, factor: Column | None = None, width: int = 10_000) -> DataFrame:
    """(node, value, hops, nodes, edge_ids, score): the best paths from start to nodes that have the goal's property.

    edges: (id, src, dst), walked in both directions, none twice; goals: (node,
    value), nulls are no goal; factor: score of an edge, at most 1, the score
    of a path is their product. Open paths are expanded best first, `width` at
    a time, and dropped once they cannot beat the last of `limit` goals found;
    the search ends when none is left, so the result is exact. Equal scores go
    by edge ids.
    """
    weight = factor if factor is not None else F.coalesce("confidence", F.lit(0.5))
    one = edges.select(F.col("id").alias("e_id"), F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), weight.cast("double").alias("e_w"))
    e = stored(one.unionByName(one.select("e_id", F.col("e_dst").alias("e_src"), F.col("e_src").alias("e_dst"), "e_w")).dropDuplicates(["e_id", "e_src"]))
    if e.where("e_w > 1").count():
        raise ValueError("scores of edges are at most 1")
    goal = goals.where("value IS NOT NULL").select("node", "value")
    order = [F.desc("score"), F.asc("path")]
    path_text = F.array_join(F.col("edge_ids").cast("array<string>"), ",")
    open_ = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("hops"), F.array(F.lit(start)).alias("nodes"), F.array().cast("array<bigint>").alias("edge_ids"), F.lit(1.0).alias("score"), F.lit("").alias("path"))
    best = None
    while True:
        taken = stored(open_.orderBy(*order).limit(width))
        last = taken.agg(F.count("*").alias("n"), F.min(F.struct((F.col("score")).alias("s"), "path")).alias("x"), F.min("score").alias("least")).first()
        if not last["n"]:
            break
        step = taken.where(F.col("hops") < depth).join(e, F.col("node") == F.col("e_src")).where(~F.array_contains("edge_ids", F.col("e_id")))
        step = step.select(F.col("e_dst").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("nodes", F.array("e_dst")).alias("nodes"), F.concat("edge_ids", F.array(F.col("e_id").cast("bigint"))).alias("edge_ids"), (F.col("score") * F.col("e_w")).alias("score"))
        new = stored(step.withColumn("path", path_text))
        found = new.join(goal, "node")
        best = stored((found if best is None else best.unionByName(found)).orderBy(*order).limit(limit))
        bar = best.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        # what was not taken comes after the last taken one in the order
        cutoff = taken.where(F.col("score") == last["least"]).agg(F.max("path").alias("path")).first()["path"]
        rest = open_.where((F.col("score") < last["least"]) | ((F.col("score") == last["least"]) & (F.col("path") > cutoff)))
        left = rest.unionByName(new.where(F.col("hops") < depth))
        open_ = stored(left.where(F.col("score") >= bar["least"]) if bar["n"] >= limit else left)
    if best is None:
        best = open_.join(goal, "node")
    return best.select("node", "value", "hops", "nodes", "edge_ids", "score")
