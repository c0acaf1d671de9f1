"""Graph operators: driver loops of one join per level over edge tables.

Each round is written to the shared folder, so plans stay as short as one round and a lost executor costs one at most.
No join of rows of a graph is a broadcast: a table that is just small enough for one goes through the driver each round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.storage import written

#: So many rounds' tables are read together before they are written as one.
ROUNDS = 8
#: Cycles are found by paths as long as a step of doubling makes no more than so many, by colours beyond it.
PATHS = 1_000_000


def _joined(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join through the shuffle, whatever the sizes."""
    return left.join(right.hint("merge"), on, how)


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots: node; edges: src, dst. Every node reachable from a root, roots included, once."""
    edges = edges.select("src", "dst")
    seen = frontier = written(roots.select("node").distinct())
    turn = 0
    while not frontier.isEmpty():
        step = _joined(frontier, edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(_joined(step, seen, "node", "left_anti"))
        seen = seen.unionByName(frontier)
        turn += 1
        if turn % ROUNDS == 0:
            seen = written(seen)
    return seen


def cycle_members(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Nodes that reach themselves; with roots, only what they reach.

    By paths of doubled length in few rounds, where these are few; in large graphs by colours, where no round holds more
    rows than there are edges. Both are exact."""
    if roots is not None:
        live = closure(roots, edges)
        edges = _joined(edges, live, edges["src"] == live["node"], "left_semi")
    rest = _trimmed(edges.select("src", "dst").distinct())
    paths, n = rest, -1
    while True:
        come, go = (paths.groupBy(F.col(end).alias("node")).agg(F.count("*").alias(n)) for end, n in (("dst", "come"), ("src", "go")))
        ends = _joined(come, go, "node")
        if (ends.agg(F.sum(F.col("come").cast("double") * F.col("go"))).first()[0] or 0) > PATHS:
            return _cycle_members_by_colour(rest)
        hop = _joined(paths, paths.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        paths = written(paths.unionByName(hop).distinct())
        if (size := paths.count()) == n:
            return paths.where("src = dst").select(F.col("src").alias("node"))
        n = size


def _cycle_members_by_colour(edges: DataFrame) -> DataFrame:
    """Each node gets the greatest node that reaches it as its colour. A node of its own colour with a way in from that
    colour is on a cycle, and so is all that reaches it within the colour. What is left is coloured again."""
    found = edges.where("src = dst").select(F.col("src").alias("node"))
    rest = _trimmed(edges.where("src != dst"))
    while not rest.isEmpty():
        colours = _colours(rest)
        inside = _joined(rest, colours.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src")
        inside = _joined(inside, colours.select(F.col("node").alias("dst"), "colour"), "dst").where("c = colour")
        inside = written(inside.select("src", "dst", "colour"))
        heads = inside.where("dst = colour").select(F.col("dst").alias("node"))
        ring = closure(heads, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = found.unionByName(ring)
        rest = _joined(_joined(inside, ring, inside["src"] == ring["node"], "left_anti"), ring, inside["dst"] == ring["node"], "left_anti")
        rest = _trimmed(rest.select("src", "dst"))
    return found.distinct()


def _colours(edges: DataFrame) -> DataFrame:
    """node, colour: the greatest node that reaches it, itself included. Only nodes that changed are sent on."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    colours = frontier = written(nodes.select("node", F.col("node").alias("colour")))
    turn = 0
    while not frontier.isEmpty():
        step = _joined(frontier, edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("colour"))
        old = colours.groupBy("node").agg(F.max("colour").alias("old"))
        frontier = written(_joined(step, old, "node").where("colour > old").select("node", "colour"))
        colours = colours.unionByName(frontier)
        turn += 1
        if turn % ROUNDS == 0:
            colours = written(colours.groupBy("node").agg(F.max("colour").alias("colour")))
    return written(colours.groupBy("node").agg(F.max("colour").alias("colour")))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without nodes that have no way in or no way out, which are on no cycle: what is left is small in most graphs."""
    edges = written(edges)
    n = edges.count()
    while True:
        edges = _joined(edges, edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = _joined(edges, edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        edges = written(edges)
        if (size := edges.count()) == n:
            return edges
        n = size


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """A shortest cycle through each node that is on one: start, length, nodes (from start, start not repeated); with
    max_length, only cycles of at most so many nodes. Equal cycles appear once, from their smallest node; ties go to the smaller path."""
    edges = edges.select("src", "dst").distinct()
    members = cycle_members(edges)
    inner = _joined(edges, members.withColumnRenamed("node", "src"), "src", "left_semi")
    inner = written(_joined(inner, members.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    open_ = inner.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("nodes"))
    found, turn = None, 0
    while max_length is None or turn < max_length:
        turn += 1
        open_ = written(open_.groupBy("start", "at").agg(F.min("nodes").alias("nodes")))
        closed = open_.where("start = at").select("start", F.size("nodes").alias("length"), "nodes")
        found = closed if found is None else found.unionByName(closed)
        rest = _joined(open_, closed.select("start"), "start", "left_anti").where(~F.array_contains("nodes", F.col("at")))
        if rest.isEmpty():
            break
        open_ = _joined(rest, inner, rest["at"] == inner["src"]).select("start", F.col("dst").alias("at"), F.concat("nodes", F.array("at")).alias("nodes"))
    least = F.array_min("nodes")
    turned = F.concat(F.slice("nodes", F.array_position("nodes", least).cast("int"), F.size("nodes")), F.slice("nodes", 1, F.array_position("nodes", least).cast("int") - 1))
    return found.select(least.alias("start"), "length", turned.alias("nodes")).distinct()


def distances_to(target: int, links: DataFrame, redirects: DataFrame) -> DataFrame:
    """node, dist, parent: the least number of links to the target; a link of a redirect page costs nothing. links: src, dst;
    redirects: page_id."""
    cost = _joined(links, redirects.select(F.col("page_id").alias("src"), F.lit(0).alias("cost")), "src", "left").select("src", "dst", F.coalesce("cost", F.lit(1)).alias("cost"))
    cost = written(cost)
    spark = links.sparkSession
    best = spark.range(1).select(F.lit(target).cast("long").alias("node"), F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("parent"))
    best = frontier = written(best)
    turn = 0
    least = F.min(F.struct("dist", "parent")).alias("s")
    while not frontier.isEmpty():
        step = _joined(frontier, cost, frontier["node"] == cost["dst"]).select(F.col("src").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("dst").alias("parent"))
        step = step.groupBy("node").agg(least).select("node", "s.dist", "s.parent")
        old = best.groupBy("node").agg(F.min("dist").alias("old"))
        frontier = written(_joined(step, old, "node", "left").where("old is null or dist < old").select("node", "dist", "parent"))
        best = best.unionByName(frontier)
        turn += 1
        if turn % ROUNDS == 0:
            best = written(best.groupBy("node").agg(least).select("node", "s.dist", "s.parent"))
    return written(best.groupBy("node").agg(least).select("node", "s.dist", "s.parent"))


def furthest(target: int, links: DataFrame, redirects: DataFrame) -> DataFrame:
    """node, dist of all nodes at the greatest distance to the target."""
    dist = distances_to(target, links, redirects)
    return dist.join(F.broadcast(dist.agg(F.max("dist").alias("most"))), dist["dist"] == F.col("most")).select("node", "dist")


def paths_to(target: int, links: DataFrame, redirects: DataFrame) -> DataFrame:
    """node, dist, path (from the node to the target) of the furthest nodes: their parents, level by level."""
    dist = distances_to(target, links, redirects)
    most = dist.agg(F.max("dist")).first()[0] or 0
    ends = dist.where(F.col("dist") == most).select("node", "dist", F.array("node").alias("path"), F.col("parent").alias("at"), F.col("dist").alias("height"))
    parents = dist.select(F.col("node").alias("at"), F.col("parent").alias("up"), F.col("dist").alias("own"))
    paths = written(ends)
    while True:
        # A parent is as far as its child or one step nearer, so each level looks only at nodes of its own distances.
        low, high = paths.where("at is not null").agg(F.min("height"), F.max("height")).first()
        if low is None:
            break
        step = _joined(paths, parents.where(F.col("own").between(low - 1, high)), "at", "left")
        paths = written(step.select("node", "dist", F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat("path", F.array("at"))).alias("path"), F.col("up").alias("at"), F.coalesce("own", "height").alias("height")))
    return paths.select("node", "dist", "path")


def longest_shortest_paths(links: DataFrame, redirects: DataFrame, max_nodes: int = 2000, weights: str = "hops") -> DataFrame:
    """src, dst, dist, path: all pairs at the greatest finite distance. For small graphs; a larger one raises.

    weights: hops (a redirect's link costs 0, others 1) or legacy (the other way round)."""
    nodes = links.select(F.col("src").alias("n")).union(links.select("dst")).distinct()
    if (n := nodes.count()) > max_nodes:
        raise ValueError(f"{n} nodes; all pairs are for {max_nodes} at most")
    free, paid = (0, 1) if weights == "hops" else (1, 0)
    cost = links.select("src", "dst").distinct().join(redirects.select(F.col("page_id").alias("src"), F.lit(free).alias("c")), "src", "left").select("src", "dst", F.coalesce("c", F.lit(paid)).cast("long").alias("c"))
    cost = written(cost)
    best = written(cost.where("src != dst").select("src", "dst", F.col("c").alias("dist"), F.array("src", "dst").alias("path")))
    while True:
        grown = best.join(cost.select(F.col("src").alias("dst"), F.col("dst").alias("far"), "c"), "dst").where("src != far")
        grown = grown.select("src", F.col("far").alias("dst"), (F.col("dist") + F.col("c")).alias("dist"), F.concat("path", F.array("far")).alias("path"))
        new = best.unionByName(grown).groupBy("src", "dst").agg(F.min(F.struct("dist", F.size("path").alias("hops"), "path")).alias("s")).select("src", "dst", "s.dist", "s.path")
        new = written(new)
        if new.join(best.select("src", "dst", F.col("dist").alias("old")), ["src", "dst"], "left").where("old is null or old > dist").isEmpty():
            most = new.agg(F.max("dist").alias("most"))
            return new.join(F.broadcast(most), new["dist"] == F.col("most")).select("src", "dst", "dist", "path")
        best = new


def reverse_links(links: DataFrame, pages: DataFrame, ns: int = 0) -> DataFrame:
    """dst, src: links between pages of one namespace, by target."""
    inside = pages.where(F.col("ns") == ns).select("page_id")
    found = links.join(inside.withColumnRenamed("page_id", "src"), "src", "left_semi").join(inside.withColumnRenamed("page_id", "dst"), "dst", "left_semi")
    return found.select("dst", "src").distinct()
