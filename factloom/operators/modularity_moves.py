"""Leiden communities of graphs of any size: local moves, refinement and contraction as joins and aggregates.

All nodes weigh their moves at once. Two rules keep such moves sound: communities stand in an order that is drawn anew for every two
rounds, and nodes move up it in one and down in the other, so two nodes never swap places; and a round that lowers modularity, as when too
many nodes crowd into one community, is undone and tried again with half as many movers. Refinement starts each node of a community by
itself and lets single nodes join a neighbouring part, but never a node that moves itself, so
parts always hang together. Parts become the nodes of the next level, which start out in
the communities found so far. State is settled every round; the driver sees a few numbers, and tables of nodes are
merged by sorting, as a round would else send them through the driver again (only the graphs' masses, a row each, may be broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.shared import forget, settle, sorted_join

_EPS = 1e-9
_ID = ["g", "node"]


def _rank(label: Column, turn: int) -> Column:
    up = F.xxhash64(label, F.lit(turn // 2))
    return up if turn % 2 else F.bitwise_not(up)


def _score(around: DataFrame, labels: DataFrame, mass: DataFrame, resolution: float) -> float:
    """Modularity summed over the graphs, each weighing by its edges' share in itself."""
    none = F.lit(0.0)
    inside = around.filter("c = own").select("g", F.col("w").alias("inside"), none.alias("t2"))
    loops = labels.select("g", F.col("loop").alias("inside"), none.alias("t2"))
    spread = labels.groupBy("g", "c").agg(F.sum("k").alias("t")).select("g", none.alias("inside"), (F.col("t") * F.col("t")).alias("t2"))
    per = inside.unionByName(loops).unionByName(spread).groupBy("g").agg(F.sum("inside").alias("inside"), F.sum("t2").alias("t2")).join(mass, "g")
    return per.agg(F.sum(F.col("inside") / F.col("m2") - resolution * F.col("t2") / F.col("m2") / F.col("m2"))).first()[0] or 0.0


def _around(near: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, node, c, w, own): the weight of each node's links into each community around it."""
    met = near.filter("u != v").join(sorted_join(labels.select("g", F.col("node").alias("v"), "c")), ["g", "v"]).groupBy("g", F.col("u").alias("node"), "c").agg(F.sum("w").alias("w"))
    return settle(met.join(sorted_join(labels.select("g", "node", F.col("c").alias("own"))), _ID), "around")


def _moves(near: DataFrame, labels: DataFrame, mass: DataFrame, resolution: float, tolerance: float, rounds: int) -> DataFrame:
    """labels (g, node, k, loop, c) after local moves that raise modularity."""
    around = _around(near, labels)
    score = _score(around, labels, mass, resolution)
    share, quiet = 0, 0
    for turn in range(rounds):
        tot = labels.groupBy("g", "c").agg(F.sum("k").alias("t"))
        part = around.filter("c != own").join(sorted_join(tot), ["g", "c"]).join(sorted_join(labels.select("g", "node", "k")), _ID).join(mass, "g")
        gain = F.col("w") - resolution * F.col("k") * F.col("t") / F.col("m2")
        best = part.groupBy("g", "node").agg(F.min(F.struct((-gain).alias("loss"), F.col("c").alias("to"))).alias("b"))
        kept = around.filter("c = own").select("g", "node", F.col("w").alias("w_own"))
        mine = labels.join(sorted_join(best), _ID).join(sorted_join(kept), _ID, "left").join(sorted_join(tot.select("g", "c", "t")), ["g", "c"]).join(mass, "g")
        stay = F.coalesce("w_own", F.lit(0.0)) - resolution * F.col("k") * (F.col("t") - F.col("k")) / F.col("m2")
        want = -F.col("b.loss") > stay + _EPS
        now = want & (_rank(F.col("c"), turn) < _rank(F.col("b.to"), turn)) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << share)) == 0)
        asked = settle(mine.select("g", "node", want.alias("want"), F.when(now, F.col("b.to")).alias("to")), "moves")
        wanting, moving = asked.agg(F.count_if("want"), F.count("to")).first()
        if not wanting:
            break
        if not moving:
            continue
        moved = settle(labels.join(sorted_join(asked.filter("to is not null").select("g", "node", "to")), _ID, "left").select("g", "node", "k", "loop", F.coalesce("to", "c").alias("c")), "labels")
        then = _around(near, moved)
        after = _score(then, moved, mass, resolution)
        if after < score:
            forget(then, moved)
            share += 1
            continue
        forget(around, asked)
        quiet = quiet + 1 if after - score < tolerance else 0
        labels, around, score, share = moved, then, after, max(share - 1, 0)
        if quiet > 1:
            break
    return labels


def _refine(near: DataFrame, labels: DataFrame, mass: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """labels with s: the part of its community that a node belongs to."""
    ends = labels.select("g", "node", "c")
    inner = near.filter("u != v").join(sorted_join(ends.toDF("g", "u", "c")), ["g", "u"]).join(sorted_join(ends.toDF("g", "v", "cv")), ["g", "v"]).filter("c = cv").select("g", "u", "v", "w")
    inner = settle(inner, "inner")
    parts = labels.withColumn("s", F.col("node"))
    for turn in range(rounds):
        size = parts.groupBy("g", "s").agg(F.sum("k").alias("t"), F.count("*").alias("n"))
        alone = parts.join(sorted_join(size.filter("n = 1").select("g", "s")), ["g", "s"], "left_semi").select("g", "node", "k")
        met = inner.join(sorted_join(parts.select("g", F.col("node").alias("v"), "s")), ["g", "v"]).join(sorted_join(alone.select("g", F.col("node").alias("u"))), ["g", "u"], "left_semi")
        met = met.filter("s != u").groupBy("g", F.col("u").alias("node"), "s").agg(F.sum("w").alias("w"))
        gain = F.col("w") - resolution * F.col("k") * F.col("t") / F.col("m2")
        best = met.join(sorted_join(size.select("g", "s", "t")), ["g", "s"]).join(sorted_join(alone), _ID).join(mass, "g").groupBy("g", "node").agg(F.min(F.struct((-gain).alias("loss"), F.col("s").alias("to"))).alias("b")).filter(-F.col("b.loss") > _EPS)
        wish = settle(best.select("g", "node", F.col("b.to").alias("to")), "wishes")
        # of two single nodes the lower one in this round's order may move; nobody joins a node that moves itself
        theirs = lambda df, *more: sorted_join(df.select("g", F.col("node").alias("to"), *more))
        lower = F.xxhash64("node", F.lit(turn)) < F.xxhash64("to", F.lit(turn))
        may = wish.join(theirs(wish, F.lit(True).alias("wishing")), ["g", "to"], "left").select("g", "node", "to", (F.col("wishing").isNull() | lower).alias("may"))
        now = F.col("may") & ~F.coalesce("leaving", F.lit(False))
        asked = settle(may.join(theirs(may, F.col("may").alias("leaving")), ["g", "to"], "left").select("g", "node", F.when(now, F.col("to")).alias("to")), "joins")
        wanting, moving = asked.agg(F.count("*"), F.count("to")).first()
        if not wanting:
            break
        if moving:
            parts = settle(parts.join(sorted_join(asked.filter("to is not null").select("g", "node", "to")), _ID, "left").select("g", "node", "k", "loop", "c", F.coalesce("to", "s").alias("s")), "parts")
    return parts


def communities(edges: DataFrame, by: str | None = None, resolution: float = 1.0, tolerance: float = 1e-4, rounds: int = 12, levels: int = 30) -> DataFrame:
    """(by, node, component): Leiden groups of the undirected graph of ``edges`` (src, dst), of each ``by`` apart if given.

    A group is named by its least node and hangs together. Loops, repeated edges and edges with a null end say nothing; nodes without
    an edge are in no group; no edges, no rows. The result depends on the edges only. ``tolerance``: what two
    rounds in a row must add to modularity for a level to go on; ``rounds`` bounds the moves of a level.
    """
    key = F.col(by) if by else F.lit(0)
    e = edges.select(key.alias("g"), F.col("src").alias("u"), F.col("dst").alias("v")).filter("u != v and g is not null")
    first = near = settle(e.union(e.select("g", "v", "u")).distinct().withColumn("w", F.lit(1.0)), "near")
    mass = settle(near.groupBy("g").agg(F.sum("w").alias("m2")), "mass")
    nodes = lambda near: near.groupBy("g", F.col("u").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("loop"))
    labels = settle(nodes(near).withColumn("c", F.col("node")), "labels")
    member = None
    for _ in range(levels):
        labels = _moves(near, labels, mass, resolution, tolerance, rounds)
        parts = settle(_refine(near, labels, mass, resolution, rounds), "parts")
        n, groups, merged = parts.agg(F.count("*"), F.count_distinct("g", "c"), F.count_distinct("g", "s")).first()
        down = parts.select("g", "node", "s", "c")
        member = down if member is None else settle(member.select("g", F.col("node").alias("x"), F.col("s").alias("node")).join(sorted_join(down), _ID).select("g", F.col("x").alias("node"), "s", "c"), "member")
        if merged == n or groups == n:
            break
        to = parts.select("g", "node", "s")
        near = near.join(sorted_join(to.toDF("g", "u", "su")), ["g", "u"]).join(sorted_join(to.toDF("g", "v", "sv")), ["g", "v"]).groupBy("g", F.col("su").alias("u"), F.col("sv").alias("v")).agg(F.sum("w").alias("w"))
        near = settle(near, "near")
        start = parts.groupBy("g", F.col("s").alias("node")).agg(F.min("c").alias("c"))
        labels = settle(nodes(near).join(sorted_join(start), _ID), "labels")
    # moves of whole parts may leave a group in pieces: each piece is a group, and modularity only gains by that
    ends = member.select("g", "node", "c")
    kept = first.join(sorted_join(ends.toDF("g", "u", "c")), ["g", "u"]).join(sorted_join(ends.toDF("g", "v", "cv")), ["g", "v"]).filter("c = cv").select("g", "u", "v")
    out = _pieces(kept, ends)
    name = [F.col("g").alias(by)] if by else []
    return out.select(*name, "node", "component")


def _pieces(inner: DataFrame, ends: DataFrame, rounds: int = 60) -> DataFrame:
    """(g, node, component): the least node that each node reaches over inner edges (both ways)."""
    inner = settle(inner, "kept")
    labels = settle(ends.select("g", "node", F.col("node").alias("label")), "pieces")
    for _ in range(rounds):
        around = inner.join(sorted_join(labels.select("g", F.col("node").alias("v"), "label")), ["g", "v"]).groupBy("g", F.col("u").alias("node")).agg(F.min("label").alias("m"))
        least = labels.join(sorted_join(around), _ID, "left").select("g", "node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = least.select("g", F.col("node").alias("label"), F.col("label").alias("further"))
        new = settle(least.join(sorted_join(jump), ["g", "label"]).select("g", "node", F.least("label", "further").alias("label"), "old"), "pieces")
        if new.filter("label != old").isEmpty():
            break
        labels = new.select("g", "node", "label")
    else:
        raise RuntimeError(f"pieces did not settle in {rounds} rounds")
    return labels.select("g", "node", F.col("label").alias("component"))
