"""Communities of the entity graph: components, modularity, label propagation, topic nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import cluster_name
from factloom.operators import modularity_moves
from factloom.operators.dealt import meet, pairs
from factloom.operators.graph import undirected
from factloom.shared import settle, sorted_join


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the least node reachable without regard to direction.

    Each round hands every node the least label around it and then that label's own label, so path
    lengths halve. Labels are settled each round; the driver sees one count.
    """
    near = settle(undirected(edges), "near")
    labels = settle(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    for _ in range(rounds):
        around = near.join(sorted_join(labels), near["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        nearest = labels.join(sorted_join(around), labels["node"] == around["u"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = nearest.select(F.col("node").alias("j"), F.col("label").alias("jl"))
        new = settle(nearest.join(sorted_join(jump), nearest["label"] == jump["j"]).select("node", F.least("label", "jl").alias("label"), "old"), "labels")
        if new.filter("label != old").limit(1).count() == 0:
            break
        labels = new.select("node", "label")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 60, tolerance: float = 0.0) -> DataFrame:
    """(node, component) by propagation: the label most frequent around a node and on itself, least on ties.

    Nodes take turns by a coin of the round, so two sides of a graph cannot swap labels for ever; it ends when no node would change
    (or at most a share of ``tolerance`` of them), and says so if ``rounds`` don't reach that.
    """
    near = settle(undirected(edges), "near")
    labels = settle(near.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    n = labels.count()
    for i in range(rounds):
        seen = near.join(sorted_join(labels), near["v"] == labels["node"]).select("u", "label").union(labels.select("node", "label"))
        best = seen.groupBy("u", "label").agg(F.count("*").alias("n")).groupBy("u").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        turn = F.pmod(F.xxhash64("node", F.lit(i // 2)) + F.lit(i % 2), F.lit(2)) == 0
        wish = labels.join(sorted_join(best.select(F.col("u").alias("node"), F.col("b.label").alias("wish"))), "node")
        moved = settle(wish.select("node", F.when(turn, F.col("wish")).otherwise(F.col("label")).alias("label"), (F.col("wish") != F.col("label")).alias("open")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("open").count() <= tolerance * n:
            break
    else:
        raise RuntimeError(f"labels did not settle in {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))


def leiden(edges: DataFrame, by: str = "document_id", resolution: float = 1.0) -> DataFrame:
    """(by, node, component): as ``louvain``, but each level refines its groups before it merges them, so every group hangs together."""
    return louvain(edges, by, resolution, refine=True)


def _refined(links: list[dict[int, float]], own: list[int], degree: list[float], total: float, resolution: float) -> list[int]:
    """Groups cut into parts: single nodes of a group join, in order, the neighbouring part of their group with the largest gain."""
    part, weight, alone = list(range(len(links))), degree[:], [True] * len(links)
    for i, x in enumerate(links):
        if not alone[i]:
            continue
        around: dict[int, float] = {}
        for j, w in x.items():
            if j != i and own[j] == own[i]:
                around[part[j]] = around.get(part[j], 0.0) + w
        best = min(around, key=lambda c: (resolution * weight[c] * degree[i] / total - around[c], c), default=None)  # noqa: B023
        if best is not None and best != part[i] and around[best] - resolution * weight[best] * degree[i] / total > 1e-12:
            weight[best] += degree[i]
            weight[part[i]] -= degree[i]
            alone[best] = False
            part[i] = best
    return part


def louvain(edges: DataFrame, by: str = "document_id", resolution: float = 1.0, refine: bool = False) -> DataFrame:
    """(by, node, component): modularity by local moves, level by level, per document graph.

    A document's graph is small and the moves depend on their order, so it runs in ``applyInPandas``.
    """
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["u"]) | set(pdf["v"]))
        at = {n: i for i, n in enumerate(names)}
        links: list[dict[int, float]] = [{} for _ in names]
        for u, v in zip(pdf["u"], pdf["v"], strict=True):
            links[at[u]][at[v]] = 1.0
        member = list(range(len(names)))
        start = list(range(len(names)))
        while True:
            n = len(links)
            degree = [sum(x.values()) + x.get(i, 0.0) for i, x in enumerate(links)]
            total = sum(degree) or 1.0
            own, weight, moved_any, moved = start, [0.0] * n, False, True
            for i, c in enumerate(own):
                weight[c] += degree[i]
            while moved:
                moved = False
                for i in range(n):
                    around: dict[int, float] = {}
                    for j, w in links[i].items():
                        if j != i:
                            around[own[j]] = around.get(own[j], 0.0) + w
                    weight[own[i]] -= degree[i]
                    gain = lambda c: around.get(c, 0.0) - resolution * weight[c] * degree[i] / total  # noqa: B023, E731
                    best = min(around, key=lambda c: (-gain(c), c), default=own[i])
                    if best != own[i] and gain(best) > gain(own[i]) + 1e-12:
                        own[i], moved, moved_any = best, True, True
                    weight[own[i]] += degree[i]
            if not moved_any:
                member = [own[m] for m in member]
                break
            parts = _refined(links, own, degree, total, resolution) if refine else own
            new = {c: k for k, c in enumerate(dict.fromkeys(parts))}
            if len(new) == n:  # nothing merges any more
                member = [own[m] for m in member]
                break
            group = {new[p]: c for p, c in zip(parts, own, strict=True)}
            first_of: dict[int, int] = {}
            start = [first_of.setdefault(group[k], k) for k in range(len(new))]
            member = [new[parts[m]] for m in member]
            merged: list[dict[int, float]] = [{} for _ in new]
            for i, x in enumerate(links):
                for j, w in x.items():
                    a, b = new[parts[i]], new[parts[j]]
                    merged[a][b] = merged[a].get(b, 0.0) + (w if a != b or i == j else w / 2)
            links = merged
        first: dict[int, str] = {}
        for name, m in zip(names, member, strict=True):
            first.setdefault(m, name)
        return pd.DataFrame({by: pdf[by].iloc[0], "node": names, "component": [first[m] for m in member]})

    e = edges.select(by, F.col("src").alias("u"), F.col("dst").alias("v")).filter("u != v")
    both = e.union(e.select(by, "v", "u")).distinct()
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return both.groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, node {kinds['u']}, component {kinds['u']}")


def keep_large(members: DataFrame, least: int = 3) -> DataFrame:
    """Members of groups of at least ``least``, with a sequential community id over the kept ones, in order of their first member."""
    size = members.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("first")).filter(F.col("size") >= least)
    # one order over all kept groups, without one task for them: ranges are numbered apart and moved by the counts before them
    ranges = settle(size.repartitionByRange("first").withColumn("_p", F.spark_partition_id()), "ranges")
    counts = [(r["_p"], r["n"]) for r in ranges.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()]  # one row a partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    moved = members.sparkSession.createDataFrame(offsets, "_p int, _o long")
    at = F.row_number().over(Window.partitionBy("_p").orderBy("first"))
    ids = ranges.withColumn("_n", at).join(F.broadcast(moved), "_p").withColumn("community", F.col("_n") - 1 + F.col("_o"))
    return members.join(ids.select("component", F.format_string("community_%d", "community").alias("community_id"), "size"), "component").select("community_id", "node", "size")


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the sum over groups of internal edges / m - (degrees / 2m) squared, on undirected edges."""
    near = undirected(edges)
    m = members.select("node", "component")
    tagged = near.join(m.toDF("u", "cu"), "u").join(m.toDF("v", "cv"), "v")
    per = tagged.groupBy("cu").agg(F.sum((F.col("cu") == F.col("cv")).cast("long")).alias("inside2"), F.count("*").alias("degree"))
    total = per.agg(F.sum("degree").alias("two_m"))
    return per.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("inside2") / F.col("two_m") - F.pow(F.col("degree") / F.col("two_m"), 2)), 6).alias("modularity"))  # one row


def coverage(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, chunks): sorted distinct source chunks of a group's members."""
    rows = members.join(nodes.select(F.col("node_id").alias("node"), F.explode("source_chunk_ids").alias("chunk")), "node")
    return rows.groupBy("component").agg(F.array_sort(F.collect_set("chunk")).alias("chunks"))


def overlaps(covered: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, shared, weight): groups that share at least ``least`` chunks; weight is shared over the larger coverage.

    Exploded chunks meet in an equi-join, so groups without a common chunk never do; a chunk that very many groups cover is dealt.
    """
    rows = covered.select(F.col("component").alias("c"), F.size("chunks").alias("n"), F.explode("chunks").alias("chunk"))
    both = pairs(settle(rows, "covered"), ["chunk"], "c").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    return both.select("a", "b", "shared", (F.col("shared") / F.greatest("na", "nb")).alias("weight"))


def encompasses(covered: DataFrame, nodes: DataFrame, share: float = 0.5) -> DataFrame:
    """(src, dst, relation_type, confidence): topics (component, chunks) and the nodes (node_id, source_chunk_ids) that stand in at least ``share`` of their chunks; that share is the confidence.

    A node in m of a topic's n chunks stands in one of any n - m + 1 of them, so it is looked for in the rarest ones only; chunks that many
    topics or nodes have are dealt. Topics without chunks encompass nothing.
    """
    held = nodes.select(F.col("node_id").alias("dst"), F.explode("source_chunk_ids").alias("chunk"))
    return encompassed(covered.select(F.col("component").alias("src"), F.explode("chunks").alias("chunk")), held, share)


def encompassed(topics: DataFrame, held: DataFrame, share: float = 0.5) -> DataFrame:
    """As ``encompasses``, of topics (src, chunk) and nodes (dst, chunk) that are a row a chunk: no topic's or node's chunks are gathered anywhere. Rows may repeat."""
    topics = settle(topics.distinct(), "topics")
    held = settle(held.filter("chunk is not null").distinct(), "held")
    sizes = settle(topics.groupBy("src").agg(F.count("*").alias("n")), "sizes")
    rows = topics.join(held.groupBy("chunk").agg(F.count("*").alias("_held")), "chunk").join(sizes, "src")
    # chunks that no node has are the rarest, and gone by this join; so the last places are kept, counted from the most common one
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("_held"), "chunk"))
    least = F.ceil(F.round(F.lit(share) * F.col("n"), 9))
    ask = settle(rows.withColumn("_at", place).filter(F.col("_at") >= least).select("src", "chunk"), "asked")
    found = settle(meet(ask, held, ["chunk"]).select("src", "dst").distinct(), "found")
    # a found pair counts the chunks that both have: rows of the topics found, each met by its own node only
    both = found.join(topics, "src").join(held, ["dst", "chunk"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("m"))
    part = F.col("m") / F.col("n")
    return both.join(sizes, "src").select("src", "dst", F.lit("encompasses").alias("relation_type"), part.alias("confidence")).filter(F.col("confidence") >= share)


def integrate(nodes: DataFrame, members: DataFrame, covered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topic nodes on layer 1 with ``encompasses`` edges of confidence 1 to members, and ``related_to`` edges by overlap."""
    topics = members.groupBy("component").agg(F.count("*").alias("occurrence_count")).join(covered, "component", "left")
    topic_nodes = topics.select(F.col("component").alias("node_id"), F.lit(1).alias("layer"), F.lit("community_topic").alias("entity_type"), "occurrence_count", F.col("chunks").alias("source_chunk_ids"))
    known = members.join(nodes.select(F.col("node_id").alias("node")), "node", "left_semi")
    inside = known.select(F.col("component").alias("src"), F.col("node").alias("dst"), F.lit("encompasses").alias("relation_type"), F.lit(1.0).alias("confidence"))
    between = overlaps(covered).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("related_to").alias("relation_type"), F.col("weight").alias("confidence"))
    return topic_nodes, inside.unionByName(between)


def intra_edges(edges: DataFrame, members: DataFrame, most: int = 15) -> DataFrame:
    """Edges with both ends in one group, the ``most`` most confident of each."""
    m = members.select("node", "component")
    both = edges.join(m.toDF("src", "component"), "src").join(m.toDF("dst", "_c"), "dst").filter(F.col("component") == F.col("_c")).drop("_c")
    w = Window.partitionBy("component").orderBy(F.desc("confidence"), "src", "dst", "relation_type")
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def neighbours_text(edges: DataFrame) -> DataFrame:
    """(node, relations): the sorted strings of all edges at a node."""
    told = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.concat_ws(" ", "src", "relation_type", "dst").alias("t"))
    return told.groupBy("node").agg(F.array_sort(F.collect_set("t")).alias("relations"))


def cluster_corpus(edges: DataFrame, existing: DataFrame, least: int = 3, resolution: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, member) of a corpus graph (src, dst) and what becomes of them (cluster, target, action; see ``reconcile``).

    Leiden groups of the whole graph, by joins and aggregates whatever its size. Clusters under ``least`` members go.
    """
    found = settle(modularity_moves.communities(edges, resolution=resolution).select(F.col("component").alias("cluster"), F.col("node").alias("member")), "clusters")
    kept = found.join(found.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("cluster"), "cluster", "left_semi")
    return kept, reconcile(kept, existing)


def reconcile(clusters: DataFrame, existing: DataFrame) -> DataFrame:
    """(cluster, target, action): the known topic most members vote for (ties: least name) if votes >= size // 2, else a new one.

    clusters: cluster, member. existing: topic, member.
    """
    votes = clusters.join(existing, "member").groupBy("cluster", "topic").agg(F.count("*").alias("v"))
    best = votes.groupBy("cluster").agg(F.min(F.struct((-F.col("v")).alias("n"), "topic")).alias("b"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.collect_list("member").alias("members"))
    j = size.join(best, "cluster", "left")
    ok = F.col("b").isNotNull() & (-F.col("b.n") >= F.floor(F.col("size") / 2))
    return j.select("cluster", F.when(ok, F.col("b.topic")).otherwise(cluster_name(F.col("members"))).alias("target"), F.when(ok, "update").otherwise("create").alias("action"))
