"""Retrieval: query plans, vector search, personalised PageRank, budgets, context text. All work on batches of queries."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.operators.entities import slices
from factloom.operators.graph import undirected
from factloom.shared import settle


def query_type(query: Column) -> Column:
    """factual, relational, exploratory by most patterns (in this order on ties); conceptual without any; exploratory if empty."""
    q = F.trim(F.lower(query))
    score = lambda patterns: sum((q.rlike(p).cast("int") for p in patterns), F.lit(0))
    # each score is written once: repeated, the patterns outgrow what Spark compiles
    ranked = [F.struct(score(p).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, p) in enumerate((("factual", fixed.FACTUAL), ("relational", fixed.RELATIONAL), ("exploratory", fixed.EXPLORATORY)))]
    best = F.array_max(F.array(*ranked, F.struct(F.lit(1).alias("n"), F.lit(-9).alias("o"), F.lit("conceptual").alias("k"))))
    return F.when(q == "", "exploratory").otherwise(best["k"])


def plan(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Adds query_type, levels and estimated_token_cost."""
    out = queries.withColumn("query_type", query_type(F.col(query_col)))
    empty = F.trim(F.col(query_col)) == ""
    cost = {k: sum(fixed.LEVEL_COST[x] for x in ls) for k, ls in fixed.LEVELS.items()}
    by_type = lambda table, make: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), make(v))]), F.col("query_type"))
    return out.withColumns({
        "levels": F.when(empty, F.array(F.lit("community"))).otherwise(by_type(fixed.LEVELS, lambda v: F.array(*map(F.lit, v)))),
        "estimated_token_cost": F.when(empty, fixed.LEVEL_COST["community"]).otherwise(by_type(cost, F.lit)),
    })


def top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, small: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the k largest cosines for each query, ties to the least id.

    queries: query_id, embedding. vectors: id, embedding (filter them before: it reaches the scan).
    Query vectors are sent out in blocks of ``small``; each batch of vectors keeps only its own k best of
    each query (a partial aggregate), so what is shuffled doesn't grow with the product of the two sides.
    Exact, by all pairs; ``vectors.search`` takes its place where that is too many.
    """
    spark = queries.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // small))
    qid, vid = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    cut = queries.select("query_id", "embedding").withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = cut.filter(F.col("_b") == b).select("query_id", "embedding").toPandas()  # about ``small`` rows
        known = spark.sparkContext.broadcast((part["query_id"].to_numpy(), _unit(part["embedding"])))

        def search(batches, known=known):
            names, q = known.value
            for pdf in batches:
                if not len(pdf) or not len(names):
                    continue
                pdf = pdf.sort_values("id", ignore_index=True)
                ids, v = pdf["id"].to_numpy(), _unit(pdf["embedding"])
                for i, j in slices(len(q), len(v)):
                    sim = q[i:j] @ v.T
                    keep = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(names[i:j], keep.shape[1]), "id": ids[keep.ravel()], "score": np.take_along_axis(sim, keep, 1).ravel()})

        found = vectors.select("id", "embedding").mapInPandas(search, f"query_id {qid}, id {vid}, score double")
        out = found if out is None else out.unionByName(found)
    if least is not None:
        out = out.filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(column: pd.Series) -> np.ndarray:
    """Rows as unit vectors; no rows, no columns."""
    v = np.array(column.tolist(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)


def pagerank(edges: DataFrame, seeds: DataFrame, teleport: float = 0.15, rounds: int = 100, normalize: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """(node, score): personalised PageRank on undirected edges, uniform over the seeds (node) that are in the graph.

    Power iterations, settled every five: ``rounds`` of them at most, fewer where none of the last changed the
    scores by ``tolerance`` a node. Without a valid seed there is no row.
    Every node here has an edge, so no mass is lost at dangling ones. Scores are divided by the largest.
    """
    near = settle(undirected(edges), "near")
    degree = near.groupBy("u").agg(F.count("*").alias("d"))
    base = settle(degree.join(seeds.select(F.col("node").alias("u")).distinct().withColumn("s", F.lit(1.0)), "u", "left"), "seeds")
    n, k = base.agg(F.count("*"), F.sum("s")).first()
    if not k:
        return base.select(F.col("u").alias("node"), F.lit(0.0).alias("score")).limit(0)
    base = base.select("u", "d", (F.coalesce("s", F.lit(0.0)) / float(k)).alias("p"))
    score = base.select("u", F.lit(1.0 / n).alias("r"))
    before = score
    for i in range(rounds):
        spread = score.join(base, "u").select(F.col("u").alias("v"), (F.col("r") / F.col("d")).alias("w")).join(near, "v").groupBy("u").agg(F.sum("w").alias("w"))
        score = base.join(spread, "u", "left").select("u", (teleport * F.col("p") + (1 - teleport) * F.coalesce("w", F.lit(0.0))).alias("r"))
        if i % 5 == 4:
            score = settle(score, "ranks")
            moved = score.join(before.select("u", F.col("r").alias("was")), "u").agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0]
            if moved < n * tolerance:  # of five rounds together, so of each
                break
            before = score
    if normalize:
        top = score.agg(F.max("r").alias("top"))
        return score.crossJoin(F.broadcast(top)).select(F.col("u").alias("node"), (F.col("r") / F.col("top")).alias("score"))  # one row
    return score.select(F.col("u").alias("node"), F.col("r").alias("score"))


def query_pagerank(edges: DataFrame, seeds: DataFrame, teleport: float = 0.15, bound: float = 1e-4, rounds: int = 400) -> DataFrame:
    """(query_id, node, score): personalised PageRank of each query from its own seeds (query_id, node; nodes of the graph).

    Forward push: a query's mass starts as a residual at its seeds; a node whose residual is over ``bound`` times its degree keeps the
    teleport share of it and hands the rest to its neighbours. So a score (before it is divided by the query's largest) is at most ``bound`` times the
    degree below the exact one, and a query holds rows for 1 / (teleport * bound) links at most, whatever the size of the graph.
    All queries push at once; only nodes over their bound meet the edges.
    """
    near = undirected(edges)
    degree = settle(near.groupBy("u").agg(F.count("*").alias("d")), "degrees")
    near = settle(near.join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v"), "near")
    own = seeds.select("query_id", F.col("node").alias("u")).distinct().join(degree, "u")
    state = own.join(own.groupBy("query_id").agg(F.count("*").alias("k")), "query_id").select("query_id", "u", "d", F.lit(0.0).alias("p"), (1.0 / F.col("k")).alias("r"))
    state = settle(state, "pushed")
    over = F.col("r") > bound * F.col("d")
    for _ in range(0, rounds, 2):
        if state.filter(over).isEmpty():
            break
        for _ in range(2):
            handed = state.filter(over).join(near, "u").select("query_id", F.col("v").alias("u"), F.col("dv").alias("d"), F.lit(0.0).alias("p"), ((1 - teleport) * F.col("r") / F.col("d")).alias("r"))
            kept = state.select("query_id", "u", "d", F.when(over, F.col("p") + teleport * F.col("r")).otherwise(F.col("p")).alias("p"), F.when(over, 0.0).otherwise(F.col("r")).alias("r"))
            state = kept.unionByName(handed).groupBy("query_id", "u", "d").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
        state = settle(state, "pushed")
    else:
        raise RuntimeError(f"residuals did not settle in {rounds} rounds")
    kept = state.filter("p > 0")
    top = kept.groupBy("query_id").agg(F.max("p").alias("top"))
    return kept.join(top, "query_id").select("query_id", F.col("u").alias("node"), (F.col("p") / F.col("top")).alias("score"))


def seeds_of(results: DataFrame, nodes: DataFrame, most: int = 5, above: float = 0.3) -> DataFrame:
    """(query_id, node): the nodes among the first ``most`` results (in rank order), of those with a score above the limit."""
    first = results.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter((F.col("_r") <= most) & (F.col("score") > above))
    kind = nodes.schema["node_id"].dataType
    return first.select("query_id", F.col("id").cast(kind).alias("node")).join(nodes.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi")


def blend_scores(results: DataFrame, ppr: DataFrame, weight: float = 0.3) -> DataFrame:
    """score = weight * vector + (1 - weight) * PageRank (0 if unknown). ppr: node, score; with a query_id,
    each query has its own, and one without any (no valid seed) keeps its vector scores."""
    keyed = "query_id" in ppr.columns
    p = ppr.select(*(["query_id"] if keyed else []), F.col("node").cast(results.schema["id"].dataType).alias("id"), F.col("score").alias("_p"))
    blended = weight * F.col("score") + (1 - weight) * F.coalesce("_p", F.lit(0.0))
    if not keyed:
        return results.join(p, "id", "left").withColumn("score", blended).drop("_p")
    seeded = ppr.select("query_id").distinct().withColumn("_s", F.lit(True))
    out = results.join(p, ["query_id", "id"], "left").join(seeded, "query_id", "left")
    return out.withColumn("score", F.when(F.col("_s"), blended).otherwise(F.col("score"))).drop("_p", "_s")


def prune(results: DataFrame, level: str, k: int | None = None) -> DataFrame:
    """Scores under the level's limit go, the best k of each query stay, ranked."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return results.filter(F.col("score") >= fixed.PRUNE[level]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= (k or fixed.TOP_K[level]))


def needs_chunks(queries: DataFrame, entity_results: DataFrame, below: float = 0.6, order: str | None = None) -> DataFrame:
    """Queries whose entity scores average under the limit, or that have none.

    Scores are added as decimals, so a mean that is the limit itself is not under it, in whatever order rows come. A query with a
    score that is no such number (NaN, 1e20 or more) has its mean by doubles. With ``order`` (a column of entity_results, unique in a query)
    it is the mean of doubles added one after the other in that order, as an engine has it that reads rows so; only where rounding can decide, rows are put in order for it.
    """
    exact = F.col("score").try_cast("decimal(38,18)")
    sums = entity_results.groupBy("query_id").agg(F.sum(exact).alias("_t"), F.count(exact).alias("_m"), F.count("score").alias("_n"), F.avg("score").alias("_avg"), F.sum(F.abs("score")).alias("_size"))
    fits = (F.col("_m") == F.col("_n")) & F.col("_t").isNotNull()
    mean = F.when(fits, F.col("_t").cast("double") / F.col("_n")).otherwise(F.col("_avg"))
    limit = F.lit(Decimal(str(below))) * F.col("_n")
    under = F.when(fits, F.col("_t") < limit).otherwise(F.coalesce("_avg", F.lit(0.0)) < below)
    if order is None:
        known = sums.select("query_id", mean.alias("mean_score"), under.alias("_under"))
    else:
        # adding n doubles errs by less than n halves of the last place of their sizes' sum
        sums = settle(sums, "sums")
        open_ = (F.col("_n") > 0) & ~F.coalesce(fits & (F.abs(F.col("_t") - limit).cast("double") > F.col("_n") * 2.0**-50 * (F.col("_size") + F.abs(limit).cast("double"))), F.lit(False))
        w = Window.partitionBy("query_id").orderBy(order, "score")
        rows = entity_results.filter("score is not null").join(sums.filter(open_).select("query_id", "_n"), "query_id")
        added = rows.select("query_id", "_n", F.row_number().over(w).alias("_r"), (F.sum(F.col("score").cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_n")).alias("_mean")).filter("_r = _n")
        both = sums.join(added.select("query_id", "_mean"), "query_id", "left")
        in_order = F.col("_mean").isNotNull()
        known = both.select("query_id", F.when(in_order, F.col("_mean")).otherwise(mean).alias("mean_score"), F.when(in_order, F.col("_mean") < below).otherwise(under).alias("_under"))
    return queries.select("query_id").join(known, "query_id", "left").select("query_id", "mean_score", F.coalesce("_under", F.lit(0.0 < below)).alias("fallback"))


def fit_budget(results: DataFrame, tokens: int = fixed.CONTEXT_TOKENS) -> DataFrame:
    """(query_id, ord, source_type, content) that fit: rows in order while they do; the first that doesn't is cut if over 100 characters are left.

    Monotone, so a running sum decides.
    """
    budget = tokens * fixed.CHARS_PER_TOKEN
    w = Window.partitionBy("query_id").orderBy("ord")
    r = results.withColumn("_end", F.sum(F.length("content")).over(w)).withColumn("_start", F.col("_end") - F.length("content"))
    r = r.withColumn("_over", F.sum((F.col("_end") > budget).cast("int")).over(w)).filter("_over <= 1")
    left = budget - F.col("_start")
    r = r.filter((F.col("_over") == 0) | (left > 100))
    content = F.when(F.col("_over") == 0, F.col("content")).otherwise(F.concat(F.substring(F.col("content"), F.lit(1), left.cast("int")), F.lit("...")))
    return r.withColumn("content", content).drop("_end", "_start", "_over")


def assemble(fitted: DataFrame, blocks: DataFrame | None = None, tokens: int = fixed.CONTEXT_TOKENS) -> DataFrame:
    """(query_id, context, used_chars, tokens): headed parts for communities, corpus, entities, evidence, contradictions.

    blocks (query_id, corpus, contradictions): texts that are added whole, in this order, while they fit the budget.
    """
    part = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "content")))), lambda x: x["content"])
    kind = F.col("source_type")
    g = fitted.groupBy("query_id").agg(
        part(kind == "community_summary").alias("c"), part(kind.isin("entity_profile", "relation_profile")).alias("e"),
        part(~kind.isin("community_summary", "entity_profile", "relation_profile")).alias("k"), F.sum(F.length("content")).alias("used_chars"),
    )
    if blocks is None:
        g = g.withColumns({"corpus": F.lit(None).cast("string"), "contradictions": F.lit(None).cast("string")})
    else:
        g = g.join(blocks.select("query_id", "corpus", "contradictions"), "query_id", "full").withColumn("used_chars", F.coalesce("used_chars", F.lit(0)))
        for c in ("corpus", "contradictions"):
            size = F.length(F.nullif(F.col(c), F.lit("")))
            fits = F.col("used_chars") + size <= tokens * fixed.CHARS_PER_TOKEN
            g = g.withColumns({c: F.when(fits, F.col(c)), "used_chars": F.when(fits, F.col("used_chars") + size).otherwise(F.col("used_chars"))})
    text = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {head}\n"), F.array_join(c, "\n\n")))
    block = lambda head, c: F.concat(F.lit(f"## {head}\n"), F.col(c))
    context = F.concat_ws("\n\n", text("Document Context", "c"), block("Cross-Document Knowledge", "corpus"), text("Relevant Entities", "e"), text("Evidence", "k"), block("Contradictions", "contradictions"))
    return g.select("query_id", context.alias("context"), "used_chars", (F.col("used_chars") / fixed.CHARS_PER_TOKEN).cast("long").alias("tokens"))


def community_level(queries: DataFrame, vectors: DataFrame, search=top_k) -> DataFrame:
    """Results (query_id, ord, source_type, id, score) of the community summaries."""
    found = prune(search(queries, vectors, fixed.TOP_K["community"]), "community")
    return found.select("query_id", F.col("rank").alias("ord"), F.lit("community_summary").alias("source_type"), "id", "score")


def entity_level(queries: DataFrame, entities: DataFrame, relations: DataFrame, edges: DataFrame | None = None, k: int = fixed.TOP_K["entity"], weight: float = 0.3, search=top_k, bound: float = 1e-4) -> DataFrame:
    """Results of entity profiles and half as many relation profiles: blended by the query's PageRank, then pruned, ranked and cut."""
    found = search(queries, entities, k).withColumn("source_type", F.lit("entity_profile"))
    found = found.unionByName(search(queries, relations, k // 2).withColumns({"rank": F.col("rank") + k, "source_type": F.lit("relation_profile")}))
    if edges is not None:
        found = settle(found, "profiles")
        nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
        found = blend_scores(found, query_pagerank(edges, seeds_of(found, nodes), bound=bound), weight)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    cut = found.filter(F.col("score") >= fixed.PRUNE["entity"]).withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= k)
    return cut.select("query_id", "ord", "source_type", "id", "score")


def chunk_level(queries: DataFrame, vectors: DataFrame, search=top_k) -> DataFrame:
    found = prune(search(queries, vectors, fixed.TOP_K["chunk"]), "chunk")
    return found.select("query_id", F.col("rank").alias("ord"), F.lit("chunk").alias("source_type"), "id", "score")


def retrieve(queries: DataFrame, vectors: DataFrame, edges: DataFrame | None = None, corpus: dict[str, DataFrame] | None = None, tokens: int = fixed.CONTEXT_TOKENS, search=None, bound: float = 1e-4) -> DataFrame:
    """Context of each query (query_id, query, embedding) from vectors (id, level, embedding, content).

    Levels (community, entity, relation, chunk) are decided per query by its plan and applied as filters, so one plan serves a batch. The
    chunk level runs for queries whose entity results are weak; the corpus level, where ``corpus`` (cnodes, tnodes, xedges and, if any,
    contradictions: subject, severity, text) is given, starts from the first five entity results and the query's words. A level that no query asks for gives no rows.
    search: a function of (queries, vectors, k) as ``top_k``, which is exact by all pairs; by default ``vectors.search``, by inverted lists.
    bound: of ``query_pagerank``.
    """
    if search is None:
        from factloom.operators.vectors import search  # that module is built on this one
    planned = settle(plan(queries), "plans")
    ask = lambda level: planned.filter(F.array_contains("levels", level)).select("query_id", "embedding")
    of = lambda level: vectors.filter(F.col("level") == level)
    entity = settle(entity_level(ask("entity"), of("entity"), of("relation"), edges, search=search, bound=bound), "entities")
    weak = needs_chunks(planned, entity).filter("fallback").select("query_id")
    levels = [community_level(ask("community"), of("community"), search), entity, chunk_level(ask("chunk").join(weak, "query_id", "left_semi"), of("chunk"), search)]
    results = [r.withColumn("ord", F.col("ord") + 1000 * i) for i, r in enumerate(levels)]
    all_ = results[0].unionByName(results[1]).unionByName(results[2])
    blocks = None
    if corpus is not None:
        asking = planned.filter(F.array_contains("levels", "corpus")).select("query_id", "query")
        names = entity.filter("ord <= 5").groupBy("query_id").agg(F.collect_list(F.col("id").cast("string")).alias("names"))
        asking = asking.join(names, "query_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
        blocks = corpus_block(*corpus_context(asking, corpus["cnodes"], corpus["tnodes"], corpus["xedges"])).withColumnRenamed("text", "corpus")
        if "contradictions" in corpus:
            told = contradictions_block(asking.select("query_id", "names"), corpus["contradictions"], tokens)
            blocks = asking.select("query_id").join(blocks, "query_id", "left").join(told, "query_id", "left")
        else:
            blocks = blocks.withColumn("contradictions", F.lit(None).cast("string"))
    texts = vectors.select("id", "content")
    return assemble(fit_budget(all_.join(texts, "id"), tokens), blocks, tokens)


def keep_first(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None, by: str | None = None) -> DataFrame:
    """The first row of each key in the given order; of these the first ``most`` of each ``by``."""
    out = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    if most is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")
    return out


def corpus_context(queries: DataFrame, cnodes: DataFrame, tnodes: DataFrame, xedges: DataFrame, most_nodes: int = 20, most_edges: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per query (query_id, names array and, if there, query): canonical nodes by name or by one of the query's first five words,
    topics with a common member, cross edges at those nodes.

    cnodes: name. tnodes: topic, members. xedges: src, dst, relation_type, confidence. A node found by name comes before one found by
    a word (a word of its name, without regard to case), found twice it counts once; ``ord`` is its place.
    """
    asked = queries.select("query_id", F.posexplode("names").alias("ord", "name")).withColumn("way", F.lit(0))
    c = asked.join(cnodes, "name")
    if "query" in queries.columns:
        words = queries.select("query_id", F.posexplode(F.slice(F.split(F.trim(F.lower("query")), r"\s+"), 1, 5)).alias("ord", "word")).filter("word != ''")
        known = cnodes.withColumn("word", F.explode(F.array_distinct(F.split(F.lower("name"), r"[^\p{L}\p{N}]+")))).filter("word != ''")
        c = c.unionByName(words.join(known, "word").drop("word").withColumn("way", F.lit(1)))
    c = keep_first(c, ["query_id", "name"], ["way", "ord", "name"], most_nodes, "query_id")
    c = c.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("way", "ord", "name"))).drop("way")
    at = c.select("query_id", "name")
    t = tnodes.select("topic", F.explode("members").alias("name")).join(at, "name").select("query_id", "topic").distinct()
    x = xedges.withColumn("name", F.explode(F.array("src", "dst"))).join(at, "name").drop("name").distinct()
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "src", "dst", "relation_type"))).filter(F.col("_r") <= most_edges).drop("_r")
    return c, t.join(tnodes, "topic").select("query_id", "topic", "members"), x


def corpus_results(cnodes: DataFrame) -> DataFrame:
    """Canonical nodes of a query (name, entity_type, confidence, attributes) as results (query_id, ord, source_type, id, content, score)."""
    content = F.concat("name", F.lit(" ("), "entity_type", F.lit(")"), F.coalesce(F.concat(F.lit(" \u2014 "), F.nullif(F.col("attributes"), F.lit(""))), F.lit("")))
    return cnodes.select("query_id", "ord", F.lit("entity_profile").alias("source_type"), F.col("name").alias("id"), content.alias("content"), F.col("confidence").alias("score"))


def corpus_block(cnodes: DataFrame, tnodes: DataFrame, xedges: DataFrame) -> DataFrame:
    """(query_id, text): ten canonical nodes, five topics with five members, ten cross edges. cnodes also: entity_type, corroboration, attributes, documents."""
    n = fixed.CORPUS_BLOCK
    attributes = F.coalesce(F.concat(F.lit(" \u2014 "), F.nullif(F.col("attributes"), F.lit(""))), F.lit(""))
    c = cnodes.select("query_id", "ord", "documents", F.concat(F.lit("  - "), "name", F.lit(" ("), "entity_type", F.lit(", corroboration="), F.col("corroboration").cast("string"), F.lit(")"), attributes).alias("line"))
    c = c.groupBy("query_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("documents")))).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    lines = lambda col, most: F.transform(F.slice(col, 1, most), lambda x: x["line"])
    c = c.select("query_id", F.concat(F.array(F.concat(F.lit("Canonical entities from "), F.col("n").cast("string"), F.lit(" documents:"))), lines(F.col("l"), n["cnodes"])).alias("c"))
    t = tnodes.select("query_id", F.col("topic").alias("o"), F.concat(F.lit("  - "), "topic", F.lit(": "), F.array_join(F.slice("members", 1, n["members"]), ", ")).alias("line"))
    t = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("l")).select("query_id", F.concat(F.array(F.lit("Taxonomy categories:")), lines(F.col("l"), n["tnodes"])).alias("t"))
    x = xedges.select("query_id", (-F.col("confidence")).alias("o"), F.concat(F.lit("  - "), "src", F.lit(" \u2014["), "relation_type", F.lit("]\u2192 "), "dst", F.lit(" (conf="), F.format_number("confidence", 2), F.lit(")")).alias("line"))
    x = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("l")).select("query_id", F.concat(F.array(F.lit("Cross-document relations:")), lines(F.col("l"), n["xedges"])).alias("x"))
    none = F.array().cast("array<string>")
    all_ = c.join(t, "query_id", "full").join(x, "query_id", "full")
    return all_.select("query_id", F.array_join(F.concat(F.coalesce("c", none), F.coalesce("t", none), F.coalesce("x", none)), "\n").alias("text"))


def contradictions_block(queries: DataFrame, contradictions: DataFrame, tokens: int = fixed.CONTEXT_TOKENS) -> DataFrame:
    """(query_id, contradictions): lines on the entities that a query (query_id, names array) has found, high severity first, as many as fit the budget.

    contradictions: subject, severity, text. They meet the queries by subject, without regard to case, and only those of a query's own entities are ever
    together; a query without any has no row.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform("names", F.lower))).alias("_s"))
    met = asked.join(contradictions.select(F.lower("subject").alias("_s"), "severity", F.concat(F.lit("- "), "text").alias("line")), "_s").select("query_id", "severity", "line").distinct()
    grave = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    w = Window.partitionBy("query_id").orderBy("grave", "line")
    # lines and the breaks between them, in order, while they fit
    met = met.withColumn("grave", grave).withColumn("end", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).filter(F.col("end") <= tokens * fixed.CHARS_PER_TOKEN)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("grave", "line"))), lambda x: x["line"])
    return met.groupBy("query_id").agg(F.array_join(lines, "\n").alias("contradictions"))


def should_enrich(agent: str, enabled: bool, agents: set[str] | None = None) -> bool:
    """Whether an agent's prompt gets retrieved context: enriching is on and the agent is one of those that get it."""
    return enabled and agent in (agents or fixed.ENRICHED)


def derive_queries(state: DataFrame, agent: str) -> DataFrame:
    """Adds ``query``, what an agent searches for a document, from dense_summary, refine_summary, reference_titles, triplets (subject, object)."""
    head = F.nullif(F.substring("dense_summary", 1, 500), F.lit(""))
    titles = F.array_join(F.slice("reference_titles", 1, 5), ", ")
    named = F.flatten(F.transform(F.slice("triplets", 1, 20), lambda t: F.array(t["subject"], t["object"])))
    extra = {
        "decontextualizer": F.when(F.size("reference_titles") > 0, F.concat(F.lit("references: "), titles)),
        "concept_extractor": F.when(F.size("triplets") > 0, F.concat(F.lit("entities: "), F.array_join(F.slice(F.array_sort(F.array_distinct(named)), 1, 10), ", "))),
        "synthesizer": F.nullif(F.substring("refine_summary", 1, 300), F.lit("")),
        "reference_extractor": F.when(F.size("reference_titles") > 0, F.lit("citations bibliography references")),
    }.get(agent, F.lit(None).cast("string"))
    return state.withColumn("query", F.trim(F.concat_ws(" ", head, extra)))


def build_context(state: DataFrame, agent: str, embed, vectors: DataFrame, edges: DataFrame | None = None, corpus: dict[str, DataFrame] | None = None, enabled: bool = True, agents: set[str] | None = None, tokens: int = fixed.CONTEXT_TOKENS, search=None) -> DataFrame:
    """(document_id, query, context, tokens): what retrieval adds to an agent's prompt, for all documents of ``state`` at once.

    Documents without a query have a null context; an agent that isn't enriched gets no rows. embed: text column -> embedding column.
    """
    derived = derive_queries(state, agent).select("document_id", "query")
    if not should_enrich(agent, enabled, agents):
        return derived.withColumns({"context": F.lit(None).cast("string"), "tokens": F.lit(None).cast("long")}).limit(0)
    asked = derived.filter("query != ''").select(F.col("document_id").alias("query_id"), "query", embed(F.col("query")).alias("embedding"))
    found = retrieve(settle(asked, "asked"), vectors, edges, corpus, tokens, search)
    return derived.join(found.select(F.col("query_id").alias("document_id"), "context", "tokens"), "document_id", "left")
