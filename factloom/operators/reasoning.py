"""Inference, decay and contradictions over edges and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed, maths
from factloom.functions.text import is_literal
from factloom.operators.dealt import meet, pairs
from factloom.shared import settle


def infer_transitive(edges: DataFrame, max_hops: int = fixed.MAX_HOPS, predicates: list[str] | None = None, mode: str = "product") -> DataFrame:
    """(src, dst, relation_type, confidence, path): chains of one transitive predicate.

    Breadth first: of several paths the shortest wins, then the smallest. Each step after the first
    multiplies by the edge and by 0.7 (``product``), or takes the smaller confidence times 0.8
    (``least``). Chains of up to max_hops + 1 edges. One equi-join a step.
    """
    e = edges.filter(F.col("relation_type").isin(predicates or fixed.TRANSITIVE) & (F.col("src") != F.col("dst"))).select("src", "dst", "relation_type", "confidence").dropDuplicates(["src", "dst", "relation_type"])
    step = e.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("relation_type").alias("_r"), F.col("confidence").alias("_c"))
    front = e.select("src", F.col("dst").alias("via"), "relation_type", "confidence", F.array("src", "dst").alias("path"))
    found = None
    known = e.select("src", "dst", "relation_type")
    for _ in range(max_hops):
        grown = front.join(step, (F.col("via") == F.col("_at")) & (F.col("relation_type") == F.col("_r"))).filter(~F.array_contains("path", F.col("_to")))
        conf = F.col("confidence") * F.col("_c") * fixed.INFERENCE_FACTOR if mode == "product" else F.least("confidence", "_c") * 0.8
        grown = grown.select("src", F.col("_to").alias("via"), "relation_type", conf.alias("confidence"), F.concat("path", F.array("_to")).alias("path"))
        front = grown.groupBy("src", "via", "relation_type").agg(F.min(F.struct("path", "confidence")).alias("b")).select("src", "via", "relation_type", "b.confidence", "b.path")
        fresh = front.select("src", F.col("via").alias("dst"), "relation_type", "confidence", "path").join(known, ["src", "dst", "relation_type"], "left_anti")
        found = fresh if found is None else found.unionByName(fresh)
        known = known.unionByName(fresh.select("src", "dst", "relation_type"))
    return found.withColumn("confidence", F.round("confidence", 4))


def infer_inverse(edges: DataFrame) -> DataFrame:
    """(src, dst, relation_type, confidence): the inverse relation the other way, unless it is there."""
    table = F.create_map(*[F.lit(x) for kv in fixed.INVERSES.items() for x in kv])
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.try_element_at(table, F.col("relation_type")).alias("relation_type"), F.round(F.col("confidence") * fixed.INFERENCE_FACTOR, 4).alias("confidence")).filter("relation_type is not null")
    return turned.join(edges.select("src", "dst", "relation_type"), ["src", "dst", "relation_type"], "left_anti")


def infer_membership(edges: DataFrame) -> DataFrame:
    """member_of a group that is part_of another: member of that one, too."""
    m = edges.filter("relation_type = 'member_of'").select("src", F.col("dst").alias("_g"), "confidence")
    p = edges.filter("relation_type = 'part_of'").select(F.col("src").alias("_g"), "dst", F.col("confidence").alias("_c"))
    out = m.join(p, "_g").groupBy("src", "dst").agg(F.max(F.round(F.col("confidence") * F.col("_c") * fixed.INFERENCE_FACTOR, 4)).alias("confidence")).withColumn("relation_type", F.lit("member_of"))
    return out.join(edges.select("src", "dst", "relation_type"), ["src", "dst", "relation_type"], "left_anti")


def run_inference(edges: DataFrame, max_hops: int = fixed.MAX_HOPS) -> DataFrame:
    """New edges of all rules with their rule; of equal ends the transitive one wins."""
    t = infer_transitive(edges, max_hops).drop("path").withColumn("rule", F.lit("transitivity"))
    i = infer_inverse(edges).withColumn("rule", F.lit("inverse"))
    new = t.unionByName(i).join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    best = new.groupBy("src", "dst").agg(F.max_by(F.struct("relation_type", "confidence", "rule"), F.struct("rule", "confidence", "relation_type")).alias("b"))
    return best.select("src", "dst", "b.*")


def decay(rows: DataFrame, now: Column, half_life: float = fixed.HALF_LIFE_DAYS, prune_below: float = 0.0, at: str = "last_updated_at") -> DataFrame:
    """confidence * factor, at least 0.05, six digits; rows without a time stay as they are. Prunes if asked."""
    factor = maths.decay_factor(maths.age_days(F.col(at), now), half_life)
    aged = F.greatest(F.lit(fixed.LEAST_CONFIDENCE), F.col("confidence") * factor)
    out = rows.withColumns({"decay_factor": F.when(F.col(at).isNotNull(), F.round(factor, 6)), "confidence": F.when(F.col(at).isNotNull(), F.round(aged, 6)).otherwise(F.col("confidence"))})
    return out.filter(F.col(at).isNull() | (F.col("confidence") >= prune_below)) if prune_below > 0 else out


def opposing(facts: DataFrame) -> DataFrame:
    """(subject, object, predicate_a, predicate_b, seq_a, seq_b): opposing relations between the same ends."""
    known = facts.sparkSession.createDataFrame([p for a, b in fixed.OPPOSING for p in ((a, b), (b, a))], "pa string, pb string")
    f = facts.select(F.lower("subject").alias("s"), F.lower("object").alias("o"), F.lower("predicate").alias("p"), "seq")
    one = f.join(F.broadcast(known), f["p"] == known["pa"]).select("s", "o", F.col("p").alias("predicate_a"), F.col("pb").alias("predicate_b"), F.col("seq").alias("seq_a"))  # a fixed table
    two = f.select("s", "o", F.col("p").alias("predicate_b"), F.col("seq").alias("seq_b"))
    both = meet(one, two, ["s", "o", "predicate_b"]).filter("seq_a < seq_b")
    return both.select(F.col("s").alias("subject"), F.col("o").alias("object"), "predicate_a", "predicate_b", "seq_a", "seq_b")


def value_conflicts(facts: DataFrame) -> DataFrame:
    """(subject, predicate, value_a, value_b): different literals for one subject and relation, each value once, in order.

    Conflicts of a subject are pairs by definition; only subjects with several literals get that far.
    """
    lit = facts.filter(is_literal(F.col("object"))).groupBy(F.lower("subject").alias("subject"), F.lower("predicate").alias("predicate"), F.lower(F.trim("object")).alias("value")).agg(F.min("seq").alias("seq"))
    return pairs(settle(lit, "values"), ["subject", "predicate"], "seq").select("subject", "predicate", "value_a", "seq_a", "value_b", "seq_b")


def value_classes(facts: DataFrame) -> DataFrame:
    """(subject, predicate, value, facts, first_seq, values): the different literals of a subject and relation with several, one row each.

    What ``value_conflicts`` says in pairs, in rows that grow with the facts: ``facts`` hold the value, ``values`` is how many there are.
    """
    lit = facts.filter(is_literal(F.col("object"))).groupBy(F.lower("subject").alias("subject"), F.lower("predicate").alias("predicate"), F.lower(F.trim("object")).alias("value")).agg(F.count("*").alias("facts"), F.min("seq").alias("first_seq"))
    lit = settle(lit, "values")
    several = lit.groupBy("subject", "predicate").agg(F.count("*").alias("values")).filter(F.col("values") > 1)
    return lit.join(several, ["subject", "predicate"])


def _denial(predicate: Column) -> tuple[Column, Column]:
    """(the relation without its negation, whether it has one): blanks and underscores are alike, a verb's ending s doesn't count."""
    p = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.trim(F.replace(predicate, F.lit("_"), F.lit(" ")))), " +", " "), F.lit(" "))
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, " (cannot|can't) ", " can not "), " won't ", " will not "), "^ n'", " ne ")
    said = F.regexp_replace(said, "([a-z])n't ", "$1 not ")
    bare = F.regexp_replace(said, "^ (does|do|did) not ", " ")
    bare = F.trim(F.regexp_replace(bare, " (not|never|no longer|ne|pas|jamais) ", " "))
    base = F.regexp_replace(F.regexp_replace(bare, "^has\\b", "have"), "^([a-z]+[a-rt-z])s\\b", "$1")
    return base, said.rlike(" (not|never|no longer|ne|pas|jamais) ")


def negations(facts: DataFrame) -> DataFrame:
    """(subject, object, predicate, affirmed, denied, first_affirmed, first_denied): what some facts (subject, predicate, object, seq) state and others deny.

    "requires" meets "does not require", "never requires" and "requires no longer". One row for each such statement with the number of facts on both sides,
    so a hot subject gives no product. Facts without a subject, relation or object say nothing.
    """
    base, denies = _denial(F.col("predicate"))
    f = facts.filter("subject is not null and predicate is not null and object is not null").select(F.lower("subject").alias("subject"), F.lower("object").alias("object"), base.alias("predicate"), denies.alias("no"), "seq")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    first = lambda c, name: F.min(F.when(c, F.col("seq"))).alias(name)
    yes, no = ~F.col("no"), F.col("no")
    return f.groupBy("subject", "object", "predicate").agg(n(yes, "affirmed"), n(no, "denied"), first(yes, "first_affirmed"), first(no, "first_denied")).filter("affirmed > 0 and denied > 0")


def contradictions(facts: DataFrame) -> DataFrame:
    """(kind, severity, subject, detail): both kinds with their explanation."""
    o = opposing(facts).select(F.lit("opposing_predicate").alias("kind"), F.lit("high").alias("severity"), "subject", F.format_string("Opposing predicates '%s' and '%s' for (%s, %s).", "predicate_a", "predicate_b", "subject", "object").alias("detail"))
    v = value_conflicts(facts).select(F.lit("value_conflict").alias("kind"), F.lit("medium").alias("severity"), "subject", F.format_string("Conflicting values for (%s, %s): '%s' vs '%s'.", "subject", "predicate", "value_a", "value_b").alias("detail"))
    return o.unionByName(v)


def temporal_conflicts(facts: DataFrame) -> DataFrame:
    """(subject, predicate, object_a, object_b): facts of one subject and relation with other objects whose periods overlap.

    facts: subject, predicate, object, start, end, seq. Of two overlapping periods one holds the other's start. A period lies in
    three cells at most of the level (cell length, a power of two) that fits its own length, and a start lies in one cell of each level that
    the subject's periods have; so a period that covers all others is still a few rows. They meet in those cells, hot ones dealt. Facts without
    a subject, relation, start or end have no period; one that ends before or when it starts overlaps nothing that isn't around both.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    f = facts.select("subject", "predicate", "object", micros("start").alias("s"), micros("end").alias("e"), "seq").filter("s is not null and e is not null")
    f = settle(f, "periods")
    by = ["subject", "predicate"]
    # a cell of level l is 2^l microseconds; a period is as long as one cell or two
    level = F.floor(F.log2(F.greatest(F.col("e") - F.col("s"), F.lit(1)).cast("double"))).cast("int")
    covers = f.filter("s < e").withColumn("level", level)
    cell = lambda c: F.expr(f"shiftright({c}, level)")
    levels = covers.select(*by, "level").distinct()
    periods = covers.select(*by, "level", F.explode(F.sequence(cell("s"), cell("e"))).alias("cell"), F.col("object").alias("x"), F.col("s").alias("sx"), F.col("e").alias("ex"), F.col("seq").alias("qx"))
    starts = f.join(levels, by).select(*by, "level", cell("s").alias("cell"), F.col("object").alias("y"), F.col("s").alias("sy"), F.col("e").alias("ey"), F.col("seq").alias("qy"))
    # x holds y's start; where both start at once, the smaller number holds the other's
    holds = "qx != qy and x != y and sx <= sy and sy < ex and sx < ey and (sx < sy or qx < qy)"
    both = meet(periods, starts, [*by, "level", "cell"]).filter(holds)
    first = F.col("qx") < F.col("qy")
    return both.select(*by, F.when(first, F.col("x")).otherwise(F.col("y")).alias("object_a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("object_b"))
