"""Answers of the agents as typed rows: parsing with fallbacks, self-assessment, and applying them to chunks; and the lists their prompts hold.

Answers are JSON, fenced or not. An answer that is no JSON object takes its agent's fallback; a
malformed item of a list is left out. Everything is ``from_json`` and column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions.text import strip_fence

_REFERENCE = "array<struct<type:string,text:string,target:string,source_chunk_id:string>>"
_RESOLVED = "array<struct<original_text:string,resolved_text:string,reference_type:string,resolution_source:string,position_in_chunk:int>>"
_ISSUE = "array<struct<severity:string,category:string,description:string,affected_entities:array<string>,suggestion:string>>"
SCHEMAS = {
    "reference_extractor": f"struct<references:{_REFERENCE},confidence:double>",
    "decontextualizer": f"struct<decontextualized_content:string,resolved_references:{_RESOLVED},confidence:double>",
    "summarizer": "struct<updated_summary:string,new_information:array<string>,confidence:double>",
    "densifier": "struct<dense_summary:string,added_entities:array<string>,removed_details:array<string>,density_score:double>",
    "community_summarizer": "struct<title:string,summary:string,key_entities:array<string>,confidence:double>",
    "profile_generator": "struct<profile_text:string,key_relations:array<string>,confidence:double>",
    "synthesizer": "struct<synthesis:string,key_findings:array<string>,confidence:double>",
    "critic": f"struct<overall_quality:double,issues:{_ISSUE},summary:string>",
}
REFERENCE_TYPES = ["citation", "bibliography", "footnote", "internal_ref"]


def parsed(answer: Column, agent: str) -> Column:
    """The answer as a struct, null where it is no JSON object."""
    text = strip_fence(answer)
    return F.when(text.rlike(r"(?s)^\{.*\}$") & F.get_json_object(text, "$").isNotNull(), F.from_json(text, SCHEMAS[agent]))


def _strings(none: bool = False) -> Column:
    return F.array().cast("array<string>")


def parse_references(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """References (seq, type, text, target, source_chunk_id) of each answer; those without a known type or a text are left out."""
    rows = answers.select("*", F.posexplode(parsed(F.col(answer_col), "reference_extractor")["references"]).alias("seq", "r"))
    rows = rows.filter(F.col("r.type").isin(REFERENCE_TYPES) & F.col("r.text").isNotNull())
    return rows.select(*[c for c in answers.columns if c != answer_col], "seq", "r.type", "r.text", "r.target", F.coalesce("r.source_chunk_id", F.lit("document")).alias("source_chunk_id"))


def parse_issues(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """overall_quality, issues, summary, issue_count, high_severity_count of each critique; 0.5 and no issues where it can't be read."""
    p = F.col("_p")
    issue = lambda i: F.struct(F.coalesce(i["severity"], F.lit("low")).alias("severity"), F.coalesce(i["category"], F.lit("unknown")).alias("category"), F.coalesce(i["description"], F.lit("")).alias("description"), F.coalesce(i["affected_entities"], _strings()).alias("affected_entities"), F.coalesce(i["suggestion"], F.lit("")).alias("suggestion"))
    issues = F.transform(F.filter(p["issues"], lambda i: i.isNotNull()), issue)
    out = answers.withColumn("_p", parsed(F.col(answer_col), "critic")).withColumn("_i", F.coalesce(issues, F.expr(f"cast(array() as {_ISSUE})")))
    return out.select(
        *[c for c in answers.columns if c != answer_col], F.coalesce(p["overall_quality"], F.lit(0.5)).alias("overall_quality"), F.col("_i").alias("issues"), F.coalesce(p["summary"], F.lit("")).alias("summary"),
        F.size("_i").alias("issue_count"), F.size(F.filter("_i", lambda i: i["severity"] == "high")).alias("high_severity_count"),
    )


def parse_decontextualized(chunks: DataFrame, answer_col: str = "answer", content_col: str = "content") -> DataFrame:
    """Adds decontextualized_content, resolved_references, confidence; an answer that can't be read leaves the content as it is with confidence 0."""
    p = parsed(F.col(answer_col), "decontextualizer")
    whole = F.filter(p["resolved_references"], lambda r: r["original_text"].isNotNull() & r["resolved_text"].isNotNull())
    filled = F.transform(whole, lambda r: F.struct(r["original_text"].alias("original_text"), r["resolved_text"].alias("resolved_text"), F.coalesce(r["reference_type"], F.lit("implicit_ref")).alias("reference_type"), F.coalesce(r["resolution_source"], F.lit("preceding_chunk")).alias("resolution_source"), F.coalesce(r["position_in_chunk"], F.lit(0)).alias("position_in_chunk")))
    return chunks.withColumns({
        "decontextualized_content": F.coalesce(p["decontextualized_content"], F.col(content_col)), "resolved_references": F.coalesce(filled, F.expr(f"cast(array() as {_RESOLVED})")),
        "confidence": F.when(p.isNull(), 0.0).otherwise(F.coalesce(p["confidence"], F.lit(0.5))),
    })


def parse_summaries(chunks: DataFrame, answer_col: str = "answer", summary_col: str = "current_summary", content_col: str = "content") -> DataFrame:
    """Adds updated_summary, new_information, confidence; an answer that can't be read keeps the summary (else the first 500 characters) with confidence 0.3."""
    p = parsed(F.col(answer_col), "summarizer")
    kept = F.when(p.isNull(), F.coalesce(F.nullif(F.col(summary_col), F.lit("")), F.substring(content_col, 1, 500))).otherwise(F.col(summary_col))
    return chunks.withColumns({"updated_summary": F.coalesce(p["updated_summary"], kept), "new_information": F.coalesce(p["new_information"], _strings()), "confidence": F.when(p.isNull(), 0.3).otherwise(F.coalesce(p["confidence"], F.lit(0.5)))})


def parse_densified(rounds: DataFrame, by: str = "document_id", order: str = "iteration", answer_col: str = "answer", summary_col: str = "refine_summary") -> DataFrame:
    """(by, dense_summary, density_scores, final_density_score): the last readable summary of each document; an unreadable round scores 0.3."""
    p = parsed(F.col(answer_col), "densifier")
    rows = rounds.select(by, order, summary_col, p["dense_summary"].alias("s"), F.when(p.isNull(), 0.3).otherwise(F.coalesce(p["density_score"], F.lit(0.5))).alias("d"))
    g = rows.groupBy(by).agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col(order))).alias("s"), F.first(summary_col).alias("first"), F.array_sort(F.collect_list(F.struct(order, "d"))).alias("l"))
    scores = F.transform("l", lambda x: x["d"])
    return g.select(by, F.coalesce("s", "first").alias("dense_summary"), scores.alias("density_scores"), F.element_at(scores, -1).alias("final_density_score"))


def parse_community_summaries(groups: DataFrame, answer_col: str = "answer", id_col: str = "community_id", members_col: str = "members") -> DataFrame:
    """Adds title, summary, key_entities, confidence, member_count; unreadable: the id, the size, the first five members, 0.3."""
    p = parsed(F.col(answer_col), "community_summarizer")
    n = F.size(members_col)
    first = F.slice(members_col, 1, fixed.PROMPT_HEADS["key_entities"])
    none = F.concat(F.lit("Community of "), n.cast("string"), F.lit(" entities."))
    return groups.withColumns({
        "title": F.coalesce(p["title"], F.col(id_col)), "summary": F.when(p.isNull(), none).otherwise(F.coalesce(p["summary"], F.lit(""))), "key_entities": F.coalesce(p["key_entities"], first),
        "confidence": F.when(p.isNull(), 0.3).otherwise(F.coalesce(p["confidence"], F.lit(0.7))), "member_count": n,
    })


def parse_profiles(entities: DataFrame, answer_col: str = "answer", name_col: str = "canonical_name") -> DataFrame:
    """Adds profile_text, key_relations, confidence; unreadable: a sentence that says no more than the name, 0.3."""
    p = parsed(F.col(answer_col), "profile_generator")
    none = F.concat(F.col(name_col), F.lit(" is mentioned in the document."))
    return entities.withColumns({"profile_text": F.when(p.isNull(), none).otherwise(F.coalesce(p["profile_text"], F.lit(""))), "key_relations": F.coalesce(p["key_relations"], _strings()), "confidence": F.when(p.isNull(), 0.3).otherwise(F.coalesce(p["confidence"], F.lit(0.7)))})


def parse_synthesis(docs: DataFrame, answer_col: str = "answer", title_col: str = "document_title", themes: str = "n_communities") -> DataFrame:
    """Adds synthesis, key_findings, confidence; unreadable: a sentence with title and number of themes, 0.3."""
    p = parsed(F.col(answer_col), "synthesizer")
    none = F.format_string("Analysis of '%s' with %s themes identified.", F.col(title_col), F.col(themes).cast("string"))
    return docs.withColumns({"synthesis": F.when(p.isNull(), none).otherwise(F.coalesce(p["synthesis"], F.lit(""))), "key_findings": F.coalesce(p["key_findings"], _strings()), "confidence": F.when(p.isNull(), 0.3).otherwise(F.coalesce(p["confidence"], F.lit(0.7)))})


# --- what an agent thinks of its own output


def _filled(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def facts_score(confidences: Column, confidence: Column) -> Column:
    """Mean confidence of the facts, at most the agent's; 0.3 without facts."""
    mean = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.size(confidences)
    return F.when(F.size(confidences) > 0, F.least(mean, confidence)).otherwise(0.3)


def content_score(text: Column, confidence: Column) -> Column:
    return F.when(_filled(text), confidence).otherwise(0.0)


def summary_score(text: Column, confidence: Column, short: int = 50) -> Column:
    """Summaries under ``short`` characters are worth 0.5 at most."""
    return F.when(~_filled(text), 0.0).when(F.length(text) < short, F.least(confidence, F.lit(0.5))).otherwise(confidence)


def density_score(text: Column, scores: Column, confidence: Column) -> Column:
    """0.1 more, up to 1, where the last round is denser than the first."""
    better = (F.size(scores) >= 2) & (F.element_at(scores, -1) > F.element_at(scores, 1))
    return F.when(~_filled(text) | (F.size(scores) < 1), 0.0).when(better, F.least(confidence + 0.1, F.lit(1.0))).otherwise(confidence)


def synthesis_score(text: Column, confidence: Column, full: int = 500) -> Column:
    """In proportion to the length up to ``full`` characters."""
    return F.when(~_filled(text), 0.0).otherwise(F.least(confidence * F.least(F.length(text) / full, F.lit(1.0)), F.lit(1.0)))


# --- applying


def apply_decontextualization(chunks: DataFrame) -> DataFrame:
    """The rewritten content takes the place of ``content``, which stays as original_content."""
    return chunks.withColumns({"original_content": F.col("content"), "content": F.col("decontextualized_content"), "decontextualized": F.lit(True)}).drop("decontextualized_content")


def apply_summary(chunks: DataFrame, summaries: DataFrame, by: str = "document_id") -> DataFrame:
    """Adds context_summary, the document's summary so far, by (by, position)."""
    return chunks.join(summaries.select(by, "position", F.col("updated_summary").alias("context_summary")), [by, "position"], "left")


# --- lists in prompts


def contents_text(sections: Column) -> Column:
    """A table of contents from array<struct<title, level>>, two spaces a level."""
    lines = F.transform(sections, lambda s: F.concat(F.repeat(F.lit("  "), s["level"] - 1), F.lit("- "), s["title"]))
    return F.when(F.size(sections) > 0, F.array_join(lines, "\n")).otherwise(F.lit("(not available)"))


def listed(items: Column, most: int, none: str) -> Column:
    """The first items as a list, or ``none``."""
    lines = F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("- "), x))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise(F.lit(none))


def group_context(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, context): members with their types and the relations between them, as a prompt lists them."""
    n = fixed.PROMPT_HEADS
    kinds = members.join(nodes.select(F.col("node_id").alias("node"), "entity_type"), "node", "left")
    m = kinds.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("node", F.concat("node", F.lit(" ("), F.coalesce("entity_type", F.lit("unknown")), F.lit(")")).alias("t")))).alias("m"))
    e = members.select("component", F.col("node").alias("src"))
    inner = edges.join(e, "src").join(members.select(F.col("component").alias("_c"), F.col("node").alias("dst")), "dst").filter("component = _c")
    r = inner.groupBy("component").agg(F.array_sort(F.collect_list(F.concat_ws(" → ", "src", "relation_type", "dst"))).alias("r"))
    out = m.join(r, "component", "left")
    told = F.least(F.size("r"), F.lit(n["relations"]))
    text = F.concat(
        F.lit("Members ("), F.size("m").cast("string"), F.lit("):\n"), listed(F.transform("m", lambda x: x["t"]), n["members"], ""),
        F.lit("\n\nIntra-community relations ("), told.cast("string"), F.lit("):\n"), listed(F.col("r"), n["relations"], ""),
    )
    return out.select("component", F.when(F.size(F.coalesce("r", _strings())) > 0, text).otherwise(F.lit("(none detected)")).alias("context"))


def profile_context(edges: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(node_id, entity_type, aliases, relations, n_relations) of entities with at least ``least`` relations; the text lists the first fifteen."""
    told = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), F.concat_ws(" → ", "src", "relation_type", "dst").alias("t"))
    g = told.groupBy("node_id").agg(F.array_sort(F.collect_list("t")).alias("r")).filter(F.size("r") >= least)
    j = g.join(nodes.select("node_id", "entity_type", "aliases"), "node_id", "left")
    named = F.coalesce(F.nullif(F.array_join("aliases", ", "), F.lit("")), F.lit("(none)"))
    return j.select("node_id", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), named.alias("aliases"), listed(F.col("r"), fixed.PROMPT_HEADS["relations"], "(none)").alias("relations"), F.size("r").alias("n_relations"))


def synthesis_context(communities: Column, profiles: Column) -> tuple[Column, Column]:
    """Lists of array<struct<title, summary>> and array<struct<canonical_name, profile_text>>."""
    n = fixed.PROMPT_HEADS
    c = F.transform(communities, lambda x: F.concat(F.lit("**"), F.coalesce(x["title"], F.lit("Untitled")), F.lit("**: "), F.coalesce(x["summary"], F.lit(""))))
    p = F.transform(profiles, lambda x: F.concat(F.coalesce(x["canonical_name"], F.lit("?")), F.lit(": "), F.substring(F.coalesce(x["profile_text"], F.lit("")), 1, n["profile_chars"])))
    return listed(c, n["communities"], "(no communities)"), listed(p, n["profiles"], "(no entity profiles)")


def facts_context(facts: Column) -> Column:
    """List of array<struct<subject, predicate, object, confidence>> for a critique."""
    line = lambda t: F.concat(F.lit("("), F.concat_ws(", ", *[F.coalesce(t[k], F.lit("?")) for k in ("subject", "predicate", "object")]), F.lit(") [conf="), F.format_number(F.coalesce(t["confidence"], F.lit(0.0)), 2), F.lit("]"))
    return listed(F.transform(facts, line), fixed.PROMPT_HEADS["triplets"], "(no triplets)")
