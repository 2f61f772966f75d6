"""Segments, size packing, chunk metrics and links, semantic breaks, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.maths import cosine

BLOCK = r"<<<(?:IMAGE_CONTENT|TABLE_CONTENT)\b[\s\S]*?<<<END_(?:IMAGE_CONTENT|TABLE_CONTENT)>>>"
_EDGE = "\u0001"


def segments(text: Column, separator: str = r"\n{2,}") -> Column:
    """Array of segments: marked image and table blocks whole, other text split on blank lines, trimmed, empties dropped."""
    framed = F.regexp_replace(text, f"({BLOCK})", f"{_EDGE}$1{_EDGE}")
    outer = F.split(framed, _EDGE)
    inner = F.transform(outer, lambda part: F.when(part.startswith("<<<IMAGE_CONTENT") | part.startswith("<<<TABLE_CONTENT"), F.array(part)).otherwise(F.split(part, separator)))
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.filter(F.transform(F.flatten(inner), strip), lambda s: s != "")


def pack(parts: Column, target: int, overlap: int = 0, joiner: str = "\n\n") -> Column:
    """Array of chunks: segments are appended until the next one would pass ``target``.

    A fold that resets on overflow, so no window function can express it; it runs as one
    higher-order ``aggregate`` per document, without a shuffle. Lengths ignore joiners. On a flush the
    last segment is carried over if it is no longer than ``overlap``.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(s: Column, seg: Column) -> Column:
        over = (s["size"] + F.length(seg) > target) & (F.size(s["open"]) > 0)
        last = F.try_element_at(s["open"], F.lit(-1))
        carry = F.when((F.lit(overlap) > 0) & (F.length(last) <= overlap), F.array(last)).otherwise(F.array().cast("array<string>"))
        kept = F.when(over, carry).otherwise(s["open"])
        size = F.when(over, F.when(F.size(carry) > 0, F.length(last)).otherwise(0)).otherwise(s["size"])
        return F.struct(
            F.when(over, F.concat(s["done"], F.array(F.array_join(s["open"], joiner)))).otherwise(s["done"]).alias("done"),
            F.concat(kept, F.array(seg)).alias("open"),
            (size + F.length(seg)).alias("size"),
        )

    return F.aggregate(parts, state, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], joiner)))).otherwise(s["done"]))


def describe(chunks: DataFrame, id_col: str = "document_id") -> DataFrame:
    """(id_col, position, content) -> the chunk's id, hash, counts, byte span and neighbours' ids."""
    if id_col == "id":
        raise ValueError("id is the chunk's own id; name the document's otherwise")
    w = Window.partitionBy(id_col).orderBy("position")
    out = chunks.withColumns(
        {
            "id": F.format_string("chunk_%03d", "position"),
            "fingerprint": F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16),
            "char_count": F.length("content"),
            "word_count": F.size(F.filter(F.split("content", r"\s+"), lambda x: x != "")),
            "token_count_est": (F.length("content") / 4).cast("int"),
            "content_type": F.when(F.col("content").rlike(BLOCK), "mixed").otherwise("text"),
            "_bytes": F.octet_length("content"),
        }
    )
    end = F.sum("_bytes").over(w)
    return out.withColumns({"byte_offset_start": end - F.col("_bytes"), "byte_offset_end": end, "preceding_chunk_id": F.lag("id").over(w), "following_chunk_id": F.lead("id").over(w)}).drop("_bytes")


def structural(docs: DataFrame, id_col: str, text_col: str, target: int = 2000, overlap: int = 0, separator: str = r"\n{2,}") -> DataFrame:
    """Chunks of each document, packed by size and described."""
    packed = docs.select(F.col(id_col), F.posexplode(pack(segments(F.col(text_col), separator), target, overlap)).alias("position", "content"))
    return describe(packed, id_col)


def semantic_groups(parts: DataFrame, id_col: str, order_col: str, vector_col: str, threshold: float = 0.5) -> DataFrame:
    """Adds ``group``: a new one begins where the cosine to the part before falls below the threshold."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    sim = cosine(F.lag(vector_col).over(w), F.col(vector_col))
    cut = parts.withColumn("_cut", F.when(sim < threshold, 1).otherwise(0))
    return cut.withColumn("group", F.sum("_cut").over(w)).drop("_cut")


def semantic(parts: DataFrame, id_col: str, order_col: str, text_col: str, vector_col: str, threshold: float = 0.5, target: int = 2000, overlap: int = 0) -> DataFrame:
    """Chunks of parts between semantic breaks; documents of fewer than 3 parts are packed by size instead (see ``pack``)."""
    few = F.count("*").over(Window.partitionBy(id_col)) < 3
    counted = parts.withColumn("_few", few)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col])
    g = semantic_groups(counted.filter("not _few"), id_col, order_col, vector_col, threshold)
    long = g.groupBy(id_col, F.col("group").alias("position")).agg(F.array_join(texts, "\n\n").alias("content"))
    short = counted.filter("_few").groupBy(id_col).agg(texts.alias("_parts"))
    short = short.select(id_col, F.posexplode(pack(F.col("_parts"), target, overlap)).alias("position", "content"))
    return long.unionByName(short.withColumn("position", F.col("position").cast(long.schema["position"].dataType)))


def attribute_sections(chunks: DataFrame, sections: DataFrame, id_col: str = "document_id", head: int = 200, most: int = 3) -> DataFrame:
    """Adds source_sections: up to three section titles (ord, title) found in a chunk's first characters, in section order."""
    listed = sections.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("_s"))
    start = F.lower(F.substring("content", 1, head))
    found = F.slice(F.filter(F.transform("_s", lambda s: s["title"]), lambda t: start.contains(F.lower(t))), 1, most)
    return chunks.join(listed, id_col, "left").withColumn("source_sections", F.coalesce(found, F.array().cast("array<string>"))).drop("_s")


def sliding_context(chunks: DataFrame, id_col: str = "document_id", size: int = 3) -> DataFrame:
    """Adds context: the chunks before, formatted and joined, at most ``size``."""
    w = Window.partitionBy(id_col).orderBy("position").rowsBetween(-size, -1)
    return chunks.withColumn("context", F.array_join(F.collect_list(F.format_string("[%s]\n%s", "id", "content")).over(w), "\n\n---\n\n"))


def validate(chunks: DataFrame, id_col: str = "document_id", most: int = 10000, least: int = 50) -> DataFrame:
    """(document, chunk, level, issue) for each broken rule; needs id, position, content, fingerprint and links."""
    w = Window.partitionBy(id_col).orderBy("position", "id")
    seen = lambda c: F.row_number().over(Window.partitionBy(id_col, c).orderBy("position", "id"))
    count = lambda p: F.regexp_count("content", F.lit(p))
    c = chunks.withColumns({"_i": F.row_number().over(w) - 1, "_id": seen("id"), "_fp": seen("fingerprint"), "_before": F.lag("id").over(w), "_after": F.lead("id").over(w), "_n": F.length("content")})
    rule = lambda cond, level, name: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(name).alias("issue")))
    issues = F.array(
        rule(F.col("_id") > 1, "error", "duplicate id"),
        rule(F.col("_fp") > 1, "warning", "duplicate fingerprint"),
        rule(F.col("position") != F.col("_i"), "error", "position"),
        rule(count(r"<<<IMAGE_CONTENT\b") != count("<<<END_IMAGE_CONTENT>>>"), "error", "unbalanced image block"),
        rule(count(r"<<<TABLE_CONTENT\b") != count("<<<END_TABLE_CONTENT>>>"), "error", "unbalanced table block"),
        rule(F.col("_n") > most, "warning", "too long"),
        rule(F.col("_n") < least, "warning", "too short"),
        rule(F.col("_before").isNotNull() & ~F.col("preceding_chunk_id").eqNullSafe(F.col("_before")), "warning", "preceding link"),
        rule(F.col("_after").isNotNull() & ~F.col("following_chunk_id").eqNullSafe(F.col("_after")), "warning", "following link"),
    )
    return c.select(id_col, "id", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("x")).select(id_col, "id", "x.level", "x.issue")
