"""Text functions as columns: fingerprints, predicates, detectors. Only simhash runs in Python, by Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.shared import spread


def normalize(text: Column) -> Column:
    """Lower case, without punctuation, white space collapsed and trimmed."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def exact_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(normalize(text).cast("binary"), 256)


def _votes(text: str, n: int) -> int:
    """64 votes over the word n-grams of a normalised text (a shorter one is its own): the low halves of their md5, bit by bit."""
    if not text:
        return 0
    words = text.split(" ")
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [text]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        digests = b"".join([hashlib.md5(g.encode(), usedforsecurity=False).digest()[8:] for g in grams[at : at + (1 << 16)]])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones >= len(grams)).tobytes(), "big", signed=True)


def simhash(docs: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """(id, simhash long, simhash_hex) per row: 64 votes over word shingles; empty text has no bits, null text no row.

    All votes of a text are in its row, so nothing is shuffled. An Arrow function: exploded shingles with an
    aggregate of 64 counters took half as long again on sf0.1, and a shuffle of all hashes.
    """
    norm = spread(docs.select(id_col, text_col)).filter(F.col(text_col).isNotNull())
    return norm.select(id_col, simhash_of(F.col(text_col), n).alias("simhash")).withColumn("simhash_hex", F.lpad(F.lower(F.hex("simhash")), 16, "0"))


def simhash_of(text: Column, n: int = 3) -> Column:
    """64 votes over the word shingles of a text, as a long; 0 for an empty one."""
    vote = F.pandas_udf(lambda texts: pd.Series([_votes(t, n) for t in texts], dtype="int64"), "long")
    return vote(normalize(text))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Of two 16-digit hex strings: both empty 0, one empty or not hex 64."""
    ok = lambda c: c.rlike("^[0-9a-fA-F]{1,16}$")
    value = lambda c: F.conv(c, 16, -10).cast("long")
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((a == "") & (b == ""), 0).when(ok(a) & ok(b), hamming(value(a), value(b))).otherwise(64)


def triplet_key(s: Column, p: Column, o: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(F.trim(x)) for x in (s, p, o)]).cast("binary"), 256), 1, 16)


def is_literal(value: Column) -> Column:
    """Numbers with a unit sign, numbers with a short word, dates."""
    v = F.trim(value)
    return F.when(v == "", False).otherwise(v.rlike(fixed.LITERALS[0]) | v.rlike(fixed.LITERALS[1]) | v.rlike(fixed.LITERALS[2]))


def slug(predicate: Column) -> Column:
    return F.replace(F.trim(F.lower(predicate)), F.lit(" "), F.lit("_"))


def tokens(text: Column) -> Column:
    """Characters divided by four, rounded down."""
    return (F.length(text) / 4).cast("long")


def format_of(path: Column) -> Column:
    """Format by lower-cased extension, null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in fixed.FORMATS.items() for x in kv])
    return F.try_element_at(table, ext)


def _held(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, where value is worked out once however often ``of`` names it: inside a lambda nothing else is shared."""
    return F.transform(F.array(value), of)[0]


def detect_language(text: Column) -> Column:
    """en, fr or de by stop words in the first 3000 characters; accents and contractions speak for French; ties en, fr, de."""

    def ranked(head: Column, low: Column, seen: Column) -> Column:
        count = lambda words: F.size(F.array_intersect(seen, F.array(*map(F.lit, words))))
        accents = _held(F.regexp_count(low, F.lit(f"[{fixed.FRENCH_LETTERS}]")), lambda n: F.when(n >= 2, n * 2).otherwise(0))
        # both patterns look for an apostrophe, and most texts have none
        contractions = F.when(~F.contains(head, F.lit("'")), 0).otherwise(F.regexp_count(head, F.lit(r"(?:(?<![\p{L}\p{N}_])[lLdDnNsS]'|qu'|j')")))
        fr = count(fixed.FRENCH) + accents + contractions * 3
        each = (("en", count(fixed.ENGLISH)), ("fr", fr), ("de", count(fixed.GERMAN)))
        return F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, n) in enumerate(each)]))["k"]

    # one pass for the words; a word list then costs one intersection
    words = lambda low: F.split(low, r"[^\p{L}\p{N}_]+")
    return _held(F.substring(text, 1, 3000), lambda head: _held(F.lower(head), lambda low: _held(words(low), lambda seen: ranked(head, low, seen))))


def chunk_languages(text: Column, least: int = 10) -> Column:
    """struct(primary, secondary array, multilingual): other languages of sentences of at least ``least`` words, sorted."""
    enough = lambda s: s.rlike(rf"^\s*+(?:\S++\s++){{{least - 1}}}\S") if least > 0 else F.lit(True)
    sentences = F.filter(F.split(text, r"[.!?]\s+"), enough)
    others = lambda primary: F.array_sort(F.array_except(F.transform(sentences, detect_language), F.array(primary)))
    whole = lambda primary, found: F.struct(primary.alias("primary"), found.alias("secondary"), (F.size(found) > 0).alias("multilingual"))
    return _held(detect_language(text), lambda primary: _held(others(primary), lambda found: whole(primary, found)))


def document_id(at: Column, unique: Column | None = None) -> Column:
    """yyyymmdd_hhmmss_ and eight hex digits: of a random uuid, or of what makes the row unique (the same on every retry)."""
    digits = F.substring(F.md5(unique.cast("string")), 1, 8) if unique is not None else F.substring(F.replace(F.uuid(), F.lit("-")), 1, 8)
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), digits)


def run_id(document: Column, at: Column) -> Column:
    """yyyymmdd_hhmm_ and the first twelve digits of the name-based uuid (version 5, DNS namespace) of document and time."""
    stamp = F.date_format(at, "yyyyMMdd_HHmm")
    name = F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(F.concat(document, F.lit("_"), stamp), "UTF-8"))
    return F.concat(stamp, F.lit("_"), F.substring(F.sha1(name), 1, 12))


def document_language(override: Column, metadata: Column, text: Column) -> Column:
    """Override, else metadata, else detected; empty counts as absent."""
    return F.coalesce(F.nullif(override, F.lit("")), F.nullif(metadata, F.lit("")), detect_language(text))


def has_contents(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 5000))
    out = F.lit(False)
    for p in fixed.CONTENTS_MARKERS:
        out = out | head.rlike(p)
    return out


def bibliography_at(text: Column) -> Column:
    """Offset of a bibliography heading, else of such a word in the last 30 percent, else null."""
    heading = F.regexp_instr(text, F.lit(fixed.BIBLIOGRAPHY_HEADING))
    start = F.floor(F.length(text) * 0.7).cast("int")
    tail = F.lower(F.substring(text, start + 1, F.length(text)))
    word = F.regexp_instr(tail, F.lit(rf"\b(?:{'|'.join(fixed.BIBLIOGRAPHY_WORDS)})\b"))
    return F.when(heading > 0, heading - 1).when(word > 0, start + word - 1)


def is_annex(title: Column) -> Column:
    return title.rlike(rf"(?i)\b(?:{'|'.join(fixed.ANNEX_WORDS)})\b")


def has_index(text: Column, compatible: bool = True) -> Column:
    """Alphabetical index. Compatible mode is always false (the tail is lower-cased before capitals are sought)."""
    if compatible:
        return F.lit(False)
    tail = F.substring(text, -3000, 3000)
    letters = F.regexp_count(F.substring(tail, -2000, 2000), F.lit(r"(?m)^[A-Z]\s*$"))
    return F.lower(tail).rlike(r"\b(index|indice)\b") & (letters >= 3)


def size_bytes(size: Column) -> Column:
    """'10MB' to bytes; a bare number is bytes, anything else null."""
    n = F.regexp_extract(F.upper(F.trim(size)), r"^(\d+(?:\.\d+)?)\s*([KMG]?B?)$", 1)
    unit = F.regexp_extract(F.upper(F.trim(size)), r"^(\d+(?:\.\d+)?)\s*([KMG]?B?)$", 2)
    scale = F.when(unit.startswith("K"), 1024).when(unit.startswith("M"), 1024**2).when(unit.startswith("G"), 1024**3).otherwise(1)
    return F.when(n != "", (n.cast("double") * scale).cast("long"))


def error_class(name: Column, message: Column) -> Column:
    """Kind of a failed call, first rule that fits."""
    name, m = F.lower(name), F.lower(message)
    has = lambda c, *words: c.rlike("|".join(words))
    return (
        F.when(has(m, "429", "rate"), "rate_limit").when(has(name, "timeout") | has(m, "timeout"), "timeout").when(has(m, "500", "502", "503", "504", "server"), "server_error")
        .when(has(m, "json", "parse", "decode"), "parse_error").when(has(m, "token") & has(m, "limit", "exceed"), "token_limit").otherwise("unknown")
    )


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0) -> Column:
    return F.lit(base) * F.pow(F.lit(factor), attempt)


def strip_fence(answer: Column) -> Column:
    """A model's answer without lines that open or close a code fence."""
    lines = F.split(F.trim(answer), "\n")
    bare = F.array_join(F.filter(lines, lambda s: ~F.trim(s).startswith("```")), "\n")
    return F.when(F.trim(answer).startswith("```"), bare).otherwise(F.trim(answer))


def cluster_name(members: Column) -> Column:
    """cluster_ and up to three sorted names, or the size and the first name."""
    names = F.array_sort(members)
    return F.when(F.size(names) <= 3, F.concat(F.lit("cluster_"), F.array_join(names, "_"))).otherwise(F.concat(F.lit("cluster_"), F.size(names).cast("string"), F.lit("_"), F.element_at(names, 1)))


def graph_key(name: Column) -> Column:
    """Key for stores that allow no slash or space."""
    return F.translate(name, "/ ", "__")


def cypher_text(value: Column) -> Column:
    """Backslash and quotes escaped for a quoted Cypher string."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("'"), F.lit("\\'"))


def indexable(*parts: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
