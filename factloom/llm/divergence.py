"""How the sources of a language differ in vocabulary, exactly.

Smoothed term shares of all groups (lang, source) are compared, term by term, between the groups of a language and with
the language itself. Comparing every pair over every term is split in two:

* *heavy* terms, which occur in more than ``LIGHT`` groups of the language, meet in dense numpy tiles: a block of groups by a
  block of groups by a block of terms;
* *light* terms cost what their postings cost. A term that only one of two groups has contributes by its count alone, so
  each group's light terms are folded into a histogram of shares; terms that two groups share get a correction a pair, of
  which a term has ``LIGHT * (LIGHT - 1) / 2`` at most.

The partial sums are integers, and add up to the sum over all terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.shared import settle, small_batches, spread

#: Groups of a light term at most.
LIGHT = 8
#: Groups and terms to a side of a tile.
GROUPS, TERMS = 256, 1024
#: Documents of a language that a kept term occurs in at least; ranks of terms that are reported.
LEAST, RANKS = 10, 10
#: Entries of a task's counters before it hands them on; bytes of a text that are cut into terms at a time.
HELD, STRETCH = 200_000, 1 << 20
#: Everything but letters a-z (A-Z are lowered) and bytes of other scripts becomes a space.
_TERM = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes, stretch: int) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in lists, cut between terms."""
    text = text.translate(_TERM)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + stretch)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(most: int, stretch: int):
    """lang, source, term, n, docs; a row without term for each group. Counters are handed on when they are large, so memory is bounded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        groups: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seen, groups, docs, size
            rows = [(*g, None, 0, n) for g, n in seen.items()]
            for g, c in groups.items():
                d = docs[g]
                rows += [(*g, t.decode(), n, d[t]) for t, n in c.items()]
            seen, groups, docs, size = Counter(), {}, {}, 0
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(),) * 3 + (pa.int64(),) * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
                g = (lang, source)
                seen[g] += 1
                held, count = docs.setdefault(g, Counter()), groups.setdefault(g, Counter())
                before = len(count)
                own: set[bytes] = set()
                for found in terms_of(text.as_py(), stretch):
                    count.update(found)
                    own.update(found)
                held.update(own)
                size += len(count) - before
                if size > most:
                    yield flush()
        if seen:
            yield flush()

    return run


def _share(count: str, total: str = "total") -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 v)); products take up to 32 digits. A language without kept terms has no shares: 1."""
    return F.expr(f"CASE WHEN v = 0 THEN 1L ELSE 1L + (CAST(1000000000 AS DECIMAL(10, 0)) * (CAST({count} AS DECIMAL(20, 0)) + 2)) div CAST({total} + 2 * v AS DECIMAL(20, 0)) END")


def _tiles(width: int):
    """Rows of a cell stand together: kind 0 base shares of its groups, 1 postings of heavy terms, 2 histograms of light ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("bi", "bj", "tile", "kind", "g", "t", "p", "n")]
            lang = b.column("lang_id").to_numpy(zero_copy_only=False)
            cells = np.column_stack([lang, cols[0], cols[1], cols[2]])
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), len(cells)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                now = tuple(cells[a].tolist())
                if now != key and held:
                    yield from _tile(key, held, width)
                    held = []
                key = now
                held.append([c[a:z] for c in cols[3:]])
        if held:
            yield from _tile(key, held, width)

    return run


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)  # shares are at most 10^9 + 1, so squares stay below 2^63


def _tile(key: tuple, held: list, width: int) -> Iterator[pa.RecordBatch]:
    lang, bi, bj, tile = key
    kind, g, t, p, n = (np.concatenate(c) for c in zip(*held, strict=True))
    base = {int(x): int(y) for x, y in zip(g[kind == 0], p[kind == 0], strict=True)}
    rows, cols = (sorted(x for x in base if x // width == b) for b in (bi, bj))
    at = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
    b0, b1 = (np.array([base[x] for x in side], np.int64) for side in (rows, cols))
    total = np.zeros((len(rows), len(cols)), np.int64)
    if tile >= 0:
        heavy = kind == 1
        names, col = np.unique(t[heavy], return_inverse=True)
        dense = [np.repeat(b[:, None], len(names), 1) for b in (b0, b1)]
        for side, b in enumerate((bi, bj)):
            mine = g[heavy] // width == b
            dense[side][[at[side][int(x)] for x in g[heavy][mine]], col[mine]] = p[heavy][mine]
        for i in range(len(rows)):
            total[i] = _f(dense[0][i], dense[1]).sum(1)
    else:
        # kind 3: light terms of the language
        zero = _f(b0[:, None], b1[None, :])
        total += int(n[kind == 3].sum()) * zero
        light = kind == 2
        for side, b in enumerate((bi, bj)):
            mine = light & (g // width == b)
            for x in np.unique(g[mine]):
                own, i = mine & (g == x), at[side][int(x)]
                against = (b1, b0)[side]
                extra = np.zeros(len(against), np.int64)
                for a in range(0, int(own.sum()), 1024):
                    part = np.flatnonzero(own)[a : a + 1024]
                    extra += (_f(p[part][:, None], against[None, :]) * n[part][:, None]).sum(0) - int(n[part].sum()) * (zero[i] if side == 0 else zero[:, i])
                if side == 0:
                    total[i] += extra
                else:
                    total[:, i] += extra
    a, b = np.meshgrid(rows, cols, indexing="ij")
    keep = a < b
    if keep.any():
        yield pa.record_batch([pa.array(np.full(int(keep.sum()), lang)), pa.array(a[keep].astype(np.int64)), pa.array(b[keep].astype(np.int64)), pa.array(total[keep])], names=["lang_id", "a", "b", "value"])


def _pairs(counts: DataFrame, groups: DataFrame, light: int) -> DataFrame:
    """counts (lang_id, term, g, p), groups (lang_id, g, base, blocks) -> lang_id, a, b, value for a < b."""
    per_term = counts.groupBy("lang_id", "term").agg(F.count("*").alias("in"))
    heavy_terms = per_term.filter(F.col("in") > light).withColumn("t", F.pmod(F.xxhash64("term"), F.lit(1 << 40)))
    sizes = per_term.groupBy("lang_id").agg(F.count_if(F.col("in") > light).alias("heavy"), F.count_if(F.col("in") <= light).alias("light"))
    langs = groups.groupBy("lang_id").agg(F.first("blocks").alias("blocks")).join(sizes, "lang_id", "left")
    # kept terms occur somewhere, so light ones are those that aren't heavy
    langs = settle(langs.select("lang_id", "blocks", F.coalesce("heavy", F.lit(0)).alias("heavy"), F.coalesce("light", F.lit(0)).alias("light"), F.ceil(F.coalesce("heavy", F.lit(0)) / TERMS).cast("int").alias("tiles")), "langs")
    named = counts.join(per_term, ["lang_id", "term"]).join(F.broadcast(langs) if langs.count() <= 10_000 else langs, "lang_id")
    named = settle(named.select("lang_id", "term", "g", "p", "base", "in", "blocks", "tiles"), "postings")
    # every group of a block, in every cell of it
    block = (F.col("g") / GROUPS).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cell = lambda df: df.withColumn("_b", block).withColumn("_o", other).withColumns({"bi": F.least("_b", "_o"), "bj": F.greatest("_b", "_o")})
    shape = ["lang_id", "bi", "bj", "tile", "kind", "g", "t", "p", "n"]
    nothing = F.lit(0).cast("long")
    members = cell(groups.join(langs.select("lang_id", "tiles"), "lang_id")).withColumn("tile", F.explode(F.sequence(F.lit(-1), F.col("tiles") - 1)))
    members = members.select("lang_id", "bi", "bj", "tile", F.lit(0).alias("kind"), "g", nothing.alias("t"), F.col("base").alias("p"), nothing.alias("n"))
    # a term's number within its language's heavy ones decides its tile, so that tiles are even
    number = F.row_number().over(Window.partitionBy("lang_id", "slice").orderBy("term"))
    numbered = heavy_terms.join(langs.select("lang_id", "tiles"), "lang_id").withColumn("slice", F.pmod(F.hash("term"), F.col("tiles"))).withColumn("t", number.cast("long")).select("lang_id", "term", "t", F.col("slice").alias("tile"))
    dense = cell(named.filter(F.col("in") > light).join(numbered, ["lang_id", "term"]))
    dense = dense.select("lang_id", "bi", "bj", "tile", F.lit(1).alias("kind"), "g", "t", "p", nothing.alias("n"))
    folded = named.filter(F.col("in") <= light).groupBy("lang_id", "g", "blocks", "p").agg(F.count("*").alias("n"))
    folded = cell(folded).select("lang_id", "bi", "bj", F.lit(-1).alias("tile"), F.lit(2).alias("kind"), "g", nothing.alias("t"), "p", "n")
    rest = langs.withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bj", F.explode(F.sequence(F.col("bi"), F.col("blocks") - 1)))
    rest = rest.select("lang_id", "bi", "bj", F.lit(-1).alias("tile"), F.lit(3).alias("kind"), F.lit(-1).cast("long").alias("g"), nothing.alias("t"), nothing.alias("p"), F.col("light").alias("n"))
    cells = members.unionByName(dense).unionByName(folded).unionByName(rest).select(*[F.col(c).cast("long") for c in shape])
    keys = ["lang_id", "bi", "bj", "tile"]
    sums = cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tiles(GROUPS), "lang_id long, a long, b long, value long")
    # two light terms' worth: at most ``light`` postings a term
    lists = named.filter((F.col("in") <= light) & (F.col("in") > 1)).groupBy("lang_id", "term").agg(F.sort_array(F.collect_list(F.struct("g", "p", "base"))).alias("x"))
    both = lists.select("lang_id", F.expr("inline(flatten(transform(x, (l, i) -> transform(slice(x, i + 2, size(x)), r -> struct(l AS l, r AS r)))))"))
    f = lambda p, q: f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"
    fix = f"{f('l.p', 'r.p')} - {f('l.p', 'r.base')} - {f('l.base', 'r.p')} + {f('l.base', 'r.base')}"
    fixes = both.select("lang_id", F.col("l.g").alias("a"), F.col("r.g").alias("b"), F.expr(fix).alias("value"))
    return sums.unionByName(fixes.groupBy("lang_id", "a", "b").agg(F.sum("value").alias("value"))).groupBy("lang_id", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, light: int = LIGHT, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: each group against the other sources of its language (part ``pair``) and its most telling terms (``term``).

    Terms are runs of ASCII letters, lowered, and bytes of other scripts. A language keeps those that at least ``least`` of its documents hold.
    A group's share of a kept term is 1 + floor(10^9 (count + 2) / (N + 2 V)), N the count's sum over the V kept terms; value is
    floor((p - q)^2 / (p + q)), for a pair summed over all kept terms. Null counts as the empty text, language or source; every row is a document,
    repeated ones too; empty texts make groups without terms; a language without kept terms has pairs of value 0 and no terms; equal values rank by
    UTF-8 bytes of the item. An empty table gives no rows. Other columns don't matter. The result has a row for each ordered pair of sources of a language.
    """
    small_batches(docs.sparkSession, 500)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.encode(text(text_col), "UTF-8").alias("text"))
    found = spread(rows).mapInArrow(_count(HELD, STRETCH), "lang string, source string, term string, n long, docs long")
    found = settle(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = settle(found.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term", "n"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    # groups of a language are numbered by source; one row a group
    groups = found.filter("term is null").select("lang", "source").distinct()
    held = found.filter("term is not null").join(kept.select("lang", "term", F.col("n").alias("n_all")), ["lang", "term"])
    held = settle(held.select("lang", "source", "term", "n", "n_all"), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs.withColumnRenamed("total", "total_all"), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total_all", F.lit(0)).alias("total_all"))
    groups = groups.withColumn("base", _share("0")).withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    groups = groups.withColumn("blocks", (F.max("g").over(Window.partitionBy("lang")) / GROUPS).cast("int") + 1)
    ids = groups.select("lang").distinct().withColumn("lang_id", F.row_number().over(Window.orderBy("lang")).cast("long"))
    groups = settle(groups.join(ids, "lang"), "groups")
    # few groups stand against many postings; beyond a counted bound the join is dealt by both keys
    sides = F.broadcast(groups) if groups.count() <= 50_000 else groups
    shared = held.join(sides, ["lang", "source"]).withColumn("p", _share("n")).withColumn("q", _share("n_all", "total_all"))
    shared = settle(shared.select("lang_id", "lang", "source", "g", "term", "p", "q", "base"), "shares")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    pairs = _pairs(shared.select("lang_id", "term", "g", "p", "base"), groups.select("lang_id", "g", "base", "blocks"), light)
    both = pairs.unionByName(pairs.select("lang_id", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang_id", "g", "lang", "source")
    mine, other = names.select("lang_id", F.col("g").alias("a"), "lang", "source"), names.select("lang_id", F.col("g").alias("b"), F.col("source").alias("item"))
    both = both.join(mine, ["lang_id", "a"]).join(other, ["lang_id", "b"])
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return both.unionByName(telling)
