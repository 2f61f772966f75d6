"""The prefix trie of conversations, by distributed radix partitioning.

Turns are dictionary-encoded: distinct (role, text) are sorted and numbered, so ids order like the turns. A bucket is
the set of conversations below one node. From the root on, each round of most-significant-digit partitioning

1. finds how far the conversations of each large bucket agree (an aggregate by bucket and depth, combined before the
   shuffle), and emits the nodes of that common stretch at once, however long it is;
2. deals the conversations that go on by their next turn id into child buckets.

A bucket with at most ``LOCAL`` turns and conversations left is finished in one task by multikey quicksort, which emits
the nodes while it recurses; others go on to the next round. Subtree sums flow up round by round. No conversation
and no bucket is ever held whole unless it is small: positions and running word counts come from ranges of the sorted turns,
so one conversation may fill a third of the table, and so may copies of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import textkit as T
from factloom.shared import forget, settle

#: Turns and conversations of a bucket that one task finishes at most.
LOCAL = 4096
#: Conversations that share the start of the first of them, and turns that they may share.
FAMILY, HEADS = 20, 4
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_TOP = ["b", "d"]


def encode_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, tid, words, u (tells repeated rows apart). tid numbers the distinct (role, text) in their order."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text")).filter("conv is not null")
    turns = turns.withColumn("u", F.monotonically_increasing_id())
    distinct = settle(turns.select("role", "text").distinct(), "distinct")
    numbered = distinct.repartitionByRange("role", "text").sortWithinPartitions("role", "text").withColumn("tid", F.monotonically_increasing_id())
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")
    numbered = settle(numbered.withColumn("words", words), "turns")
    out = settle(turns.join(numbered, ["role", "text"]).select("conv", "turn", "tid", "words", "u"), "encoded")
    forget(distinct, numbered)
    return out


def number_turns(encoded: DataFrame) -> DataFrame:
    """conv, i (from 1), tid, words, run (words up to and with this turn), by turn (null first), then role and text.

    Rows are sorted in ranges; counts of the ranges before it place each range of a conversation.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("tid"), F.col("u")]
    ranged = settle(encoded.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    here = Window.partitionBy("conv", "part").orderBy(*order[1:])
    local = ranged.withColumns({"i": F.row_number().over(here).cast("long"), "run": F.sum("words").over(here.rowsBetween(Window.unboundedPreceding, 0))})
    past = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    offsets = offsets.select("conv", "part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("i0"), F.coalesce(F.sum("w").over(past), F.lit(0)).alias("w0"))
    # only conversations that lie in several ranges have anything to add
    offsets = offsets.filter("i0 > 0")
    joined = local.join(offsets, ["conv", "part"], "left")
    return joined.select("conv", (F.col("i") + F.coalesce("i0", F.lit(0))).alias("i"), "tid", "words", (F.col("run") + F.coalesce("w0", F.lit(0))).alias("run"))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, len) of each conversation, and (conv, pos, tid, words, run) of its turns after it took its family's first ones.

    Conversation c starts with the first h = crc32(c) % 4 turns of c - c % 20 and goes on with its own after its first h.
    """
    first = F.col("i") < HEADS
    heads = F.sort_array(F.collect_list(F.when(first, F.struct("i", "tid", "words", "run"))))  # three at most
    convs = settle(turns.groupBy("conv").agg(heads.alias("heads"), F.max("i").alias("n")), "convs")
    base = convs.select(F.col("conv").alias("base"), F.col("heads").alias("given"))
    plans = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).cast("int"))
    plans = plans.join(base, "base", "left").withColumn("given", F.coalesce(F.expr("slice(given, 1, h)"), F.array().cast("array<struct<i:bigint,tid:bigint,words:bigint,run:bigint>>")))
    dropped = F.least(F.col("h").cast("long"), F.col("n"))
    plans = plans.select(
        "conv", "h", "given", F.size("given").alias("k"), (F.size("given") + F.col("n") - dropped).alias("len"),
        (F.coalesce(F.get("given", F.size("given") - 1).getField("run"), F.lit(0)) - F.coalesce(F.get("heads", dropped.cast("int") - 1).getField("run"), F.lit(0))).alias("shift"),
    )
    plans = settle(plans, "plans")
    taken = plans.select("conv", F.inline("given")).select("conv", F.col("i").alias("pos"), "tid", "words", "run")
    own = turns.join(plans.select("conv", "h", "k", "shift"), "conv").filter(F.col("i") > F.col("h"))
    own = own.select("conv", (F.col("i") - F.col("h") + F.col("k")).alias("pos"), "tid", "words", (F.col("run") + F.col("shift")).alias("run"))
    seq = settle(taken.unionByName(own), "sequences")
    return settle(plans.select("conv", F.col("len").cast("long").alias("len")), "lengths"), seq


# -- buckets of one task ------------------------------------------------------------------------------------------------


def _digest(ids: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class _Nodes:
    """Nodes of one bucket in the order the recursion meets them: parents come before their children."""

    def __init__(self):
        self.conv, self.depth, self.parent, self.n, self.kids, self.leaves, self.saved, self.ends = ([] for _ in range(8))

    def add(self, conv: int, depth: int, parent: int, n: int, words: int, ends: str) -> int:
        at = len(self.conv)
        for column, value in zip((self.conv, self.depth, self.parent, self.n, self.kids, self.leaves, self.saved, self.ends), (conv, depth, parent, n, 0, 0, (n - 1) * words, ends), strict=True):
            column.append(value)
        if parent >= 0:
            self.kids[parent] += 1
        return at

    def rows(self, above: int | None) -> list[tuple]:
        for i in range(len(self.conv) - 1, -1, -1):
            if not self.kids[i]:
                self.leaves[i] = 1
            if (p := self.parent[i]) >= 0:
                self.leaves[p] += self.leaves[i]
                self.saved[p] += self.saved[i]
        over = [above if p < 0 else self.conv[p] for p in self.parent]
        return list(zip(self.conv, self.depth, over, self.n, self.kids, self.leaves, self.saved, self.ends, strict=True))


def multikey_nodes(top_depth: int, above: int | None, top_words: int, convs: np.ndarray, starts: np.ndarray, lens: np.ndarray, tids: np.ndarray, words: np.ndarray) -> list[tuple]:
    """The nodes below and at a bucket's top. Conversation k has turns ``starts[k] : starts[k] + lens[k]`` beyond the top's depth.

    Multikey quicksort: a segment of conversations that agree so far is split by one turn into smaller, equal and
    larger; the equal ones share a node, are sorted on by their next turn, and never compared by earlier turns again.
    """
    nodes = _Nodes()
    work: list[tuple[np.ndarray, int, int]] = []

    def enter(seg: np.ndarray, depth: int, parent: int, w: int) -> None:
        """A node for the conversations of seg, which share depth turns beyond the top."""
        over = seg[lens[seg] == depth]
        me = nodes.add(int(convs[seg].min()), top_depth + depth, parent, len(seg), w, _digest(np.sort(convs[over]).tolist()) if len(over) else _EMPTY)
        if len(over) < len(seg):
            work.append((seg if not len(over) else seg[lens[seg] > depth], depth, me))

    enter(np.arange(len(convs)), 0, -1, top_words)
    while work:
        seg, depth, parent = work.pop()
        if len(seg) == 1:
            # nothing to compare with: the rest of it is a chain
            k = int(seg[0])
            for d in range(depth + 1, int(lens[k]) + 1):
                parent = nodes.add(int(convs[k]), top_depth + d, parent, 1, 0, _digest([int(convs[k])]) if d == lens[k] else _EMPTY)
            continue
        at = starts[seg] + depth
        digit = tids[at]
        pivot = digit[len(digit) // 2]
        less, more = digit < pivot, digit > pivot
        for side in (less, more):
            if side.any():
                work.append((seg[side], depth, parent))
        same = ~(less | more)
        enter(seg[same], depth + 1, parent, int(words[at[same][0]]))
    return nodes.rows(above)


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, d, conv, pos), with a first row for each conversation at the top's own depth (words: of the top's turn)."""
    names = ["b", "d", "above", "conv", "pos", "tid", "words"]
    held: list[np.ndarray] = []
    out: list[tuple] = []

    def solve(rows: np.ndarray, above: int | None) -> None:
        depth = int(rows[0, 1])
        head = np.flatnonzero(rows[:, 4] == depth)
        lens = np.diff(np.append(head, len(rows))) - 1
        out.extend(multikey_nodes(depth, above, int(rows[0, 6]), rows[head, 3], head + 1, lens, rows[:, 5], rows[:, 6]))

    def table() -> pa.RecordBatch:
        nonlocal out
        cols = list(zip(*out, strict=True)) or [()] * 8
        out = []
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])

    def whole(last: bool) -> None:
        """All buckets that are complete in what is held."""
        nonlocal held
        rows = np.concatenate(held)
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        edges = [0, *cuts.tolist(), *([len(rows)] if last else [])]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            solve(rows[a:z], None if rows[a, 2] == np.iinfo(np.int64).min else int(rows[a, 2]))
        held = [] if last else [rows[edges[-1] :]]

    for b in batches:
        if b.num_rows:
            held.append(np.column_stack([T.id_array(b.column(c).fill_null(np.iinfo(np.int64).min) if c == "above" else b.column(c)) for c in names]))
            whole(False)
            if len(out) > 10_000:
                yield table()
    if held:
        whole(True)
    yield table()


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, conv): the digest of each node's ids, as a stream."""
    node, sha, out = None, None, []
    for batch in batches:
        for b, d, conv in zip(*(batch.column(c).to_pylist() for c in ("b", "at", "conv")), strict=True):
            if (b, d) != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (b, d), hashlib.sha256(str(conv).encode())
            else:
                sha.update(b",%d" % conv)
    if node:
        out.append((*node, sha.hexdigest()))
    cols = list(zip(*out, strict=True)) or [()] * 3
    yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["b", "at", "ends"])


# -- the rounds ---------------------------------------------------------------------------------------------------------


def trie(lengths: DataFrame, seq: DataFrame, local: int = LOCAL) -> DataFrame:
    """Nodes of sequences given as (conv, len) and (conv, pos from 1, tid, words, run: words so far)."""
    # b: smallest conversation of the bucket, d: depth of its node; both name it
    root = settle(lengths.agg(F.min("conv").alias("b"), F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("above"), F.count("*").alias("n"), F.sum("len").alias("rest"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("run")), "root")
    buckets = root.filter("n > 0")
    members = lengths.withColumns({"b": F.lit(root.first()["b"]).cast("long"), "d": F.lit(0).cast("long")})
    rounds, finished = [], []
    small = (F.col("rest") + F.col("n")) <= local
    while True:
        done, big = buckets.filter(small), settle(buckets.filter(~small), "big")
        here = members.join(done.select(*_TOP, "above", "words"), _TOP)
        head = here.select(*_TOP, "above", "conv", F.col("d").alias("pos"), F.lit(-1).cast("long").alias("tid"), "words")
        turns = seq.join(here.filter("len > d").select(*_TOP, "above", "conv"), "conv").filter("pos > d").select(*_TOP, "above", "conv", "pos", "tid", "words")
        rows = head.unionByName(turns).repartition(*_TOP).sortWithinPartitions(*_TOP, "conv", "pos")
        finished.append(settle(rows.mapInArrow(_finish, _NODE), "local"))
        if big.isEmpty():
            break
        left = settle(members.join(big.select(*_TOP, "n"), _TOP), "members")
        open_rows = settle(seq.join(left.select(*_TOP, "conv", "n"), "conv").filter("pos > d").select(*_TOP, "n", "conv", "pos", "tid", "words", "run"), "open")
        # how far a bucket's conversations agree; one row a bucket and depth
        agree = settle(open_rows.groupBy(*_TOP, "n", "pos").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.count("*").alias("c"), F.min("words").alias("words"), F.min("run").alias("run")), "agree")
        split = (F.col("c") < F.col("n")) | (F.col("lo") != F.col("hi"))
        reach = agree.groupBy(*_TOP).agg((F.min(F.when(split, F.col("pos"))) - 1).alias("parting"), F.max("pos").alias("last"))
        reach = settle(big.join(reach, _TOP, "left").withColumn("at", F.coalesce("parting", "last", "d")).drop("parting", "last"), "reach")
        stop = reach.select(*_TOP, "at")
        chain = agree.join(stop, _TOP).filter("pos <= at").select(*_TOP, "pos", "words", "run")
        chain = chain.unionByName(reach.select(*_TOP, F.col("d").alias("pos"), "words", "run"))
        # the digit: the turn after the common stretch
        digit = open_rows.join(F.broadcast(stop) if stop.count() <= 10_000 else stop, _TOP).filter(F.col("pos") == F.col("at") + 1)
        digit = digit.join(left.select("conv", "len"), "conv").select(F.col("b").alias("pb"), F.col("d").alias("pd"), "at", "conv", "len", "tid", "words", "run")
        digit = settle(digit, "digits")
        kids = digit.groupBy("pb", "pd", "at", "tid").agg(F.min("conv").alias("b"), F.count("*").alias("n"), F.sum(F.col("len") - F.col("at") - 1).alias("rest"), F.min("words").alias("words"), F.min("run").alias("run"))
        kids = settle(kids.withColumn("d", F.col("at") + 1), "kids")
        over = left.join(F.broadcast(stop) if stop.count() <= 10_000 else stop, _TOP).filter(F.col("len") == F.col("at")).select("b", "at", "conv")
        ends = settle(over.repartition("b", "at").sortWithinPartitions("b", "at", "conv").mapInArrow(_ends, "b long, at long, ends string"), "ends")
        rounds.append((reach, settle(chain, "chain"), kids.select("pb", "pd", "b", "d"), ends))
        buckets = kids.select("b", "d", F.col("pb").alias("above"), "n", "rest", "words", "run")
        members = settle(digit.join(kids.select("pb", "pd", "tid", "b", "d"), ["pb", "pd", "tid"]).select("b", "d", "conv", "len"), "members")
        forget(open_rows, agree, left, digit)
    # sums flow up: a child's totals are those of its local node or of its own round
    totals = None
    upper = []
    for k, (reach, chain, kids, ends) in reversed(list(enumerate(rounds))):
        tops = finished[k + 1].select(F.col("conv_id").alias("b"), F.col("depth").alias("d"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        tops = tops.unionByName(totals) if totals is not None else tops
        below = kids.join(tops, _TOP).groupBy(F.col("pb").alias("b"), F.col("pd").alias("d")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
        ground = reach.withColumnRenamed("run", "top_run").select(*_TOP, "above", "n", "at").join(below, _TOP, "left").join(ends, ["b", "at"], "left")
        bottom = chain.select(*_TOP, F.col("pos").alias("at"), F.col("run").alias("end_run"))
        ground = ground.join(bottom, [*_TOP, "at"]).withColumns({"kids": F.coalesce("kids", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "below": F.coalesce("below", F.lit(0))})
        whole = chain.join(F.broadcast(ground) if ground.count() <= 10_000 else ground, _TOP)
        last = F.col("pos") == F.col("at")
        nodes = settle(whole.select(
            F.col("b").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("d"), F.col("above")).otherwise(F.col("b")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
            (F.col("below") + (F.col("n") - 1) * (F.col("end_run") - F.col("run") + F.col("words"))).alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(_EMPTY))).otherwise(_EMPTY).alias("ends_sha256"),
            F.col("d").alias("_d"),
        ), "upper")
        totals = nodes.filter("depth = _d").select(F.col("conv_id").alias("b"), F.col("depth").alias("d"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        upper.append(nodes.drop("_d"))
    out = finished[0]
    for part in [*finished[1:], *upper]:
        out = out.unionByName(part)
    return out


def prefix_trie(conversations: DataFrame, local: int = LOCAL, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns stand by turn, null first, then by role and text; null role or text counts as empty; rows without a conversation are left out.
    Each conversation first takes over the first turns of its family (``rebuild``), which may leave it without any; it is then a member of the root
    alone, where it ends. Repeated rows are turns of their own. Equal turns are equal in role and whole text. Without rows there are no nodes. Other columns don't matter.
    ``ends_sha256`` digests one stream of ids, so the ids of equal conversations pass through one task, a number each.
    """
    lengths, seq = rebuild(number_turns(encode_turns(conversations, conv, turn, role, text)))
    return trie(lengths, seq, local)
