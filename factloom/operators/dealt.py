"""Equi-joins whose hot keys are dealt over cells of bounded size.

A key with n rows on one side and m on the other is n * m row pairs, whoever computes them. Here such a key is cut
into blocks of at most about ``CELL`` rows a side, and each pair of blocks is a key of its own; so no task gets more than a cell at a time,
whatever share of the rows a key has. Keys that are not hot are one cell and are copied nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.shared import settle

CELL = 2048
#: Hot keys that are sent to every task at most; more are joined.
FEW = 10_000


def _blocks(rows: DataFrame, keys: list[str], name: str, cell: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / cell).cast("int").alias(name))


def _tagged(rows: DataFrame, hot: DataFrame, keys: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(hot) if few else hot, keys, "left")


def _own(rows: DataFrame, count: str) -> Column:
    """A row's block, by its contents; rows that are alike in all columns share one."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce(F.col(count), F.lit(1))).cast("int")


def meet(left: DataFrame, right: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """The inner join on ``keys`` (not null), hot keys dealt. Both frames are read twice: settle dear ones. Other columns must have names of their own."""
    hot = _blocks(left, keys, "_nl", cell).join(_blocks(right, keys, "_nr", cell), keys).filter("_nl > 1 or _nr > 1")
    hot = settle(hot, "hot")
    n = hot.count()
    if not n:
        return left.join(right, keys)
    few = n <= FEW
    every = lambda count: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1))
    a = _tagged(left, hot, keys, few).withColumn("_i", _own(left, "_nl")).withColumn("_j", every("_nr")).drop("_nl", "_nr")
    b = _tagged(right, hot, keys, few).withColumn("_j", _own(right, "_nr")).withColumn("_i", every("_nl")).drop("_nl", "_nr")
    return a.join(b, [*keys, "_i", "_j"]).drop("_i", "_j")


def blocks(rows: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """Rows whose key another row has, in cells (keys, _i, _j) of at most about two blocks of ``cell`` rows; ``_own`` is a row's block.

    Each two rows of a key meet once: where _i = _j any two, else only those of different blocks.
    """
    sizes = settle(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys, F.ceil(F.col("_n") / cell).cast("int").alias("_n")), "sizes")
    tagged = rows.join(sizes, keys).withColumn("_own", _own(rows, "_n")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return tagged.withColumns({"_i": F.least("_own", "_o"), "_j": F.greatest("_own", "_o")}).drop("_n", "_o")


def pairs(rows: DataFrame, keys: list[str], order: str, cell: int = CELL) -> DataFrame:
    """Each two rows that agree in ``keys`` once, columns with ``_a`` for the one with the smaller ``order`` (unique within a key) and ``_b`` for the other.

    A hot key's blocks meet in the triangle of their pairs, so a pair is looked at once and no product with itself is mirrored.
    """
    hot = settle(_blocks(rows, keys, "_n", cell).filter("_n > 1"), "hot")
    n = hot.count()
    tagged = _tagged(rows, hot, keys, n <= FEW).withColumn("_own", _own(rows, "_n")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
    tagged = tagged.withColumns({"_i": F.least("_own", "_o"), "_j": F.greatest("_own", "_o")}).drop("_n", "_o")
    rest = [c for c in rows.columns if c not in keys]
    side = lambda tag: tagged.select(*keys, "_i", "_j", *[F.col(c).alias(f"{c}_{tag}") for c in [*rest, "_own"]])
    # in a cell of two blocks the pairs run between them, in a cell of one inside it
    between = (F.col("_i") == F.col("_j")) | (F.col("_own_a") != F.col("_own_b"))
    both = side("a").join(side("b"), [*keys, "_i", "_j"]).filter(F.col(f"{order}_a") < F.col(f"{order}_b")).filter(between)
    return both.drop("_i", "_j", "_own_a", "_own_b")
