"""Ordered computations along a sequence, without one task for each sequence.

Rows are cut into bins of a bounded number of columns; a window function works inside a bin, and what
must cross a border does so in a table with one row for each bin (two-level prefix sums), or as a
halo: rows that a bin needs from the next ones are sent to both. Rows: one for each (key, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 4096


def binned(rows: DataFrame, pos: str, size: int | None = None) -> DataFrame:
    return rows.withColumn("__bin", F.floor(F.col(pos) / (size or BIN)))


def ranked(rows: DataFrame, key: str, pos: str, name: str = "rank", size: int | None = None) -> DataFrame:
    """``rows`` with their number (from 1) in the order of ``pos`` within ``key``."""
    b = binned(rows, pos, size)
    n = b.groupBy(F.col(key).alias("__key"), F.col("__bin").alias("__of")).agg(F.count("*").alias("__n"))
    # one row for each bin: 1/size of the rows
    earlier = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    before = n.select("__key", "__of", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(key, "__bin").orderBy(pos))
    b = b.withColumn("__nth", inside).join(before, (F.col(key) == F.col("__key")) & (F.col("__bin") == F.col("__of")))
    return b.withColumn(name, F.col("__before") + F.col("__nth")).drop("__key", "__of", "__before", "__nth", "__bin")


def moving(rows: DataFrame, key: str, pos: str, width: int, **aggregates: Column) -> DataFrame:
    """``rows`` that have ``width`` - 1 rows of their key behind them, with aggregates over themselves and those."""
    size = max(BIN, width)
    r = ranked(rows, key, pos, "__rank").withColumn("__bin", F.floor((F.col("__rank") - 1) / size))
    # the first width - 1 rows of a bin also complete the windows of the one before
    halo = (F.col("__bin") > 0) & ((F.col("__rank") - 1) % size < width - 1)
    r = r.withColumn("__in", F.explode(F.when(halo, F.array(F.col("__bin"), F.col("__bin") - 1)).otherwise(F.array("__bin"))))
    w = Window.partitionBy(key, "__in").orderBy("__rank").rowsBetween(0, width - 1)
    r = r.withColumn("__n", F.count("*").over(w)).withColumns({n: a.over(w) for n, a in aggregates.items()})
    return r.where((F.col("__in") == F.col("__bin")) & (F.col("__n") == width)).drop("__rank", "__bin", "__in", "__n")


def first_gap(rows: DataFrame, key: str, pos: str, size: int | None = None) -> DataFrame:
    """(key, stop): the last position before the first gap of each key (of its rows from the first on)."""
    b = binned(rows.select(key, pos), pos, size)
    nxt = F.lead(pos).over(Window.partitionBy(key, "__bin").orderBy(pos))
    b = b.withColumn("__next", nxt).groupBy(key, "__bin").agg(
        F.min(pos).alias("__lo"), F.max(pos).alias("__hi"), F.min(F.when(F.col("__next") > F.col(pos) + 1, F.col(pos))).alias("__gap"),
    )
    follow = F.lead("__lo").over(Window.partitionBy(key).orderBy("__bin"))
    b = b.withColumn("__follow", follow)
    end = F.coalesce(F.col("__gap"), F.when(F.col("__follow").isNull() | (F.col("__follow") > F.col("__hi") + 1), F.col("__hi")))
    return b.groupBy(key).agg(F.min(end).alias("stop"))
