"""Positions within groups, without a global sort and without a group in one task: counts of key prefixes, level by level."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.llm.common import stored

#: Digits of a key that a level of counts adds, and rows that a bin may have before it is cut further.
STEP, MOST = 3, 2048


def digits(number: Column) -> Column:
    """A long as 17 characters that sort as nulls first, then by value."""
    biased = number.cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(number.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(biased), 16, "0")))


def letters(text: Column) -> Column:
    """A string as characters that sort as nulls first, then by UTF-8 bytes. No key is the beginning of another."""
    return F.when(text.isNull(), F.lit("0 ")).otherwise(F.concat(F.lit("1"), F.hex(F.encode(text, "UTF-8")), F.lit(" ")))


def binned(rows: DataFrame, group: str, key: Column, first: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with column bin, the beginning of their key: `first` characters, then STEP more wherever over `most` rows (MOST) of a group share it; and the bins' counts.

    rows should be stored, since they are read once or twice; group must not be null, nor key one's that begins another. Only rows with the very same key stay
    together whatever their number.
    """
    rows, length = rows.withColumn("bin", F.substring(key, 1, first)), first
    while True:
        counts = stored(rows.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("rows")), "bins")
        full = counts.filter((F.col("rows") > (most or MOST)) & (F.length("bin") == length))
        if full.isEmpty():
            return rows, counts
        length += STEP
        marked = full.select(F.col(group).alias("__group"), F.col("bin").alias("__full"))
        joined = rows.join(marked, (F.col(group) == F.col("__group")) & (F.col("bin") == F.col("__full")), "left")
        rows = stored(joined.withColumn("bin", F.when(F.col("__full").isNull(), F.col("bin")).otherwise(F.substring(key, 1, length))).drop("__group", "__full"), "cut")


def bins_before(bins: DataFrame, group: str) -> DataFrame:
    """bins (group, bin, n: any sum to add up) with before, the sum of the group's smaller bins, and total, the sum of the group.

    Counts are added up from long prefixes to short ones; then a prefix begins where its own beginning does, plus its smaller siblings, of which there are 16^STEP at most.
    """
    least, most, longest = bins.agg(F.min("bin"), F.max("bin"), F.max(F.length("bin"))).first()
    # what all bins begin with needs no levels of its own
    shared = len(os.path.commonprefix([least or "", most or ""])) // STEP * STEP
    levels = [0, *range(max(shared, STEP), (longest or 0) + STEP, STEP)]
    up_of = dict(zip(levels[1:], levels, strict=False))
    level = F.when(F.length("bin") == 0, 0).otherwise(F.greatest(F.ceil(F.length("bin") / STEP) * STEP, F.lit(levels[1] if levels[1:] else 0)))
    here = {x: bins.filter(level == x).select(group, "bin", "n") for x in levels}
    for x in reversed(levels[1:]):
        up = here[x].groupBy(group, F.substring("bin", 1, up_of[x]).alias("bin")).agg(F.sum("n").alias("n"))
        here[up_of[x]] = stored(here[up_of[x]].unionByName(up), "level")
    begun = here[0].select(group, "bin", F.lit(0).cast("long").alias("before"), F.col("n").alias("total"))
    found = begun
    for x in levels[1:]:
        smaller = F.coalesce(F.sum("n").over(Window.partitionBy(group, "up").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nodes = here[x].withColumn("up", F.substring("bin", 1, up_of[x])).withColumn("smaller", smaller)
        above = begun.select(F.col(group).alias("__group"), F.col("bin").alias("__up"), "before", "total")
        below = nodes.join(above, (F.col(group) == F.col("__group")) & (F.col("up") == F.col("__up")))
        begun = stored(below.select(group, "bin", (F.col("before") + F.col("smaller")).alias("before"), "total"), "begun")
        found = found.unionByName(begun)
    # a bin is a whole key or a beginning that no bin goes on from, so inner prefixes drop out here
    return bins.select(group, "bin").join(found, [group, "bin"])


def ranked(rows: DataFrame, group: str, key: Column, order: list[Column], first: int, copies: str | None = None, most: int | None = None) -> DataFrame:
    """rows with rank, the number of the group's rows before it, and total, the number of all, in the order of key, which must be that of the columns in order.

    A row that stands for several (column copies) takes as many ranks, from rank on. rows should be stored.
    """
    rows, counts = binned(rows, group, key, first, most)
    one = F.col(copies) if copies else F.lit(1)
    bins = rows.groupBy(group, "bin").agg(F.sum(one).alias("n")) if copies else counts.withColumnRenamed("rows", "n")
    before = stored(bins_before(stored(bins, "sums"), group), "before")
    within = Window.partitionBy(group, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(before, [group, "bin"]).withColumn("rank", F.col("before") + F.sum(one).over(within) - one)
    return placed.drop("bin", "before")
