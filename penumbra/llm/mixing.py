"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

Each source is cut into blocks of block_docs documents. With weight w of a total of W, its k-th block may run from slot floor(k*W/w) and must have run
by slot ceil((k+1)*W/w). In every slot the earliest deadline among the released blocks runs (ties: by name). The weights sum to
one slot per slot, so all deadlines are met and a source is never a whole block away from its share of any prefix. That schedule repeats every W slots: one
period, whose size depends on the weights alone, is computed and then laid out over all documents, with no sequential pass over data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STEPS, POWER = 20, 0.7


def schedule(lanes: DataFrame) -> DataFrame:
    """(lane, weight, total, slot, k) for one period, from one row per lane (lane, weight: positive integer).

    Lanes of one weight have the same windows, so they take turns by name: a slot chooses among weights, not lanes. The time is that of slots times different weights.
    """
    numbered = lanes.select("lane", F.col("weight").cast("long").alias("weight")).withColumn("i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("lane")).cast("long"))
    of_weight = numbered.groupBy("weight").agg(F.array_sort(F.collect_list("i")).alias("members")).withColumn("m", F.size("members").cast("long"))
    row = of_weight.agg(F.array_sort(F.collect_list(F.struct("weight", "m", "members"))).alias("classes"), F.sum(F.col("weight") * F.col("m")).alias("total"))
    # slots are gathered in about as many pieces as a piece has slots, since adding to an array copies it
    row = row.filter(F.size("classes") > 0).withColumn("piece", F.ceil(F.sqrt("total")))

    def pick(state: Column, slot: Column) -> Column:
        def window(c: Column, at: Column) -> Column:
            done = F.get(state["done"], at)
            k = F.floor(done / c["m"])
            release = F.floor(k * F.col("total") / c["weight"])
            deadline = F.ceil((k + 1) * F.col("total") / c["weight"])
            return F.when(release <= slot, F.struct(deadline.alias("deadline"), F.get(c["members"], (done % c["m"]).cast("int")).alias("i"), k.alias("k"), at.alias("at")))

        def run(best: Column) -> Column:
            return F.struct(
                F.transform(state["done"], lambda n, at: F.when(at == best["at"], n + 1).otherwise(n)).alias("done"),
                F.concat(state["slots"], F.array(F.struct(best["i"].alias("i"), best["k"].alias("k")))).alias("slots"),
            )

        # by way of an array of one, so that the best is found once
        return F.get(F.transform(F.array(F.array_min(F.array_compact(F.transform("classes", window)))), run), 0)

    none = F.array().cast("array<struct<i:bigint,k:bigint>>")

    def piece(state: Column, first: Column) -> Column:
        slots = F.sequence(first, F.least(first + F.col("piece"), F.col("total")) - 1)
        ran = F.aggregate(slots, F.struct(state["done"].alias("done"), none.alias("slots")), pick)
        return F.get(F.transform(F.array(ran), lambda r: F.struct(r["done"].alias("done"), F.concat(state["pieces"], F.array(r["slots"])).alias("pieces"))), 0)

    start = F.struct(F.transform("classes", lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<array<struct<i:bigint,k:bigint>>>").alias("pieces"))
    slots = F.flatten(F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("piece")), start, piece)["pieces"])
    ran = row.select("total", F.posexplode(slots).alias("slot", "s")).select("total", F.col("slot").cast("long").alias("slot"), F.col("s.i").alias("i"), F.col("s.k").alias("k"))
    return ran.join(numbered, "i").select("lane", "weight", "total", "slot", "k")


def order_key(doc_id: Column, seed: int) -> Column:
    """The order of a source's documents: as good as random, the same in every run."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = 1, block_docs: int = 16, seed: int = 0) -> DataFrame:
    """Adds lane, block, slot, position (longs but lane) and in_mix to all rows and columns of docs.

    weights: positive integers by source; sources that aren't named have default_weight. Without weights, they are tempered sizes: STEPS *
    (size / largest size) ** POWER, rounded, at least 1, so that a source with most of the documents doesn't have most of the mixture. Ordered by position, the rows where in_mix holds are the
    mixture: it ends at the first slot whose source has no block left, since from there the weights can't be kept; what
    other sources have beyond it is in_mix = false. Nothing is dropped here. A null source is the source "". Added columns replace ones
    of the same name, in upper or lower case. Repeated rows are rows of their own; ties in doc_id, a null one among them, go by a hash of the row. An empty table gives none.

    Ranks within a source are found in two steps, so that a source with most of the rows is spread: counts by (source, first digits of the
    key), then a rank within each such cell, which holds about 1/4096 of the source.
    """
    bad = [w for w in [*(weights or {}).values(), default_weight] if not isinstance(w, int) or w < 1]
    if bad or block_docs < 1:
        raise ValueError("weights and block_docs must be positive integers")
    added = ("lane", "block", "slot", "position", "in_mix")
    own = [c for c in docs.columns if c.lower() not in added]
    # rows of one doc_id go by a hash of all that can be hashed, so that a task that runs again deals them as before
    plain = [f.name for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    keyed = docs.select(*own, F.coalesce("source", F.lit("")).alias("lane"), order_key(F.col("doc_id"), seed).alias("__key"), F.xxhash64(*plain).alias("__tie")).withColumn("__cell", F.substr("__key", F.lit(1), F.lit(3)))
    ids = docs.select(F.coalesce("source", F.lit("")).alias("lane"), F.substr(order_key(F.col("doc_id"), seed), F.lit(1), F.lit(3)).alias("__cell"))
    # at most 4096 cells a lane
    cells = ids.groupBy("lane", "__cell").agg(F.count(F.lit(1)).alias("n"))
    before = cells.select("lane", "__cell", "n", (F.sum("n").over(W.partitionBy("lane").orderBy("__cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("__before"))
    lanes = cells.groupBy("lane").agg(F.sum("n").alias("n"))
    if weights is None:
        largest = F.max("n").over(W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        weight = F.greatest(F.lit(1), F.round(STEPS * F.pow(F.col("n") / largest, F.lit(POWER)))).cast("long")
    else:
        weight = F.lit(default_weight)
        for lane, w in weights.items():
            weight = F.when(F.col("lane") == lane, F.lit(w)).otherwise(weight)
    lanes = lanes.withColumn("weight", weight.cast("long"))
    # a row per lane, with the slot of each of its blocks in a period
    turns = schedule(lanes).groupBy("lane", "weight", "total").agg(F.array_sort(F.collect_list(F.struct("k", "slot")))["slot"].alias("slots"))
    turns = turns.join(lanes.select("lane", "n"), "lane")

    def slot_of(block: Column) -> Column:
        return F.floor(block / F.col("weight")) * F.col("total") + F.get("slots", (block % F.col("weight")).cast("int"))

    # the first block that a lane doesn't have ends the mixture
    end = turns.agg(F.min(slot_of(F.ceil(F.col("n") / block_docs))).alias("__end"))
    # the slots of the blocks that a cell has documents of: about one for block_docs documents and at most two more
    first = F.floor(F.col("__before") / block_docs)
    last = F.floor((F.col("__before") + F.col("n") - 1) / block_docs)
    places = before.join(turns.drop("n"), "lane").select("lane", "__cell", "__before", first.alias("__first"), F.transform(F.sequence(first, last), slot_of).alias("__slots"))
    place = F.row_number().over(W.partitionBy("lane", "__cell").orderBy("__key", "doc_id", "__tie"))
    ranked = keyed.withColumn("__place", place).join(places, ["lane", "__cell"]).withColumn("__rank", F.col("__before") + F.col("__place") - 1)
    placed = ranked.withColumn("block", F.floor(F.col("__rank") / block_docs)).withColumn("slot", F.get("__slots", (F.col("block") - F.col("__first")).cast("int"))).crossJoin(F.broadcast(end))
    return placed.select(*own, "lane", "block", "slot", (F.col("slot") * block_docs + F.col("__rank") % block_docs).alias("position"), (F.col("slot") < F.col("__end")).alias("in_mix"))
