"""A trie of conversations' beginnings: which share how many turns, and what storing shared turns once saves.

A node is a distinct sequence of first turns; its identity is a fingerprint that sums hashes of (place, role, text), so that all beginnings of a conversation come from
running sums. Sums over subtrees go by heavy paths: each node's child with the most conversations goes on its path, all others begin paths of their own. A way
from a light child to its parent at least halves the conversations, so paths lie in logarithmically many layers: layer by layer, from the lowest, arrays along
paths are summed from their ends, and each path's sum is added to the node that it hangs on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from penumbra.llm.common import shared_folder, stored
from penumbra.llm.ranking import binned, digits, letters, ranked

#: Turns of a conversation, nodes of a path, or conversation ids that meet in one task or array at most; longer ones go on in further blocks.
BLOCK = 4096
#: Parts into which a node's conversations are dealt.
SALTS = 64
_WORDS = ("f0", "f1", "f2", "f3")


def positions(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns (stored; conv_id, turn, role, text) with position: 0, 1, ... in a conversation by turn (null first), role and text.

    Conversations of over `block` rows are numbered by counts of key digits instead of one window, and there equal rows are counted once and dealt out again.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    small = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long") - 1
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > block).select(F.col("conv_id").alias("long")), "long")
    if sizes.isEmpty():
        return turns.withColumn("position", small)
    short = turns.join(sizes, F.col("conv_id") == F.col("long"), "left_anti").withColumn("position", small)
    long = turns.join(sizes, F.col("conv_id") == F.col("long"), "left_semi")
    once = stored(long.groupBy(*turns.columns).agg(F.count(F.lit(1)).alias("copies")), "once")
    key = F.concat(digits(F.col("turn")), letters(F.col("role")), letters(F.col("text")))
    placed = ranked(once, "conv_id", key, order, first=15, copies="copies", most=block)
    dealt = placed.select(*turns.columns, F.explode(F.expr("sequence(rank, rank + copies - 1)")).alias("position"))
    return short.unionByName(dealt)


def rebuilt(turns: DataFrame, base: Column, head: Column, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another one: rows (c, depth from 1, role, text), and all conversations (c, turns).

    base and head are columns over conv_id: conversation c takes the first head turns of base (all if fewer, none if absent), then its own after its first head.
    head has to be small: those turns are dealt to each conversation that begins with them.
    """
    placed = stored(positions(turns, block), "positions")
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", base.alias("base"), head.alias("head"))
    sizes = stored(sizes, "sizes")
    lengths = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = sizes.join(lengths, "base", "left").withColumn("taken", F.least(F.coalesce("base_own", F.lit(0)), F.col("head")))
    convs = stored(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))), "conversations")
    most = convs.agg(F.max("head")).first()[0] or 0
    heads = placed.filter(F.col("position") < most).select(F.col("conv_id").alias("base"), "position", "role", "text")
    begun = convs.select(F.col("conv_id").alias("c"), "base", "taken").join(heads, "base").filter(F.col("position") < F.col("taken"))
    rest = placed.join(convs.select("conv_id", "head", "taken"), "conv_id").filter(F.col("position") >= F.col("head"))
    rows = begun.select("c", (F.col("position") + 1).alias("depth"), "role", "text").unionByName(
        rest.select(F.col("conv_id").alias("c"), (F.col("position") - F.col("head") + F.col("taken") + 1).alias("depth"), "role", "text")
    )
    return rows, convs.select(F.col("conv_id").alias("c"), "turns")


def _beginnings(rows: DataFrame, convs: DataFrame, block: int, longest: int) -> DataFrame:
    """c, depth, node, up, bytes for each conversation and depth from 0: node is the fingerprint of the first `depth` turns, up that of one less."""
    said = F.sha2(F.concat_ws(":", F.col("depth"), F.octet_length("role"), F.col("role"), F.col("text")), 256)
    words = [F.conv(F.substring(said, 8 * i + 1, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(_WORDS)]
    hashed = rows.select("c", "depth", F.octet_length("text").alias("bytes"), *words)
    root = convs.select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).alias("bytes"), *[F.lit(0).cast("long").alias(x) for x in _WORDS])
    hashed = hashed.unionByName(root).withColumn("block", F.floor(F.col("depth") / block))
    within = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    if longest < block:
        summed = hashed.withColumns({f"s{x}": F.sum(x).over(within) for x in _WORDS})
    else:
        hashed = stored(hashed, "hashed")
        sums = hashed.groupBy("c", "block").agg(*[F.sum(x).alias(f"t{x}") for x in _WORDS])
        before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select("c", "block", *[F.coalesce(F.sum(f"t{x}").over(before), F.lit(0)).alias(f"b{x}") for x in _WORDS])
        summed = hashed.join(carried, ["c", "block"]).withColumns({f"s{x}": F.col(f"b{x}") + F.sum(x).over(within) for x in _WORDS})
    node = F.md5(F.concat_ws(":", "depth", *[f"s{x}" for x in _WORDS]))
    up = F.md5(F.concat_ws(":", F.col("depth") - 1, *[F.col(f"s{x}") - F.col(x) for x in _WORDS]))
    return summed.select("c", "depth", "block", "bytes", node.alias("node"), F.when(F.col("depth") > 0, up).alias("up"))


def _nodes(rows: DataFrame, block: int, longest: int) -> DataFrame:
    """A row for each node: its conversations' least and number, its children, and the path that it lies on (head, and layer: light nodes from the root to it).

    A node with much of all conversations never meets in one task: its rows are dealt into parts, counted there, and get the node's values back by part.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)))
    parts = stored(dealt.groupBy("node", "salt").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n"), F.first("up").alias("up"), F.first("depth").alias("depth")), "parts")
    whole = stored(parts.groupBy("node").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.first("up").alias("up"), F.first("depth").alias("depth")), "whole")
    best = F.max(F.struct(F.col("n"), (-F.col("least")).alias("small"), F.col("node"))).alias("best")
    families = stored(whole.filter("up is not null").groupBy("up").agg(best, F.count(F.lit(1)).alias("n_children")).select("up", F.col("best.node").alias("heavy"), "n_children"), "families")
    # each of these keys is one row on both sides
    marked = whole.join(families.select("heavy"), F.col("node") == F.col("heavy"), "left").withColumn("light", F.col("heavy").isNull())
    known = marked.join(families.select(F.col("up").alias("__of"), "n_children"), F.col("node") == F.col("__of"), "left")
    known = known.select(F.col("node").alias("__node"), F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), "light")
    back = stored(parts.select("node", "salt").join(known, F.col("node") == F.col("__node")).drop("__node"), "back")
    # only rows of a conversation that is some node's least matter from here on, but all of its rows, since they are the node's way up
    told = dealt.join(back, ["node", "salt"])
    lights = F.when(F.col("light"), F.struct("depth", F.col("node").alias("head"), "up"))
    within = Window.partitionBy("c", "block").orderBy("depth")
    grow = within.rowsBetween(Window.unboundedPreceding, 0)
    on_path = told.withColumns({"top": F.max(lights).over(grow), "layer": F.sum(F.col("light").cast("long")).over(grow), "parent_conv_id": F.lag("conv_id").over(within)})
    if longest >= block:
        told = stored(told, "told")
        ends = told.groupBy("c", "block").agg(F.max(lights).alias("top"), F.sum(F.col("light").cast("long")).alias("layer"), F.max_by("conv_id", "depth").alias("last"))
        before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("c", "block", F.max("top").over(before).alias("top_before"), F.coalesce(F.sum("layer").over(before), F.lit(0)).alias("layer_before"), F.lag("last").over(Window.partitionBy("c").orderBy("block")).alias("last_before"))
        own = told.withColumns({"top": F.max(lights).over(grow), "layer": F.sum(F.col("light").cast("long")).over(grow), "parent_conv_id": F.lag("conv_id").over(within)})
        on_path = own.join(carried, ["c", "block"]).withColumns(
            {"top": F.coalesce("top", "top_before"), "layer": F.col("layer") + F.col("layer_before"), "parent_conv_id": F.coalesce("parent_conv_id", "last_before")}
        )
    return on_path.filter("c = conv_id").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "layer", F.col("top.head").alias("head"), F.col("top.up").alias("hangs_on"), F.col("top.depth").alias("head_depth"),
        ((F.col("n_convs") - 1) * F.col("bytes")).cast("long").alias("saved"),
    )


@F.pandas_udf(ArrayType(LongType()))
def _from_the_end(values: pd.Series) -> pd.Series:
    """Each element with all after it."""
    return values.map(lambda x: np.cumsum(np.asarray(x, np.int64)[::-1])[::-1])


def _subtree_sums(nodes: DataFrame, block: int) -> DataFrame:
    """node, n_leaves, saved_tokens: sums over subtrees, layer by layer of heavy paths, each read and written once."""
    spark = nodes.sparkSession
    layers, longest = nodes.agg(F.max("layer"), F.max(F.col("depth") - F.col("head_depth"))).first()
    if layers is None:
        return nodes.select("node", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    by_layer = shared_folder(spark, "layers")
    nodes.select("node", "depth", "n_children", "layer", "head", "hangs_on", "head_depth", "saved").write.partitionBy("layer").parquet(by_layer)
    split, sums, done, hung = spark.read.parquet(by_layer), ("leaves", "gain"), [], None
    for layer in range(layers, 0, -1):
        own = split.filter(F.col("layer") == layer).withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "gain": F.col("saved")})
        if hung is not None:
            own = own.join(hung, F.col("node") == F.col("on"), "left").withColumns({x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0)) for x in sums})
        part = own.withColumn("block", F.floor((F.col("depth") - F.col("head_depth")) / block))
        arrays = part.groupBy("head", "block").agg(F.first("hangs_on").alias("hangs_on"), F.array_sort(F.collect_list(F.struct("depth", "node", *sums))).alias("path"))
        ends = arrays.select("head", "block", "hangs_on", F.col("path.node").alias("nodes"), *[_from_the_end(F.col(f"path.{x}")).alias(x) for x in sums])
        if longest >= block:
            # later blocks of a path add their wholes
            ends = stored(ends, "ends")
            after = Window.partitionBy("head").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
            later = ends.select("head", "block", *[F.element_at(x, 1).alias(x) for x in sums]).select("head", "block", *[F.coalesce(F.sum(x).over(after), F.lit(0)).alias(f"later_{x}") for x in sums])
            ends = ends.join(later, ["head", "block"])
        else:
            ends = ends.withColumns({f"later_{x}": F.lit(0) for x in sums})
        each = ends.select("head", "hangs_on", *[f"later_{x}" for x in sums], F.explode(F.arrays_zip("nodes", *sums)).alias("one"))
        each = each.select("head", "hangs_on", F.col("one.nodes").alias("node"), *[(F.col(f"one.{x}") + F.col(f"later_{x}")).alias(x) for x in sums])
        done.append(stored(each, "sums"))
        hung = done[-1].filter((F.col("node") == F.col("head")) & F.col("hangs_on").isNotNull()).groupBy(F.col("hangs_on").alias("on")).agg(*[F.sum(x).alias(f"more_{x}") for x in sums])
    everything = done[0]
    for x in done[1:]:
        everything = everything.unionByName(x)
    return everything.select("node", F.col("leaves").alias("n_leaves"), F.col("gain").alias("saved_tokens"))


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ids_sha256 from rows (node, ids) that come node by node and in order: a hash that grows, never the whole list."""
    current, grown, nodes, digests = None, None, [], []
    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != current:
                if current is not None:
                    nodes.append(current)
                    digests.append(grown.hexdigest())
                current, grown = node, hashlib.sha256(ids.encode())
            else:
                grown.update(b"," + ids.encode())
    if current is not None:
        nodes.append(current)
        digests.append(grown.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(digests, pa.string())], names=["node", "ids_sha256"])


def id_digests(members: DataFrame, most: int = BLOCK) -> DataFrame:
    """node, ids_sha256: SHA-256 of the ids of each node (members: stored rows node, c), ascending and joined by commas.

    Lists are built in parts of up to `most` neighbouring ids; a node with several parts has them hashed one after another as they stream by, since this hash can't
    be put together from parts.
    """
    cut, _ = binned(members, "node", digits(F.col("c")), first=0, most=most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    lists = cut.groupBy("node", "bin").agg(joined.alias("ids"))
    whole = lists.filter("bin = ''").select("node", F.sha2("ids", 256).alias("ids_sha256"))
    streamed = lists.filter("bin <> ''").repartition("node").sortWithinPartitions("node", "bin").select("node", "ids").mapInArrow(_stream_digests, "node string, ids_sha256 string")
    return whole.unionByName(streamed)


def prefix_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of conversations' beginnings: conv_id (the least that begins so), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the bytes of a node's last text), ends_sha256 (ids of the conversations that end here).

    conversations needs conv_id, turn, role, text. With base and head (columns over conv_id) each conversation first takes the beginning of another, see rebuilt.
    Rows of a conversation go by turn, null first, then by role and text; null role and text are empty; repeated rows are turns of their own. Rows without a conv_id belong
    to no conversation. No conversations, no nodes; a conversation without turns is a member of the root alone.
    """
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = stored(turns, "turns")
    rows, convs = rebuilt(turns, base if base is not None else F.col("conv_id"), head if head is not None else F.lit(0), block)
    convs = stored(convs, "convs")
    longest = convs.agg(F.max("turns")).first()[0] or 0
    begun = stored(_beginnings(rows, convs, block, longest), "beginnings")
    nodes = stored(_nodes(begun, block, longest), "nodes")
    ends = stored(begun.join(convs.withColumnRenamed("c", "__c"), (F.col("c") == F.col("__c")) & (F.col("depth") == F.col("turns"))).select("node", "c"), "ends")
    whole = nodes.join(_subtree_sums(nodes, block), "node").join(id_digests(ends, block), "node", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ids_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
