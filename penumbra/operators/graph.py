"""The walkway graph: from ways to edges, connected parts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from penumbra.functions.geo import haversine

#: Kinds of ways that people walk on, and values of tags that bar or admit them.
WALKABLE, BLOCKED, ADMITTED = ("footway", "path", "pedestrian", "steps"), ("no", "private"), ("yes", "designated", "permissive")


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that all executors share; only in local mode may a folder of this machine take its place."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """df written to the shared folder and read again: loops neither grow a plan nor depend on one executor. A filter on columns named as folders (the last ones) spares reading the others."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over all tasks: a table of few bytes is read by one or two, however much is to be computed from each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def walkable(tags: Column) -> Column:
    """tags: map of a way's tags."""
    tag = lambda name: F.coalesce(F.element_at(tags, F.lit(name)), F.lit(""))
    blocked = tag("access").isin(*BLOCKED) | tag("foot").isin(*BLOCKED)
    return ~blocked & (tag("highway").isin(*WALKABLE) | ((tag("highway") == "cycleway") & tag("foot").isin(*ADMITTED)))


def edges_from_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """lo, hi, distance_m (2 places), highway from ways (way_id, pos, refs array, tags map) and nodes (node_id, lat, lon).

    Consecutive known, different nodes make an edge; of several edges between two nodes the shortest stays, the first of equal ones.
    """
    steps = ways.filter(walkable(F.col("tags"))).select("pos", F.element_at("tags", F.lit("highway")).alias("highway"), "refs", F.posexplode("refs").alias("seg", "a"))
    steps = steps.select("pos", "seg", "highway", "a", F.get("refs", F.col("seg") + 1).alias("b")).filter("b is not null and a <> b")
    end = lambda name: nodes.select(F.col("node_id").alias(name), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
    located = steps.join(end("a"), "a").join(end("b"), "b")
    distance = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    measured = located.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.struct(distance.alias("d"), F.col("pos"), F.col("seg"), F.col("highway")).alias("e"))
    best = measured.groupBy("lo", "hi").agg(F.min("e").alias("e"))
    return best.select("lo", "hi", F.round("e.d", 2).alias("distance_m"), F.col("e.highway").alias("highway"))


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst and the other columns of edges (lo, hi), each edge once in either direction."""
    rest = [c for c in edges.columns if c not in ("lo", "hi")]
    there = edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), *rest)
    return there.unionAll(edges.select(F.col("hi").alias("src"), F.col("lo").alias("dst"), *rest))


#: Into so many parts the rows of a key are dealt where one key may hold much of a table.
SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, least: str) -> DataFrame:
    """rows with the least value of their key. Rows of a key are dealt into parts by their value, looked through there, and get the answer back by part: no key's rows meet as a whole."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = dealt.groupBy(key, "__salt").agg(F.min(value).alias(least))
    whole = parts.groupBy(F.col(key).alias("__key")).agg(F.min(least).alias(least))
    back = parts.select(F.col(key).alias("__of"), F.col("__salt").alias("__part")).join(whole, F.col("__of") == F.col("__key")).drop("__key")
    return dealt.join(back, (F.col(key) == F.col("__of")) & (F.col("__salt") == F.col("__part"))).drop("__salt", "__of", "__part")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with a number from 1 in a total order. They are sorted by ranges, each numbered by itself, and moved on by how many come before: no task sees them all.

    Only the ranges' sizes are gathered, as many as there are shuffle partitions. Rows that are equal in the order may come in either.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(before), F.col("__range") == F.col("__of")).withColumn(name, F.col("__own") + F.col("__before")).drop("__range", "__own", "__of", "__before")


#: Nodes that a task looks at together when it joins edges into trees.
NODES_AT_ONCE = 250_000


def stars(edges: DataFrame, most: int = NODES_AT_ONCE, parts: int | None = None) -> DataFrame:
    """node_id, root of edges (lo, hi): neighbours in the order of ids come to one task, which says of each node on its edges the least node that these connect it with.

    A task that has seen `most` nodes tells what it has and begins anew, so a node may have several roots, all of its component: as many as there are tasks, and one more for each time that
    a task began anew. A root is a node of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while above[top] != top:
                top = above[top]
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([root(x) for x in above], pa.int64())], names=["node_id", "root"])
            above.clear()
            return out

        for batch in batches:
            for a, b in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
                a, b = root(above.setdefault(a, a)), root(above.setdefault(b, b))
                if a < b:
                    above[b] = a
                elif b < a:
                    above[a] = b
                if len(above) >= most:
                    yield told()
        if above:
            yield told()

    ends = edges.select(F.least("lo", "hi").cast("long").alias("lo"), F.greatest("lo", "hi").cast("long").alias("hi")).filter("lo <> hi")
    parts = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ends.repartitionByRange(parts, "lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(run, "node_id long, root long")


def connected(edges: DataFrame, most: int = NODES_AT_ONCE) -> DataFrame:
    """node_id, component (its least node_id) of all nodes with edges (lo, hi).

    Stars of neighbours in the order of ids stand for the edges. Only roots that share a node have an edge between them: if these edges have no more than `most` nodes, one task looks at them, else
    what they connect is found in rounds. That is so where ids say nothing of where a node lies: roots are then nearly as many as nodes.
    """
    found = kept(stars(kept(edges.select("lo", "hi"), "edges"), most).groupBy("node_id").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")), "stars")
    between = kept(found.filter(F.size("roots") > 1).select("root", F.explode("roots").alias("other")).filter("root <> other").select(F.col("root").alias("lo"), F.col("other").alias("hi")).distinct(), "between")
    known = stars(between, most, 1).select("node_id", F.col("root").alias("component")) if between.count() <= most // 2 else linked(between)
    joined = known.select(F.col("node_id").alias("__root"), "component").filter("__root <> component")
    # a root may have much of all nodes, so what is known of it goes to parts of them
    dealt = found.select("node_id", "root").withColumn("__salt", F.pmod(F.xxhash64("node_id"), F.lit(SALTS)))
    back = dealt.select(F.col("root").alias("__of"), F.col("__salt").alias("__part")).distinct().join(joined, F.col("__of") == F.col("__root")).drop("__root")
    named = dealt.join(back, (F.col("root") == F.col("__of")) & (F.col("__salt") == F.col("__part")), "left")
    return kept(named.select("node_id", F.coalesce("component", "root").alias("component")), "connected")


def linked(edges: DataFrame) -> DataFrame:
    """node_id, component as connected has them, in rounds alone.

    Nodes are hung on the least of their neighbours, above and below in turn, until nothing changes: a logarithmic number of rounds.
    """
    now = kept(edges.select(F.greatest("lo", "hi").alias("a"), F.least("lo", "hi").alias("b")).filter("a <> b").distinct(), "components")
    seen = None
    while now.limit(1).count():
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # from the second round on a component hangs on its least node, which so has nearly all of its rows
        up = with_least(both, "a", "b", "m").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        down = with_least(up, "a", "b", "m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = up.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
        now = kept(down.union(low.select(F.col("of").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "components")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node_id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
