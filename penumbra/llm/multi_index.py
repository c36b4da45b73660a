"""Nearest neighbours by an inverted multi-index: each half of a vector is quantised by itself, and a vector is filed under its pair of centroids.

A query walks the pairs by the sum of its two distances, by a heap, until it has seen as many vectors as its recall needs; those are compared with it exactly. How
many that is, is measured: some vectors' true neighbours are found by comparing them with all rows, and the walk goes as far as most of them lie.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.llm.common import SALTS, salt_of, stored

#: Bounds of the fit: centroids of a half at most, vectors that the centroids are learned from, vectors whose true neighbours tell how far to walk.
CENTROIDS, SAMPLE, PROBES = 256, 16384, 100
#: Vectors and queries that are compared in one task at a time.
VECTORS, QUERIES = 4096, 1024
#: Share of the probes' true neighbours that the walk reaches.
REACHED = 0.97


class Index(NamedTuple):
    entries: DataFrame  # v, ids (its least vec_ids), least, i, j; stored
    first: np.ndarray  # centroids of the halves
    second: np.ndarray
    counts: np.ndarray  # entries by pair of centroids
    enough: int  # entries that a walk has to see


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each point, in double precision and the same whatever stands beside a point."""
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _learned(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from the first k points on; a centroid without points stays where it is."""
    centroids = points[:k].copy()
    for _ in range(rounds):
        near = ((centroids**2).sum(axis=1)[None] - 2 * points @ centroids.T).argmin(axis=1)
        sums, n = np.zeros_like(centroids), np.bincount(near, minlength=k)
        np.add.at(sums, near, points)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id (long), v (array of doubles) of rows that can have neighbours, one for each vec_id.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite components, take no part, nor do those of another length than most (the shorter, on a
    tie). Of several vectors with one id the least stays.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    fine = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    ids = fine.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("v")).alias("long"))
    ids = stored(ids, "ids")
    usual = ids.groupBy("long").count().orderBy(F.desc("count"), "long").first()
    if usual is None:
        return fine
    fine = fine.filter(F.size("v") == usual["long"])
    again = ids.filter("n > 1").select(F.col("vec_id").alias("again"))
    if again.isEmpty():
        return fine
    once = fine.join(again, F.col("vec_id") == F.col("again"), "left_anti")
    return once.unionByName(fine.join(again, F.col("vec_id") == F.col("again"), "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))


def _quantiser(first: np.ndarray, second: np.ndarray, half: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("v")))
                i, j = (_distances(p, c).argmin(axis=1).astype(np.int32) for p, c in ((x[:, :half], first), (x[:, half:], second)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i), pa.array(j)], names=[*batch.schema.names, "i", "j"])

    return assign


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with q: each from its own row alone, so that equal vectors have equal scores."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _true_neighbours(entries: DataFrame, probes: np.ndarray, names: np.ndarray, k: int) -> list:
    """(probe, i, j) of the k entries nearest to each probe, by comparing with all."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column("v")), batch.column("least").to_numpy()
            found = []
            for p, (q, name) in enumerate(zip(probes, names, strict=True)):
                scores = np.where(ids == name, -2, _scores(x, q))
                at = _best(scores, ids, k)
                found.append((np.full(len(at), p), at, scores[at]))
            p, at, s = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(s), pa.array(ids[at]), *[batch.column(c).take(pa.array(at)) for c in ("i", "j")]], names=["probe", "score", "least", "i", "j"])

    rows = entries.select("v", "least", "i", "j").mapInArrow(near, "probe long, score double, least long, i int, j int").filter("score > -2")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "least"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("probe", "i", "j").collect()


def fit(vectors: DataFrame, k: int, centroids: int = CENTROIDS, sample: int = SAMPLE, probes: int = PROBES, reached: float = REACHED) -> Index | None:
    """The index of usable vectors (vec_id, v); None if there are none.

    Equal vectors are one entry with their k + 1 least ids: no query can need more of them. The centroids are learned from a sample of `sample` entries, the walk's
    length from `probes` entries; all vectors are filed. The table of pairs, centroids² numbers, and these samples are all that comes to the driver.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first_ids = vectors.withColumn("rank", rank).filter(F.col("rank") <= k + 1)  # tasks pass on so many of a vector at most, before they meet
    classes = first_ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("least", F.element_at("ids", 1))
    classes = stored(classes, "classes")
    drawn = classes.orderBy(F.xxhash64("least"), "least").limit(sample).select("v", "least").toArrow().combine_chunks()
    if not drawn.num_rows:
        return None
    picked = drawn.column("v").combine_chunks()
    points, names = _matrix(picked), drawn.column("least").to_numpy()
    of, half = min(centroids, 1 << max(1, (max(1, classes.count() // 16)).bit_length() - 1), len(points)), points.shape[1] // 2
    unit = _unit(points)
    first, second = _learned(unit[:, :half], of if half else 1), _learned(unit[:, half:], of)
    entries = stored(classes.mapInArrow(_quantiser(first, second, half), "v array<double>, ids array<long>, least long, i int, j int"), "entries")
    counts = np.zeros((len(first), len(second)), np.int64)
    for r in entries.groupBy("i", "j").count().collect():
        counts[r.i, r.j] = r["count"]
    return Index(entries, first, second, counts, _walk_length(entries, first, second, counts, points[:probes], names[:probes], k, reached))


def _walk_length(entries: DataFrame, first: np.ndarray, second: np.ndarray, counts: np.ndarray, probes: np.ndarray, names: np.ndarray, k: int, reached: float) -> int:
    unit, half = _unit(probes), probes.shape[1] // 2
    sums = [_distances(unit[:, :half], first), _distances(unit[:, half:], second)]
    seen = []
    for r in _true_neighbours(entries, probes, names, k):
        total = sums[0][r.probe][:, None] + sums[1][r.probe][None]
        seen.append(int(counts[total <= total[r.i, r.j]].sum()))
    return max(k + 1, int(np.quantile(seen, reached, method="higher"))) if seen else k + 1


def walk(to_first: np.ndarray, to_second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """(i, n): pairs of first centroid i with the n second ones nearest to the query, such that all pairs come in order of summed distance until `enough` entries are seen.

    The heap holds, for each first centroid begun, its next pair: a first centroid begins once the one nearer than it has had its nearest pair.
    """
    order, seconds = np.argsort(to_first, kind="stable"), np.argsort(to_second, kind="stable")
    firsts, near = to_first[order].tolist(), to_second[seconds].tolist()
    entries = counts[np.ix_(order, seconds)]
    had, at, seen = [0] * len(firsts), entries.tolist(), 0
    heap = [(firsts[0] + near[0], 0)]
    while heap and seen < enough:
        _, i = heap[0]
        n = had[i]
        seen += at[i][n]
        had[i] = n = n + 1
        if n < len(near):
            heapq.heapreplace(heap, (firsts[i] + near[n], i))
        else:
            heapq.heappop(heap)
        if n == 1 and i + 1 < len(firsts):
            heapq.heappush(heap, (firsts[i + 1] + near[0], i + 1))
    totals = np.cumsum(entries, axis=1)
    return [(int(order[i]), n) for i, n in enumerate(had) if n and totals[i, n - 1]]


def _walker(index: Index):
    first, second, counts, enough = index.first, index.second, index.counts, index.enough

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("v")))
            half = x.shape[1] // 2
            both = _distances(x[:, :half], first), _distances(x[:, half:], second)
            rows = [(at, i, n) for at in range(len(x)) for i, n in walk(both[0][at], both[1][at], counts, enough)]
            at, i, n = (pa.array(np.array(c, np.int32)) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("query").take(at), batch.column("v").take(at), i, n], names=["query", "v", "i", "n"])

    return walks


def _compare(second: np.ndarray, k: int):
    def compare(entries: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query": [], "score": [], "least": [], "ids": []}
        if entries.num_rows and queries.num_rows:
            entries, queries = entries.combine_chunks(), queries.combine_chunks()
            x, j, least = _matrix(entries.column("v").combine_chunks()), entries.column("j").to_numpy(), entries.column("least").to_numpy()
            ids, q = entries.column("ids").to_pylist(), _matrix(queries.column("v").combine_chunks())
            near = np.argsort(_distances(_unit(q)[:, q.shape[1] // 2 :], second), axis=1, kind="stable")
            for query, own, order, n in zip(queries.column("query").to_pylist(), q, near, queries.column("n").to_pylist(), strict=True):
                reached = np.zeros(len(second), bool)
                reached[order[:n]] = True
                at = np.flatnonzero(reached[j])
                scores = _scores(x[at], own)
                for b in _best(scores, least[at], k + 1):
                    found["query"].append(query)
                    found["score"].append(float(scores[b]))
                    found["least"].append(int(least[at[b]]))
                    found["ids"].append(ids[at[b]])
        return pa.table(found, schema=pa.schema([("query", pa.int64()), ("score", pa.float64()), ("least", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return compare


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each usable row for which is_query (a column over vec_id) holds, the k nearest of the other rows that are found.

    Nearness is the cosine of the given vectors in double precision; ties go to the smaller vec_id. Which rows take no part says usable(); a query among them has no
    rows, one with fewer than k others has them all. Equal vectors are looked for once and compared once, so their number costs nothing; a list of the index and
    the queries that walk it are dealt out in blocks. An empty table gives no rows.
    """
    rows = stored(usable(vectors, vec_id, vector), "vectors")
    index = fit(rows, k, **options)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema)
    asked = rows.filter(is_query).withColumn("salt", salt_of("vec_id"))
    # of equal queries the least stands for all
    parts = asked.groupBy("v", "salt").agg(F.min("vec_id").alias("least"))
    whole = parts.groupBy("v").agg(F.min("least").alias("query"))
    dealt = parts.select(F.col("v").alias("__v"), F.col("salt").alias("__salt")).join(whole.withColumnRenamed("v", "__w"), F.col("__v") == F.col("__w")).drop("__w")
    members = stored(asked.join(dealt, (F.col("v") == F.col("__v")) & (F.col("salt") == F.col("__salt"))).select("vec_id", "query", "salt", "v"), "members")
    queries = members.filter("vec_id = query").select("query", "v")
    walks = stored(queries.repartition(max(1, queries.sparkSession.sparkContext.defaultParallelism), "query").mapInArrow(_walker(index), "query long, v array<double>, i int, n int"), "walks")

    lists = index.counts.sum(axis=1)
    asking = {r.i: r["count"] for r in walks.groupBy("i").count().collect()}
    blocks = [max(1, -(-int(n) // VECTORS)) for n in lists]
    shares = [max(1, -(-asking.get(i, 0) // QUERIES)) for i in range(len(lists))]
    of = lambda sizes: F.element_at(F.lit(sizes), F.col("i") + 1)
    upto = lambda sizes: F.explode(F.sequence(F.lit(0), of(sizes) - 1))
    own = lambda sizes, key: F.pmod(F.xxhash64(key), of(sizes)).cast("int")
    there = index.entries.select("v", "ids", "least", "i", "j", own(blocks, "least").alias("block")).withColumn("share", upto(shares))
    come = walks.withColumn("share", own(shares, "query")).withColumn("block", upto(blocks))
    met = there.groupBy("i", "block", "share").cogroup(come.groupBy("i", "block", "share"))
    found = met.applyInArrow(_compare(index.second, k), "query long, score double, least long, ids array<long>")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))
    kept = found.withColumn("rank", best).filter(F.col("rank") <= k + 1)
    each = F.flatten(F.transform(F.collect_list(F.struct("score", "ids")), lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("far"), i.alias("vec_id")))))
    lists_of = stored(kept.groupBy("query").agg(F.array_sort(each).alias("near")), "found")
    by_part = members.select("query", "salt").distinct().join(lists_of, "query")
    answers = members.select("vec_id", "query", "salt").join(by_part, ["query", "salt"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    return answers.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "one")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.far")).alias("score"))
