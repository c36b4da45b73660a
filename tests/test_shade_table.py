"""The table of edge shade by bucket computes what it lacks, once."""

import tempfile

from pyspark.sql import functions as F

from penumbra.operators import shade_table
from penumbra.plans import shade


def test_only_missing_buckets_are_computed(spark):
    path, computed = f"{tempfile.mkdtemp(prefix='spark-')}/table", []

    def compute(suns):
        computed.append(sorted(str(r.bucket_start) for r in suns.collect()))
        return suns.crossJoin(spark.range(3).select(F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"), F.lit(10.0).alias("distance_m"), (F.col("id") / 4).alias("fraction")))

    first, second, night = (shade.suns(spark, tuple(shade.INSTANTS[i] for i in at)) for at in ((0, 1), (1, 2), (3,)))
    assert shade_table.edge_shade_by_bucket(first, path, compute).count() == 6
    rows = {tuple(r) for r in shade_table.edge_shade_by_bucket(first, path, compute).collect()}
    assert len(computed) == 1 and len(rows) == 6
    got = shade_table.edge_shade_by_bucket(second, path, compute)
    assert [len(c) for c in computed] == [2, 1] and computed[1] == [shade.INSTANTS[2]] and got.count() == 6
    assert {tuple(r) for r in shade_table.edge_shade_by_bucket(first, path, compute).collect()} == rows and len(computed) == 2
    asked = shade_table.edge_shade_by_bucket(night, path, compute)
    assert {r.daylight for r in asked.collect()} == {False}
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket_start" in plan or "PartitionFilters: [isnotnull(bucket_start" in plan
    assert shade_table.edge_shade_by_bucket(first.limit(0), path, compute).count() == 0 and len(computed) == 3


def test_queries_share_the_table(spark, sf, monkeypatch):
    """A second route query finds the bucket there; the same bucket gives the same rows as the whole computation."""
    known = {(r.lo, r.hi): r.fraction for r in shade.shade_at(spark, sf, shade.INSTANTS[1]).collect()}

    def refused(*_):
        raise AssertionError("computed again")

    monkeypatch.setattr(shade.shade, "edge_shade", refused)
    again = {(r.lo, r.hi): r.fraction for r in shade.shade_at(spark, sf, shade.INSTANTS[1]).collect()}
    monkeypatch.undo()
    assert again == known
    at = shade.shade_of_edges(spark, sf).filter(F.col("bucket_start") == F.lit(shade.INSTANTS[1]).cast("timestamp_ntz"))
    assert {(r.lo, r.hi): round(r.fraction, 9) for r in at.collect()} == {k: round(v, 9) for k, v in known.items()}


def test_version_follows_the_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.range(5).write.parquet(f"{folder}/a")
    first = shade_table.version_of(spark, [f"{folder}/a"])
    assert first == shade_table.version_of(spark, [f"{folder}/a"])
    spark.range(5).write.mode("append").parquet(f"{folder}/a")
    assert first != shade_table.version_of(spark, [f"{folder}/a"])
