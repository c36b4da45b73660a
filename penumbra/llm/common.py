"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that separates words: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only in local mode, where one machine runs everything, does a folder of this machine take its place if that setting is absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later jobs neither recompute it nor depend on one executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Into so many parts the rows of a key are dealt where one key may hold much of a table.
SALTS = 64


def salt_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def with_least(rows: DataFrame, key: str, value: str, least: str, salt: Column) -> DataFrame:
    """rows with the least value of their key, and n, the number of the key's rows. rows need columns key and value, which aren't null.

    Least values are found by (key, salt) first and come back the same way, so a key with most of the rows never meets in one task. salt must
    give a row the same part each time it is computed.
    """
    dealt = rows.withColumn("__salt", salt)
    parts = dealt.groupBy(key, "__salt").agg(F.min(value).alias(least), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(F.col(key).alias("__key")).agg(F.min(least).alias(least), F.sum("n").alias("n"))
    back = parts.select(F.col(key).alias("__key"), F.col("__salt").alias("__of")).join(whole, "__key")
    return dealt.join(back, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__of"))).drop("__salt", "__key", "__of")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() does that already where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows of the same doc_id apart; rows that agree in both are repeats of one another."""
    return F.xxhash64(doc_id, text)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.lower and bytes.split touch ASCII alone, and split at exactly SPACE."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def per_worker(key: str, make: Callable):
    """make(), kept until the Python worker process ends or keeps something under another key: tasks that run in it one after another share it.

    What is kept must depend on key alone and have a bounded size; one thing is kept at a time, so that the stages of a pipeline don't pile up theirs. The tasks' functions come
    with each job, so their own module can't hold it.
    """
    kept = sys.modules.setdefault("penumbra_worker_state", types.ModuleType("penumbra_worker_state")).__dict__
    if key not in kept:
        for other in [k for k in kept if not k.startswith("__")]:
            del kept[other]
        pa.default_memory_pool().release_unused()
        kept[key] = make()
    return kept[key]


#: Hashes of words that a worker keeps: a word's hash is nearly as soon computed as found, so few are kept.
HASHED = 50_000


class Memo(dict):
    """word -> make(word), forgotten as a whole once it holds `most` words; words of more than `longest` bytes or characters aren't kept. So its memory is bounded."""

    def __init__(self, make, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word):
        value = self.make(word)
        if len(word) > self.longest:
            return value
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value
