"""From raw documents to token files: five stages, each written as Parquet and read again as the documents of the next.

All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.llm import decontam, mixing, near_dedup, quality, token_output
from penumbra.llm.common import shared_folder, stored
from penumbra.llm.queries import table, tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are judged by the share of junk overall, repeated rows alike; an empty table gives none."""
    scored = quality.with_quality(docs, quality.fit_quality(docs), "__clean")
    return scored.filter(F.col("__clean") >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their runs of five words, directly or by way of others, the one with the least doc_id stays.

    Of rows with equal doc_id and text, a null doc_id or text among them, one stays. Null and empty texts are no copies of others; rows without a doc_id are no near
    copies, since nothing names them. An empty table gives none.
    """
    gone = stored(near_dedup.near_duplicates(docs, k=5, percent=80).filter("not kept").select(F.col("doc_id").alias("__gone")), "gone").distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    # repeated rows are few if any: only their keys are looked for among all rows, and only they are shuffled as a whole
    keyed = left.withColumn("__key", F.xxhash64("doc_id", "text"))
    again = stored(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("__key").alias("__again")), "repeated")
    if again.isEmpty():
        return left
    once = keyed.join(again, F.col("__key") == F.col("__again"), "left_anti")
    repeated = keyed.join(again, F.col("__key") == F.col("__again"), "left_semi").dropDuplicates(["__key", "doc_id", "text"])
    return once.unionByName(repeated).drop("__key")


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go. Null and empty texts stay, repeated rows go or stay together; an empty table gives none."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, over the files and in them: a source that has run out leaves, the others go on by their weights.

    A null source is one of its own, repeated rows stay; an empty table gives none.
    """
    rows = docs.select("doc_id", "source", F.struct("*").alias("__row"))
    return mixing.mix_sources(rows).orderBy("position").select("__row.*")


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, stored_order: bool = False) -> DataFrame:
    """Token files; returned is what is read back from them: doc_id, start, n_tokens, ids_crc32.

    They have the documents by doc_id or, with stored_order, as they lie in the files that docs was read from. Null and empty texts are the end id alone, null doc_ids come first, repeated rows are documents of their own; an empty table gives none.
    """
    path = shared_folder(spark, "corpus")
    order = None
    if stored_order:
        docs, order = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row")), ["__file", "__row"]
    token_output.write_tokens(docs, path, tokenizer_file("word_bpe_49k.json"), end_id=2, order=order)
    return token_output.read_token_digests(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("source mixing", mix_to_weights),
    ("token output", write_token_ids),
]
#: Model training, minimum hashes and tokenization have no form in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the tokens are in the order of the mixture, which is that of its files."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name.replace(" ", "-"))
        made = stage(spark, docs, sf_dir, stored_order=True) if stage is write_token_ids else stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
