"""Line dedup: lines that many documents share are dropped everywhere. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import SPACE, ascii_lower, row_key, stored

#: Into so many parts the rows of a common line are dealt.
PARTS = 16


def line_key(line: Column) -> Column:
    """What makes two lines the same: stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Returns (doc_id, text, n_lines, n_dropped), one row per row of docs (doc_id, text, other columns are ignored).

    A line goes if its key has at least min_chars characters and occurs in at least min_docs documents; the other
    lines stay in order. Lines are counted by a 128-bit hash of the key, once per doc_id however often it or its row is repeated.
    Only hashes, doc_ids and positions are written and shuffled for counting; counts are summed before they meet, and a line that most documents
    have goes to PARTS parts, so neither it nor one long document gathers in a task. Null or empty text: one empty line, kept. A null doc_id counts as
    one document. An empty table gives none.
    """
    source = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = line_key(F.col("line"))
    # each text is split once; the other jobs read these rows
    lines = stored(
        source.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "row", "pos", key.alias("key"))
        .filter(F.length("key") >= max(1, min_chars))
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")),
        "lines",
    )
    common = (
        lines.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs).select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    )
    gone = (
        lines.withColumn("part", F.pmod(F.xxhash64("row", "pos"), F.lit(PARTS)).cast("int")).join(common, ["h1", "h2", "part"])
        .groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
        .select(F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row"), "gone")
    )
    keyed = source.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    marked = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row") == F.col("of_row")), "left")
    split = marked.select("doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), "text")
    # what lies between one dropped position and the next stays: linear in the lines of the document
    stops = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice("lines", F.get("stops", i - 1) + 2, F.get("stops", i) - F.get("stops", i - 1) - 1)))
    return split.withColumn("stops", stops).select(
        "doc_id",
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )
