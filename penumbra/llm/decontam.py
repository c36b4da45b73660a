"""Benchmark decontamination: rare n-grams of the test items seed candidate passages, Smith-Waterman alignment scores them.

1. One pass looks for the items' n-grams in all documents (a bit table of fixed size, then an exact join) and keeps where they stand, by document.
2. An n-gram is a seed if few documents have it, or not many more than have the rarest of its item that any document has: that is about as many as hold a copy of the
   item, so an n-gram beyond it is common for other reasons. So that parts of an item that are common throughout have seeds too, the rarest of every STRETCH n-grams in a row
   is one. Nothing of this grows with the number of documents. Seeds give candidates: a document, an item, and about where it would begin.
3. Only documents with candidates are read again. Candidates are aligned with their items word by word; the score is that of the best local alignment as a share of a
   perfect copy's.
4. Items too short for that are found where they are a whole line, sentence or clause.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from penumbra.llm.common import HASHED, Memo, per_worker, row_key, stored

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: An n-gram is rare if at most FEW documents have it, or MORE times as many as have its item's rarest, or if it is the rarest of STRETCH in a row: whatever else is
#: changed, a copy is looked for that leaves STRETCH + N - 1 words in a row as they are.
FEW, MORE, STRETCH = 100, 3, 8
#: Parts that a seed's documents are dealt to.
PARTS = 16
#: Cells of alignment tables at a time.
CELLS = 1 << 20
#: What parts lines, sentences and clauses.
CLAUSE = re.compile(rb"[\n.!?;:]+")
#: 2**25 bits are 4 MB, whatever the number of items; more items than it can tell apart cost time, not results.
TABLE_BITS = 25
#: Bytes other than ASCII letters, digits and parts of longer characters part words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
M1 = np.uint64(0x9E3779B185EBCA87)


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def hasher() -> Memo:
    import xxhash

    # near-duplicate removal keeps the same numbers of words under this key
    return per_worker("hashes of words", lambda: Memo(xxhash.xxh3_64_intdigest, HASHED))


def gram_hashes(w: list[bytes], hash_of: Memo) -> np.ndarray:
    """An int64 for each run of N words; for a shorter text, one of all of it with its length."""
    h = np.fromiter(map(hash_of.__getitem__, w), np.uint64, len(w))
    size = min(N, len(h))
    if not size:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = (out ^ h[i : len(h) - size + 1 + i]) * M1
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def in_table(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.uint64) >> np.uint64(64 - TABLE_BITS)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bit_table(grams: DataFrame) -> bytes:
    """The table of the hashes in grams (hash); the driver gets 4 MB per task at most, never the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
        for batch in batches:
            slot = batch.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - TABLE_BITS)
            np.bitwise_or.at(table, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["part"])

    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for row in grams.select("hash").coalesce(8).mapInArrow(run, "part binary").toLocalIterator():
        table |= np.frombuffer(row["part"], np.uint8)
    return table.tobytes()


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of one item with each row of passages (padded with -1), and where in the row they end."""
    rows, width = passages.shape
    ramp = np.arange(width) * -GAP
    before, best, end = np.zeros((rows, width + 1), np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for word in item:
        now = np.maximum(before[:, :-1] + np.where(passages == word, MATCH, MISMATCH), before[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        # a gap in the item: the best so far in the row, less GAP for each step
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        before[:, 1:] = now
        top = now.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], now[better].argmax(axis=1)
    return best, end


def clauses(text: str | None) -> list[tuple[bytes, int]]:
    """(its words joined, the number of the text's words up to its end) of each line, sentence and clause with words; of several in a row also those of a whole line."""
    out, at = [], 0
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        parts = [b" ".join(p.translate(PLAIN).split()) for p in CLAUSE.split(line)]
        parts, begin = [p for p in parts if p], at
        for p in parts:
            at += p.count(b" ") + 1
            out.append((p, at))
        if len(parts) > 1 and at - begin <= 64:
            out.append((b" ".join(parts), at))
    return out


def items_of(benchmark: DataFrame, min_words: int) -> DataFrame:
    """(item_id, item: its words, size, slack, short, at, hash) for each n-gram of each item; a short item has one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = hasher()
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = plain_words(text)
                item, short = b" ".join(w).decode("utf-8", "surrogatepass"), len(w) < min_words
                grams = gram_hashes(w, hash_of).tolist() if not short else [clause_hash(b" ".join(w))] if w else []
                out += [(item_id, item, len(w), max(8, len(w) // 4), short, at, h) for at, h in enumerate(grams)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["item_id", "item", "size", "slack", "short", "at", "hash"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    return rows.mapInArrow(run, "item_id long, item string, size int, slack int, short boolean, at int, hash long").dropDuplicates(["item_id", "item", "at"])


def clause_hash(words: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(words, seed=1) - (1 << 63)


def occurrences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row, hash, places array<int>) of the items' n-grams in docs (doc_id, row, text); a short item's places are the ends of clauses that equal it."""
    spark = docs.sparkSession
    long_bits, short_bits = (spark.sparkContext.broadcast(bit_table(items.filter(kind))) for kind in ("not short", "short"))
    any_short = any(short_bits.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, few, hash_of = np.frombuffer(long_bits.value, np.uint8), np.frombuffer(short_bits.value, np.uint8), hasher()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        for batch in (whole.slice(start, 250) for whole in batches for start in range(0, whole.num_rows, 250)):
            out = []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                h = gram_hashes(plain_words(text), hash_of)
                found: dict[int, list[int]] = {}
                for at in np.flatnonzero(in_table(h, bits)).tolist():
                    found.setdefault(int(h[at]), []).append(at)
                if any_short:
                    for part, end in clauses(text):
                        one = clause_hash(part)
                        if in_table(np.array([one], np.int64), few)[0]:
                            found.setdefault(one, []).append(end)
                out += [(doc, row, x, places) for x, places in found.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "row", "hash", "places"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, hash long, places array<int>")


def seeds_of(items: DataFrame, found: DataFrame) -> DataFrame:
    """The n-grams in items that lead to candidates: rare ones (see FEW, MORE, STRETCH), by the number of documents in found that have them. Short items stay as they are."""
    counts = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    held = items.join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = W.partitionBy("item_id", "item")
    rarest = F.min(F.when(F.col("n") > 0, F.col("n"))).over(own)
    # the rarest of the stretch that begins here, the first of equally rare ones; one that no document has is in no stretch that a document holds
    least = F.min(F.struct("n", "at")).over(own.orderBy("at").rangeBetween(0, STRETCH - 1))
    whole = F.col("at") <= F.greatest(F.col("size") - (N - 1) - STRETCH, F.lit(0))
    held = held.withColumn("rarest", rarest).withColumn("least", F.when(whole, least["at"]))
    chosen = F.array_contains(F.collect_list("least").over(own.orderBy("at").rangeBetween(1 - STRETCH, 0)), F.col("at"))
    held = held.withColumn("rare", (F.col("n") <= F.greatest(F.lit(FEW), MORE * F.col("rarest"))) | chosen | F.col("short"))
    return held.filter("rare and n > 0").drop("n", "rarest", "least")


def _row_in(rows: DataFrame, column: str) -> Column:
    """Whether column may be among rows (hash), by a bit table of fixed size: no for most that are not."""
    table = rows.sparkSession.sparkContext.broadcast(bit_table(rows))

    @F.pandas_udf("boolean")
    def among(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.frombuffer(table.value, np.uint8)
        for x in batches:
            yield pd.Series(in_table(x.to_numpy(np.int64), bits))

    return among(column)


def aligned(pending: list[tuple], least: float) -> pa.RecordBatch | None:
    """Scores of candidates (doc_id, item_id, item, near: the window's words by their numbers in the item, or -1, first: the window's place); None if none reaches least."""
    by_item: dict = {}
    for doc, item_id, item, near, first in pending:
        by_item.setdefault((item_id, item), []).append((doc, near, first))
    out = []
    for (item_id, item), rows in by_item.items():
        words = item_codes(item)[1]
        grid = np.full((len(rows), max(len(r[1]) for r in rows)), -1)
        for n, (_, near, _) in enumerate(rows):
            grid[n, : len(near)] = near
        best, end = align(words, grid)
        for n in np.flatnonzero(best >= least * MATCH * len(words)).tolist():
            out.append((rows[n][0], item_id, round(float(best[n]) / (MATCH * len(words)), 4), rows[n][2] + int(end[n]) + 1))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "last_word"])


def item_codes(item: str) -> tuple[dict[bytes, int], np.ndarray]:
    w = item.encode("utf-8", "surrogatepass").split(b" ")
    code = {x: i for i, x in enumerate(dict.fromkeys(w))}
    return code, np.array([code[x] for x in w])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, min_words: int = 5) -> DataFrame:
    """Returns (doc_id, item_id, score, last_word): documents that hold a copy of an item, edited or not, with score >= least.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A copy is looked for wherever a rare run of N words (see seeds_of) of an item
    stands unchanged, which is so if STRETCH + N - 1 words in a row of it do; one that has no such run is not found, whatever its score. score is 1 for a word-for-word copy (rounded to 4 places); last_word
    counts the document's words up to the end of the copy, the first of equally good ones. An item of fewer than min_words words, which chance repeats within
    sentences, is found where it is a whole line, sentence or clause, with score 1. Items and texts without words, null ones among them, match nothing. A null doc_id
    or item_id is returned as such, repeated rows give one result, as do repeated items; a document with several items has a row for each. Empty tables give no rows.
    """
    items = stored(items_of(benchmark, min_words), "items")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_key(F.col("doc_id"), F.col("text"))).filter("text is not null")
    found = stored(occurrences(source, items), "occurrences")
    seeds = stored(seeds_of(items, found), "seeds")
    # a seed that very many documents have is dealt to several parts
    dealt = seeds.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = found.withColumn("part", F.pmod("row", F.lit(PARTS)).cast("int")).join(dealt, ["hash", "part"])
    begins = F.array_distinct(F.transform("places", lambda p: F.when(F.col("short"), p).otherwise(F.floor((p - F.col("at")) / F.col("slack")).cast("int"))))
    # one candidate for n-grams on nearly the same diagonal
    candidates = stored(met.select("doc_id", "row", "item_id", "item", "size", "slack", "short", F.explode(begins).alias("begin")).distinct(), "candidates")
    exact = candidates.filter("short").select("doc_id", "item_id", F.lit(1.0).alias("score"), F.col("begin").cast("long").alias("last_word"))
    asked = candidates.filter("not short")
    nothing = lambda t: F.lit(None).cast(t)
    texts = source.filter(_row_in(asked.select(F.col("row").alias("hash")), "row")).groupBy("doc_id", "row").agg(F.first("text").alias("text"))
    # a document's text comes before its candidates, so a task holds one text at a time; its candidates are dealt apart from other documents' alone
    both = texts.select("doc_id", "row", "text", *[nothing(t).alias(c) for c, t in (("item_id", "long"), ("item", "string"), ("size", "int"), ("slack", "int"), ("begin", "int"))], F.lit(0).alias("second"))
    both = both.unionByName(asked.select("doc_id", "row", nothing("string").alias("text"), "item_id", "item", "size", "slack", "begin", F.lit(1).alias("second")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, cells = [], 0
        own, coded, codes = [], None, {}
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                for doc, text, item_id, item, size, slack, begin, second in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item", "size", "slack", "begin", "second")), strict=True):
                    if not second:
                        own = plain_words(text)
                        continue
                    if item != coded:
                        coded, codes = item, item_codes(item)[0]
                    # as far as a copy can reach whose words lie a slack beside the diagonals of this candidate
                    first = max(0, (begin - 1) * slack)
                    near = [codes.get(w, -1) for w in own[first : (begin + 2) * slack + size]]
                    pending.append((doc, item_id, item, near, first))
                    cells += len(near)
                    if cells > CELLS:
                        if (made := aligned(pending, least)) is not None:
                            yield made
                        pending, cells = [], 0
        if pending and (made := aligned(pending, least)) is not None:
            yield made

    scored = both.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "second", "item_id", "item", "begin").mapInArrow(run, "doc_id long, item_id long, score double, last_word long")
    best = scored.union(exact).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("last_word")).alias("neg"))).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.score").alias("score"), (-F.col("m.neg")).alias("last_word"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose document holds no copy of an item. Rows with a null doc_id go only if a null doc_id is contaminated, null and empty texts stay; an empty table gives none."""
    bad = stored(contaminated(docs, benchmark, least).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__bad")), "left_anti")
