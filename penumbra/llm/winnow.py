"""Document fingerprints by winnowing.

Every run of K characters is hashed; in each window of WINDOW consecutive hashes the smallest is chosen, the rightmost of equal ones, and
kept with its position. Two texts that share K + WINDOW - 1 characters in a row therefore share a mark, wherever the run stands.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, WINDOW = 16, 16
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A 32-bit hash for each run of k characters; one for the whole text if it is shorter; none if it is empty."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    # a polynomial over k characters is joined from ones over 1, 2, 4, ... characters
    power, size, have = BASE, 1, codes.astype(np.uint64) + np.uint64(1)
    whole, width = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if whole is None:
                    whole, width = have, size
                else:
                    m = n - width - size + 1
                    whole, width = whole[:m] * power + have[width : width + m], width + size
            if size * 2 > k:
                break
            m = n - 2 * size + 1
            have, power, size = have[:m] * power + have[size : size + m], power * power, size * 2
        whole = (whole ^ (whole >> np.uint64(31))) * SPREAD
    return whole >> np.uint64(32)


def marks(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen by winnowing, in order of position."""
    h = gram_hashes(codes, k)
    n, w = len(h), min(window, len(h))
    if not n:
        return h.astype(np.uint32), np.zeros(0, np.int64)
    # the hash above, and below it what is smaller the further right: one minimum settles both
    low = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    size = 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: n - w + 1], low[w - size :])
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return (low >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)


def tally(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and how often each was chosen."""
    return np.unique(hashes, return_counts=True)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared part of two tallies, with repeats: a text's repetitive part counts by its length. Two empty texts are alike."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Marks as text: base64 of all hashes (little-endian uint32), then of all distances from one position to the next, the first from 0 (uint16)."""
    gaps = np.diff(positions, prepend=0)
    return base64.b64encode(hashes.astype("<u4").tobytes() + gaps.astype("<u2").tobytes()).decode()


def read_marks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a fingerprint that written() made."""
    raw = base64.b64decode(text)
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint32), np.cumsum(np.frombuffer(raw, "<u2", n, 4 * n).astype(np.int64))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Returns (doc_id, n_chars, marks array<struct<hash:bigint,position:bigint>>) for every row of docs (doc_id, text).

    No shuffle: each text is handled by itself. A null or empty text has no marks, a text shorter than k characters has one. Other columns are
    ignored, repeated rows give repeated results, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())]))
        for batch in batches:
            found, sizes = [], []
            for text in batch.column("text").to_pylist():
                codes = code_points(text or "")
                sizes.append(len(codes))
                found.append([{"hash": int(h), "position": int(p)} for h, p in zip(*marks(codes, k, window), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_chars", "marks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, marks array<struct<hash:bigint,position:bigint>>")


def _nested(cuts: Column, parts: int) -> Column:
    """A sorted array in pieces of about sqrt(parts), so that a place is found by looking at some of them."""
    piece = max(1, int(parts**0.5))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / piece).cast("int")), lambda i: F.slice(cuts, i * piece + 1, piece))


def _range_of(key: Column, nested: Column, parts: int) -> Column:
    """The number of cuts below key, by pieces and then within one: ranges are numbered from the least keys up."""
    piece = max(1, int(parts**0.5))
    before = F.greatest(F.lit(0), F.size(F.filter(nested, lambda p: p[0] < key)) - 1)
    return before * piece + F.size(F.filter(F.get(nested, before), lambda c: c < key))


def _in_ranges(source: DataFrame, parts: int) -> DataFrame:
    """source (doc_id, ...) with part, the number of a range of doc_ids. The ranges' bounds are one row of at most `parts` numbers, which is broadcast."""
    if parts == 1:
        return source.withColumn("part", F.lit(0))
    cuts = F.array_sort(F.array_distinct(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)))
    bounds = source.select("doc_id").agg(cuts.alias("cuts")).filter("cuts is not null").select(_nested(F.col("cuts"), parts).alias("cuts"))
    return source.crossJoin(F.broadcast(bounds)).withColumn("part", _range_of(F.col("doc_id"), F.col("cuts"), parts)).drop("cuts")


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """How fingerprints follow an edit: for each row of docs (doc_id, text; null text: empty), in descending doc_id, its last third is replaced
    by as many first characters (or all) of the next document's text; the last row's next is the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_marks; fingerprints hold all marks, hashes and positions (see
    read_marks). A null doc_id sorts below all others,
    equal doc_ids by text, descending. Other columns are ignored; an empty table gives no rows.

    One shuffle by ranges of doc_id, each its own partition; the largest doc_id of each range is also sent to the range above, whose last row needs it, so no row
    is looked up and no window over documents runs in one task. A task holds two texts at a time.
    """
    if not 0 < window < 1 << 16:
        raise ValueError("a window is of 1 to 65535 hashes")
    lowest = -(1 << 63)
    source = docs.select(F.col("doc_id").cast("long").alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _in_ranges(source, parts)
    # a row per range: its largest doc_id, and the next range above (of the last: the first), which needs that document's text; at most `parts` rows, one window over them
    up = W.partitionBy(F.lit(1)).orderBy("part")
    tops = placed.groupBy("part").agg(F.max("doc_id").alias("top"))
    first = F.first("part").over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = tops.select("top", F.coalesce(F.lead("part").over(up), first).alias("above"))
    own = F.struct(F.col("part"), F.lit(0).alias("peek"))
    extra = F.struct(F.col("above").alias("part"), F.lit(1).alias("peek"))
    target = F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, extra))
    dealt = (
        placed.join(F.broadcast(heads), F.col("doc_id") == F.col("top"), "left").withColumn("to", F.explode(target)).select("own", "doc_id", "text", "to.part", "to.peek")
        .repartitionById(parts, F.col("part")).sortWithinPartitions("part", "peek", F.desc("doc_id"), F.desc("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_marks"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        last, rows = None, []

        def seen(own, part, text):
            h, p = marks(codes := code_points(text), k, window)
            return own, part, text, len(codes), tally(h), written(h, p), len(h)

        for batch in batches:
            for own, text, part, peek in zip(*(batch.column(c).to_pylist() for c in ("own", "text", "part", "peek")), strict=True):
                if peek and (last is None or last[1] != part):
                    continue  # more rows with the first row's doc_id
                now = seen(own, part, text)
                if last is not None and last[1] == part:
                    _, _, old, n, hashes, print_, count = last
                    cut = n // 3
                    edited = old[: n - cut] + text[:cut]
                    h, p = marks(code_points(edited), k, window)
                    rows.append((last[0], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_, written(h, p), likeness(hashes, tally(h)), likeness(hashes, now[4]), count))
                last = None if peek else now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_marks long")
