"""Token-ID output: Simple-8b coded ids in blocks, written and read with Spark.

The file format is a Parquet dataset with one row per chunk of whole documents, in ascending doc_id order by (shard, chunk):
shard int, chunk int, before long (ids of the shard before the chunk), doc_ids array<long>, n_tokens array<int>, payload binary.

A payload is little-endian: magic "S8B1", uint32 n_ids, uint32 n_blocks, uint32 n_escapes; uint32 first word of each block and, last, their number;
uint32 first escape of each block and, last, their number; uint32 escapes; uint64 words. Blocks hold BLOCK ids (the last: the rest).
A word's top four bits select how many ids of how many bits it holds, lowest first; the id whose bits are all ones stands for the block's next
escape. A block's last word may be partly used: the block's number of ids tells. Any block is decoded from its two offsets alone.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from penumbra.llm.common import Memo, per_worker

MAGIC, BLOCK = b"S8B1", 256
#: (ids, bits) by selector: a word's 60 payload bits in equal parts.
SHAPES = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS, BITS = (np.array(x) for x in zip(*SHAPES, strict=True))
#: At most this share of a payload's ids become escapes.
ESCAPED = 0.03
PAD = int(COUNTS.max())
#: Blocks that are coded at a time, which bounds the memory that a long text takes beside its ids.
AT_ONCE = 4096
#: Texts of a batch that are Python strings at a time.
AT_ONCE_TEXTS = 256
FILE = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.ArrayType(T.IntegerType())), T.StructField("payload", T.BinaryType())])


#: Bits of the narrowest shape in which an id below 2**16 isn't all ones.
NARROW = BITS[np.searchsorted((1 << BITS) - 1, np.arange(1 << 16), side="right")].astype(np.uint8)


def _grid(flat: np.ndarray, blocks: int) -> np.ndarray:
    """A row per block, with PAD zeros to the right."""
    out = np.zeros((blocks, BLOCK + PAD), flat.dtype)
    whole = len(flat) // BLOCK
    out[:whole, :BLOCK] = flat[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        out[whole, : len(flat) - whole * BLOCK] = flat[whole * BLOCK :]
    return out


def encode(ids: np.ndarray) -> bytes:
    """ids: uint32, any number of them, none included."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    parts = [_encode(ids[i : i + AT_ONCE * BLOCK]) for i in range(0, n, AT_ONCE * BLOCK)]
    words, counts, escapes, escape_counts = ([p[i] for p in parts] for i in range(4))
    offsets = [np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *c]))]).astype("<u4").tobytes() for c in (counts, escape_counts)]
    return b"".join([MAGIC, np.array([n, blocks, sum(map(len, escapes))], "<u4").tobytes(), *offsets, *(e.astype("<u4").tobytes() for e in escapes), *(w.astype("<u8").tobytes() for w in words)])


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words by block, escapes, escapes by block) of some blocks."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    need = NARROW[np.minimum(ids, (1 << 16) - 1)]
    large = np.flatnonzero(ids >= (1 << 16) - 1)
    need[large] = BITS[np.searchsorted((1 << BITS) - 1, ids[large].astype(np.int64), side="right")]
    limit = next((int(b) for b in BITS if np.count_nonzero(need > b) <= ESCAPED * n), 60)
    over = need > limit
    values, escaped, wide = _grid(ids.astype(np.uint64), blocks), _grid(over, blocks), _grid(np.where(over, np.uint8(1), need), blocks)
    # the fullest shape that fits from each position on; maxima over windows by doubling
    most = {1: wide}
    for p in (2, 4, 8, 16, 32):
        m = most[p // 2].copy()
        np.maximum(m[:, : -(p // 2)], m[:, p // 2 :], out=m[:, : -(p // 2)])
        most[p] = m
    best = np.full((blocks, BLOCK), len(SHAPES) - 1, np.uint8)
    for s in range(len(SHAPES) - 2, -1, -1):
        c, b = SHAPES[s]
        p = 1 << (c.bit_length() - 1)
        np.putmask(best, np.maximum(most[p][:, :BLOCK], most[p][:, c - p : c - p + BLOCK]) <= b, np.uint8(s))
    # from word to word, in all blocks at once
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - BLOCK * (blocks - 1)
    begins, flat, base = np.zeros(blocks * BLOCK, bool), best.ravel(), np.arange(blocks) * BLOCK
    at, ends = base.copy(), base + sizes
    while len(at):
        begins[at] = True
        at = at + COUNTS[flat[at]]
        live = at < ends
        if not live.all():
            at, ends = at[live], ends[live]
    where = np.flatnonzero(begins)
    shape, block, pos = flat[where], where // BLOCK, where % BLOCK
    words = shape.astype(np.uint64) << np.uint64(60)
    cell0, flat_values, flat_escaped = block * (BLOCK + PAD) + pos, values.ravel(), escaped.ravel()
    for s, (c, b) in enumerate(SHAPES):
        rows = np.flatnonzero(shape == s)
        if len(rows):
            cells = cell0[rows, None] + np.arange(c)
            parts = flat_values[cells]
            np.putmask(parts, flat_escaped[cells], np.uint64((1 << b) - 1))
            words[rows] |= np.bitwise_or.reduce(parts << (np.arange(c) * b).astype(np.uint64), axis=1)
    return words, np.bincount(block, minlength=blocks), values[escaped], escaped.sum(1)


def decode(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids (uint32) of blocks first to last - 1; only these blocks' words are looked at."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token payload")
    n, blocks, escapes = (int(x) for x in np.frombuffer(payload, "<u4", 3, 4))
    last = blocks if last is None else min(last, blocks)
    at = 16
    word_at = np.frombuffer(payload, "<u4", blocks + 1, at).astype(np.int64)
    escape_at = np.frombuffer(payload, "<u4", blocks + 1, at + 4 * (blocks + 1)).astype(np.int64)
    at += 8 * (blocks + 1)
    if last - first > AT_ONCE:
        return np.concatenate([decode(payload, i, min(last, i + AT_ONCE)) for i in range(first, last, AT_ONCE)])
    wanted = last - first
    if wanted <= 0:
        return np.zeros(0, np.uint32)
    extra = np.frombuffer(payload, "<u4", escape_at[last] - escape_at[first], at + 4 * escape_at[first])
    words = np.frombuffer(payload, "<u8", word_at[last] - word_at[first], at + 4 * escapes + 8 * word_at[first])
    shape = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(wanted), np.diff(word_at[first : last + 1]))
    ends = np.concatenate([[0], np.cumsum(COUNTS[shape])])
    start = ends[:-1] - ends[word_at[first:last] - word_at[first]][block]
    out = np.zeros((wanted, BLOCK + PAD), np.uint32)
    escaped = np.zeros((wanted, BLOCK + PAD), bool)
    for s, (c, b) in enumerate(SHAPES):
        rows = np.flatnonzero(shape == s)
        if len(rows):
            ones = np.uint64((1 << b) - 1)
            parts = (words[rows, None] >> (np.arange(c) * b).astype(np.uint64)) & ones
            cells = (block[rows, None], start[rows, None] + np.arange(c))
            out[cells], escaped[cells] = parts.astype(np.uint32), parts == ones
    out, escaped = out[:, :BLOCK], escaped[:, :BLOCK]
    out[escaped] = extra
    return out.ravel()[: min(n, last * BLOCK) - first * BLOCK]


#: What ends a word apart from letters; the tokenizer parts it from the letters before.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The steps before the model in a tokenizers file whose texts may be encoded word by word.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def by_words(tokenizer) -> bool:
    """Whether a text's ids are its words' ids in order: white space parts words and leaves nothing, and letters are lower-cased one by one for a BPE model without chance."""
    spec = json.loads(tokenizer.to_str())
    model, added = spec["model"], spec["added_tokens"] or []
    plain = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not a["content"].isalpha() and not any(c.isspace() for c in a["content"]) for a in added)
    return all(spec[k] == v for k, v in BY_WORDS.items()) and model["type"] == "BPE" and not model["dropout"] and not model["ignore_merges"] and plain


def text_encoder(tokenizer):
    """text -> its ids as little-endian uint32. A word that comes again isn't encoded again, where the tokenizer allows it."""
    if not by_words(tokenizer):
        return lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    ids_of = word_encoder(tokenizer)
    return lambda text: b"".join(map(ids_of.__getitem__, text.encode("utf-8", "surrogatepass").split()))


def word_encoder(tokenizer) -> Memo:
    """word (bytes without white space) -> its ids as little-endian uint32, for a lower-casing word BPE over byte letters.

    Most words are letters and then marks. Letters up to U+024F in composed form have a lower case of their own and no rule that joins them
    to marks, so these go to the tokenizer's BPE model directly; all other words go through the whole tokenizer.
    """
    from tokenizers import pre_tokenizers

    to_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tokenize = tokenizer.model.tokenize

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def stem(low: str) -> bytes:
        if not low.isascii():
            low = "".join([x for x, _ in to_letters.pre_tokenize_str(low)])
        return array("I", [x.id for x in tokenize(low)]).tobytes()

    marks, stems = Memo(whole, 100_000), Memo(stem)

    def word(raw: bytes) -> bytes:
        text = raw.decode("utf-8", "surrogatepass")
        letters = text.rstrip(MARKS)
        if not letters.isalpha():
            return whole(text)
        if not letters.isascii() and (max(letters) > "\u024f" or "\u0130" in letters or not unicodedata.is_normalized("NFC", letters)):
            return whole(text)
        ids = stems[letters.lower()]
        return ids if len(letters) == len(text) else ids + marks[text[len(letters) :]]

    return Memo(word)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, shards: int | None = None, chunk_ids: int = 65_536, order: list[str] | None = None) -> None:
    """Encodes texts with a tokenizers file and writes them below path, which driver and executors must share.

    docs: doc_id, text (other columns are ignored). One range of doc_ids is a shard; a chunk closes once it has chunk_ids ids, so a task
    holds one chunk and one document. Each document ends with end_id; a null or empty text is end_id alone. Null doc_ids come first; repeated
    rows are documents of their own, next to each other, equal doc_ids by text. An empty table is written as no rows.

    order: columns of docs that say another order of documents, in which no two are alike.

    With a tokenizer that drops white space (see by_words), words that come again aren't encoded again; any other encodes whole texts.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, within = (order, order) if order else (["doc_id"], ["doc_id", "text"])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(order or []))
    ordered = texts.repartitionByRange(shards, *ranges).sortWithinPartitions(*within).select("doc_id", "text", F.spark_partition_id().alias("shard"))
    end = np.array([end_id], "<u4").tobytes()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        ids_of = per_worker(f"text ids of {tokenizer_file}", lambda: text_encoder(Tokenizer.from_file(tokenizer_file)))
        shard, chunk, before, held, doc_ids, sizes = 0, 0, 0, 0, [], []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal chunk, before, held
            payload = encode(np.frombuffer(b"".join(parts), "<u4"))
            row = pa.RecordBatch.from_pydict({"shard": [shard], "chunk": [chunk], "before": [before], "doc_ids": [list(doc_ids)], "n_tokens": [list(sizes)], "payload": [payload]}, schema=pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("payload", pa.binary())]))
            chunk, before, held = chunk + 1, before + held, 0
            for x in (parts, doc_ids, sizes):
                x.clear()
            return row

        # few texts at a time stand beside the batch
        for batch in (whole.slice(i, AT_ONCE_TEXTS) for whole in batches for i in range(0, whole.num_rows, AT_ONCE_TEXTS)):
            for doc_id, text, shard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "shard")), strict=True):
                ids = ids_of(text) + end
                parts.append(ids)
                doc_ids.append(doc_id)
                sizes.append(len(ids) // 4)
                held += len(ids) // 4
                if held >= chunk_ids:
                    yield close()
        if doc_ids:
            yield close()

    ordered.mapInArrow(chunks, FILE).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of all documents written to path; start counts the ids of all documents before."""
    return _read(spark, path, "ids array<int>", lambda ids: pa.array(ids, pa.list_(pa.int32())))


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_tokens, with the unsigned crc32 of the ids (little-endian uint32) in place of the ids."""
    return _read(spark, path, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _read(spark: SparkSession, path: str, column: str, made) -> DataFrame:
    files = spark.read.schema(FILE).parquet(path)
    # a row per shard: their number is a parameter of the writer, which bounds what is broadcast
    shards = files.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base = shards.select("shard", (F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    chunks = files.join(F.broadcast(base), "shard").select("doc_ids", "n_tokens", "payload", (F.col("base") + F.col("before")).alias("start"))
    name = column.split()[0]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, sizes = batch.column("doc_ids")[i].values, batch.column("n_tokens")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                stops = np.cumsum(sizes)
                ids = np.split(decode(batch.column("payload")[i].as_py()), stops[:-1])
                starts = batch.column("start")[i].as_py() + stops - sizes
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), made(ids)], names=["doc_id", "start", "n_tokens", name])

    return chunks.mapInArrow(documents, f"doc_id long, start long, n_tokens long, {column}")
