"""One large JSON document, read in parallel: where its members and their elements begin is found from all of its parts at once.

The text is read in fragments that end at commas, a range of bytes for each task, and put together in blocks. Whether a comma stands in a string, and how deep, follows from the blocks
before: each one has a number of quotes, and a change of depth for either case, in or out of a string; sums of these over ranges, and within ranges, say it for all. Blocks are
cut at the commas that separate elements, and what two blocks share is put together again, an element by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from penumbra.operators.graph import kept

#: A block of fragments is full with so many characters: rows of blocks are few, and no more than a block and an Arrow batch is in memory.
BLOCK = 1 << 20


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the range of bytes), at (order in it), text: what lies between commas."""
    read = spark.read.option("lineSep", ",").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


class _Marks:
    """A text's bytes: which are quotes, brackets and commas (what a backslash stands before is neither quote nor bracket), how many quotes are before each, and the running depth."""

    def __init__(self, text: bytes):
        b = np.frombuffer(text, np.uint8)
        slash = b == 0x5C
        free = np.ones(len(b), bool)
        if slash.any():
            # what follows an odd number of backslashes
            at, last = np.arange(len(b)), np.maximum.accumulate(np.where(slash, -1, np.arange(len(b))))
            free[1:] = ~(slash & ((at - last) % 2 == 1))[:-1]
        self.comma = b == 0x2C
        quote = (b == 0x22) & free
        self.quotes = np.cumsum(quote)
        self.turn = np.where(free & ((b == 0x5B) | (b == 0x7B)), 1, np.where(free & ((b == 0x5D) | (b == 0x7D)), -1, 0))

    def depth(self, inside: int) -> np.ndarray:
        """The running change of depth, if the text begins in a string (1) or not (0)."""
        return np.cumsum(np.where((self.quotes + inside) % 2 == 0, self.turn, 0))


_BLOCK = "file string, start long, at long, text string, quotes long, d0 long, d1 long"
_PIECE = "file string, start long, at long, nth int, text string, member long, element long, end long, members long, elements long"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    named = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), named, strict=True)], names=[n for n, _ in named])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of a range that follow one another as one text, with its quotes and its change of depth in either case."""

    def told(key: tuple, at: int, texts: list[str]) -> pa.RecordBatch:
        text = ",".join(texts)
        marks = _Marks(text.encode())
        change = [int(d[-1]) if len(d) else 0 for d in (marks.depth(0), marks.depth(1))]
        return _rows([(*key, at, text, int(marks.quotes[-1]) if len(marks.quotes) else 0, *change)], _BLOCK)

    key, at, texts, size = None, 0, [], 0
    for batch in batches:
        files, starts = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column("start").to_numpy(zero_copy_only=False)
        turns = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
        # rows of one range, joined as they are
        for i, j in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows], strict=True):
            if i == j:
                continue
            now = (batch.column("file")[i].as_py(), int(starts[i]))
            if texts and (now != key or size >= BLOCK):
                yield told(key, at, texts)
                texts, size = [], 0
            if not texts:
                key, at = now, batch.column("at")[i].as_py()
            one = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column("text").slice(i, j - i))
            texts.append(pc.binary_join(one, ",")[0].as_py())
            size += len(texts[-1])
    if texts:
        yield told(key, at, texts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, of which it is known how they begin (quoted, depth), as pieces between the commas at depth 1 (between members) and 2 (between elements).

    member and element count such commas before a piece in its block, members and elements those up to its end; end is the least depth at a comma of the piece, the one behind the block among them.
    """
    for batch in batches:
        for file, start, at, text, quoted, depth in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "at", "text", "quoted", "depth")), strict=True):
            held = (text + ",").encode()
            marks = _Marks(held)
            inside = quoted % 2
            deep = depth + marks.depth(inside)
            commas = np.flatnonzero(marks.comma)
            after, free = deep[commas], (marks.quotes[commas] + inside) % 2 == 0
            member, element = free & (after == 1), free & (after == 2)
            ends = np.flatnonzero(member | element)
            begins = np.concatenate([[0], ends + 1])
            if begins[-1] == len(commas):
                begins = begins[:-1]
            else:
                ends = np.append(ends, len(commas) - 1)
            least = np.minimum.reduceat(after, begins)
            many = [np.concatenate([[0], np.cumsum(x)]) for x in (member, element)]
            first = np.where(begins > 0, commas[begins - 1] + 1, 0)
            texts = [held[i:j].decode() for i, j in zip(first.tolist(), commas[ends].tolist(), strict=True)]
            n = len(texts)
            yield _rows(list(zip([file] * n, [start] * n, [at] * n, range(n), texts, *(m[begins].tolist() for m in many), least.tolist(), *(m[ends + 1].tolist() for m in many), strict=True)), _PIECE)


def _running(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """rows (file, start, at, ...: few bytes each) with sums of values over those before: within a range of bytes by a window, over ranges by their sums, of which there is one for each range."""
    held = rows.withColumns({f"__{n}": v for n, v in values.items()})
    ranges = held.groupBy("file", "start").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in values])
    sums = lambda window, ending: [F.coalesce(F.sum(f"__{n}").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__{ending}_{n}") for n in values]
    carried = ranges.select("file", "start", *sums(W.partitionBy("file").orderBy("start"), "carried"))
    own = held.select("*", *sums(W.partitionBy("file", "start").orderBy("at"), "own"))
    return own.join(carried, ["file", "start"]).select(*rows.columns, *[(F.col(f"__own_{n}") + F.col(f"__carried_{n}")).alias(n) for n in values])


def parts(spark: SparkSession, path: str) -> DataFrame:
    """file, member (its number), name, pos, text, list: each element of the document's members, in order; a member that is no list is in one row or in pieces, which `list` tells.

    The document is an object. Only its own members and their elements are taken apart, not what lies deeper. An empty list is one row with an empty text.
    """
    blocks = kept(_fragments(spark, path).mapInArrow(_blocks, _BLOCK), "blocks")
    place = ["file", "start", "at"]
    # how a block begins: a few numbers for each are what is sorted and sent to all tasks
    begun = _running(blocks.select(*place, "quotes", "d0", "d1"), {"quoted": F.col("quotes")})
    begun = _running(begun, {"depth": F.when(F.col("quoted") % 2 == 0, F.col("d0")).otherwise(F.col("d1"))}).select(*place, "quoted", "depth")
    pieces = kept(blocks.select(*place, "text").join(F.broadcast(begun), place).mapInArrow(_cut, _PIECE), "pieces")
    counted = pieces.groupBy(*place).agg(F.max("members").alias("members"), F.max("elements").alias("elements"))
    before = _running(counted, {"members_before": F.col("members"), "elements_before": F.col("elements")}).select(*place, "members_before", "elements_before")
    rows = pieces.join(F.broadcast(before), place).withColumn("member", F.col("member") + F.col("members_before")).withColumn("element", F.col("element") + F.col("elements_before"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "at", "nth", "text"))), lambda x: x["text"]), ",")
    whole = rows.groupBy("file", "member", "element").agg(joined.alias("text"), F.min("end").alias("end"))
    # the first element has its member's name and bracket before it, the last one the bracket behind it
    opening = r'(?s)^\s*(?:\{\s*)?"((?:[^"\\]|\\.)*)"\s*:\s*(\[)?'
    heads = whole.groupBy("file", "member").agg(F.min("element").alias("first"), F.max("element").alias("last"), F.min_by("text", "element").alias("head"))
    heads = heads.select("file", "member", "first", "last", F.regexp_extract("head", opening, 1).alias("name"), (F.regexp_extract("head", opening, 2) == "[").alias("list"))
    told = whole.join(heads, ["file", "member"])
    text = F.when(F.col("element") == F.col("first"), F.regexp_replace("text", opening, "")).otherwise(F.col("text"))
    closing = F.when(F.col("list"), F.lit(r"(?s)\]\s*(?:\}\s*)?$")).otherwise(F.when(F.col("end") == 0, F.lit(r"(?s)\}\s*$")).otherwise(F.lit(r"\s*$")))
    text = F.when(F.col("element") == F.col("last"), F.regexp_replace(text, closing, F.lit(""))).otherwise(text)
    return told.select("file", "member", "name", (F.col("element") - F.col("first")).alias("pos"), F.btrim(text, F.lit(" \t\r\n")).alias("text"), "list")


def elements(spark: SparkSession, path: str, name: str, told: DataFrame | None = None) -> DataFrame:
    """pos, value: the elements of the list that a document has under a name, in order, as variants; null where an element is no JSON. A document without that list is an error.

    The list is taken apart once and written to the shared folder, since readers look at its elements several times. Ranges of it are dealt over all tasks, since texts are few bytes beside
    the work with them. told: the document's parts, if they are known.
    """
    found = kept((parts(spark, path) if told is None else told).filter((F.col("name") == name) & F.col("list")).select("pos", "text"), "elements")
    if found.isEmpty():
        raise ValueError(f"the document has no list of {name}")
    return found.filter("text <> ''").orderBy("pos").select("pos", F.try_parse_json("text").alias("value"))


def member(spark: SparkSession, path: str, name: str, told: DataFrame | None = None) -> str | None:
    """The JSON text of a member that is neither list nor object; '[' for a list, '{' for an object, None where there is none. told: the document's parts, if they are known."""
    found = (parts(spark, path) if told is None else told).filter(F.col("name") == name)
    row = found.select("pos", F.when(F.col("list"), F.lit("[")).when(F.startswith("text", F.lit("{")), F.lit("{")).otherwise(F.col("text")).alias("text")).orderBy("pos").first()
    return row and row.text


#: What a JSON value is, as a strict reader tells them apart.
KINDS = ("null", "boolean", "number", "text", "list", "object")


def kind(value: Column, named: Column | None = None) -> Column:
    """One of KINDS for a variant, null where there is none. named: its schema, if that is a column already: it is looked at for each kind."""
    named = F.schema_of_variant(value) if named is None else named
    return (
        F.when(value.isNull(), F.lit(None))
        .when(named == "VOID", "null").when(named == "BOOLEAN", "boolean").when(named == "STRING", "text")
        .when(named.startswith("ARRAY"), "list").when(named.startswith("OBJECT"), "object").otherwise("number")
    )


def at(value: Column, path: str) -> Column:
    """What a variant holds at a path like $.a.b, as a variant; null if the path leads nowhere."""
    return F.try_variant_get(value, path, "variant")


def lenient_number(value: Column) -> Column:
    """A variant as a double: a number, a text that is one, or a truth as 1 or 0; else null."""
    of = kind(value)
    read = F.try_variant_get(value, "$", "double")
    return F.when(of.isin("number", "text"), read).when(of == "boolean", F.try_variant_get(value, "$", "boolean").cast("double"))


def text_of(value: Column) -> Column:
    """A variant as a string: texts and numbers as they are, others null."""
    return F.when(kind(value).isin("text", "number"), F.try_variant_get(value, "$", "string"))
