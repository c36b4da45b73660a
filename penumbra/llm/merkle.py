"""A manifest of a data set as a tree of hashes: one root that no change escapes, and for each row a proof that it belongs there.

Rows are leaves of their source's tree, whose tops are the leaves of the root's tree. A row's place is its exact rank in its source, found from counts of doc_id
digits (no global sort); the rank's digits in the base of the fanout are the leaf's key in the trie, and nodes are reduced from the longest prefix on. Five
levels at a time are reduced where 243 neighbours meet, so a source of any size takes a logarithmic number of shuffles of a 243th of the nodes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import stored
from penumbra.llm.ranking import digits, letters, ranked

FANOUT = 3
#: Levels that are reduced at a time, and nodes that so meet.
LEVELS = 5
CHUNK = FANOUT**LEVELS


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Hash of a row's fields: `-` for a null, else the number of UTF-8 bytes, a colon and the value."""
    fields = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in (doc_id, source, lang, n_chars, text)]
    return digest(F.concat(*fields))


def _runs(level: Column) -> Column:
    """Hashes of each FANOUT neighbours; the last run may have fewer."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int")), lambda i: digest(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), "")))


def _steps(place: Column, level_names: list[str], heights: Column) -> Column:
    """The way up from the node at `place` of a chunk: for each level the siblings to its left and to its right, each as one string."""
    steps = []
    for h, name in enumerate(level_names):
        at = F.floor(place / FANOUT**h).cast("int")
        start = F.floor(at / FANOUT).cast("int") * FANOUT
        left, right = F.slice(name, start + 1, at - start), F.slice(name, at + 2, start + FANOUT - 1 - at)
        steps.append(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
    return F.slice(F.array(*steps), F.lit(1), heights)


def _chunks(nodes: DataFrame) -> DataFrame:
    """Nodes of LEVELS levels above: from nodes (lane, at, total: nodes of the lane, node: struct with hash) to lane, at, total, hash, and what a way up needs.

    A lane of up to CHUNK nodes is reduced to one. No chunk holds more than CHUNK nodes.
    """
    met = nodes.groupBy("lane", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.max("total").alias("of"), F.array_sort(F.collect_list(F.struct("at", "node"))).alias("met"))
    members = met.withColumn("members", F.transform("met", lambda x: x["node"])).drop("met")
    all_levels = [F.when(F.col("of") > FANOUT**h, 1).otherwise(0) for h in range(LEVELS)]
    made = members.withColumn("heights", sum(all_levels[1:], all_levels[0])).withColumn("level0", F.transform("members", lambda x: x["hash"]))
    for h in range(1, LEVELS + 1):
        made = made.withColumn(f"level{h}", F.when(F.col("heights") >= h, _runs(F.col(f"level{h - 1}"))).otherwise(F.col(f"level{h - 1}")))
    top = F.element_at(f"level{LEVELS}", 1).alias("hash")
    return made.select("lane", F.col("chunk").alias("at"), F.ceil(F.col("of") / CHUNK).alias("total"), top, "members", "heights", *[f"level{h}" for h in range(LEVELS)])


def _reduced(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Stored chunks, from those of the leaves to those that are one for each lane."""
    rounds = [stored(_chunks(nodes), name)]
    while not rounds[-1].filter("total > 1").isEmpty():
        above = rounds[-1].select("lane", "at", "total", F.struct("hash").alias("node"))
        rounds.append(stored(_chunks(above), name))
    return rounds


_LEVEL_NAMES = [f"level{h}" for h in range(LEVELS)]


def _ways(chunks: DataFrame, above: DataFrame, name: str) -> DataFrame:
    """chunks' members (each with `lane` of theirs, at) with the whole way up, given that of their chunk: above (lane, at, way, subroot, root)."""
    joined = chunks.select("lane", "at", "members", "heights", *_LEVEL_NAMES).join(above, ["lane", "at"])
    each = F.transform("members", lambda m, i: F.struct(m.alias("node"), (F.col("at") * CHUNK + i).alias("at"), F.concat(_steps(i, _LEVEL_NAMES, F.col("heights")), F.col("way")).alias("way")))
    return joined.select("lane", "subroot", "root", F.explode(each).alias("one")).select("lane", "one.at", "one.way", "one.node", "subroot", "root")


def manifest(docs: DataFrame, altered_text: Column | None = None) -> DataFrame:
    """doc_id, source, rank (in its source), leaf, subroot, root, proof_sha256, folded_root, verified.

    docs needs doc_id, source, lang, n_chars and text; other columns stay out. altered_text, if given, takes the text's place in the leaf that is folded up
    to folded_root; where it is null or the row's text, that is the row's own leaf. verified says whether folded_root is the root.

    Rows of a source go by doc_id, null first, then by leaf; repeated rows are leaves of their own, next to one another. A null source is one of its own and the
    first. Null and empty texts are different leaves. An empty table gives no rows. No source, and no number of rows of one doc_id, meets in one task.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    changed = F.coalesce(~altered_text.eqNullSafe(text) & altered_text.isNotNull(), F.lit(False)) if altered_text is not None else F.lit(False)
    leaves = docs.select(
        letters(F.col("source")).alias("lane"), "source", F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(*own, text).alias("leaf"),
        F.when(changed, leaf_hash(*own, altered_text if altered_text is not None else text)).alias("altered"),
    )
    # repeated rows are one until they have their ranks: whatever their number, they need no common task
    once = stored(leaves.groupBy("lane", "source", "doc_id", "leaf").agg(F.max("altered").alias("altered"), F.count(F.lit(1)).alias("copies")), "leaves")
    key = F.concat(digits(F.col("doc_id")), F.upper("leaf"))
    placed = ranked(once, "lane", key, [F.col("doc_id").asc_nulls_first(), F.col("leaf")], first=15, copies="copies")
    row = F.struct(F.col("leaf").alias("hash"), "source", "doc_id", "altered")
    alone = placed.filter("copies = 1").select("lane", F.col("rank").alias("at"), "total", row.alias("node"))
    many = placed.filter("copies > 1").select("lane", F.explode(F.expr("sequence(rank, rank + copies - 1)")).alias("at"), "total", row.alias("node"))
    rounds = _reduced(alone.unionByName(many), "chunks")

    tops = stored(rounds[-1].select(F.lit("").alias("all"), F.col("lane").alias("source_lane"), F.col("hash").alias("top")), "tops")
    order = ranked(tops, "all", F.col("source_lane"), [F.col("source_lane")], first=STEP_OF_SOURCES)
    roots = _reduced(order.select(F.col("all").alias("lane"), F.col("rank").alias("at"), "total", F.struct(F.col("top").alias("hash"), "source_lane").alias("node")), "root")

    way = F.array().cast("array<struct<left:string,right:string>>").alias("way")
    above = roots[-1].select("lane", "at", way, F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    for chunks in reversed(roots[1:]):
        above = stored(_ways(chunks, above, "ways").drop("node"), "ways")
    of_sources = _ways(roots[0], above, "ways").select(F.col("node.source_lane").alias("lane"), F.lit(0).cast("long").alias("at"), "way", F.col("node.hash").alias("subroot"), "root")
    above = stored(of_sources, "ways")
    for chunks in reversed(rounds[1:]):
        above = stored(_ways(chunks, above, "ways").drop("node"), "ways")
    rows = _ways(rounds[0], above, "ways")

    proof = digest(F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), ""))
    folded = F.aggregate("way", F.coalesce("node.altered", "node.hash"), lambda below, s: digest(F.concat(s["left"], below, s["right"])))
    out = rows.select(F.col("node.doc_id").alias("doc_id"), F.col("node.source").alias("source"), F.col("at").alias("rank"), F.col("node.hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Characters of a source's key that the first count of sources goes by.
STEP_OF_SOURCES = 6
