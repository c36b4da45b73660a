"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, connected components.

1. Each text's set of word shingles, its size, a 128-bit hash of the set and MINHASHES minima are computed in one pass; equal sets are then one class.
2. Classes that share a band key are compared with the least of them: their minima go batch by batch, and a pair is dropped once the posterior probability that its
   similarity reaches the threshold is below MISS. Texts are fetched for the surviving pairs alone, which are decided on the full sets.
3. Where classes of different components of these links still share a band key, all such pairs are compared, in blocks: by minima, and where a block has survivors, by the full
   sets of these. So no candidate is passed over, and a large group of copies, which step 2 has made one component, costs no pairs.
4. Components of all links found give the classes' ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import HASHED, SALTS, Memo, per_worker, salt_of, stored, with_least, words

#: Minima of a set, and the most that a pair at the threshold may be missed by sharing no band.
MINHASHES, UNSEEN = 100, 1e-5
#: Minima compared at a time, and the posterior probability below which a pair is given up.
BATCH, MISS = 20, 1e-6
#: Classes compared with one another in a task, and the shingles that they have together.
BLOCK, SHINGLES = 1024, 1 << 20
#: Rows of one class from which their join with its result is dealt out.
HOT = 10_000
P1, P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; of the whole sequence if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            out = mix(out * P1 + hashes[i : n - size + 1 + i])
    return np.unique(out)


def minima(sets: list[np.ndarray], seed: int = 1) -> np.ndarray:
    """MINHASHES minima (uint32) for each set; none of the sets may be empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(0, 1 << 63, MINHASHES, dtype=np.uint64)
    out = np.empty((len(sets), MINHASHES), np.uint32)
    step = 400_000  # shingles at a time, so that they stay in the cache and a batch of long texts needs little memory
    sizes = np.array([len(x) for x in sets])
    groups = np.cumsum(sizes) // step
    with np.errstate(over="ignore"):
        for g in np.unique(groups):
            rows = np.flatnonzero(groups == g)
            flat = np.concatenate([sets[i] for i in rows])
            starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            for j in range(MINHASHES):
                h = flat ^ masks[j]
                h *= factors[j]
                out[rows, j] = (np.minimum.reduceat(h, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature (int64)."""
    with np.errstate(over="ignore"):
        keys = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(signatures), 1))
        for r in range(rows):
            keys = mix(keys * P2 + signatures[:, r : bands * rows : rows].astype(np.uint64))
    return keys.view(np.int64)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the longest bands with which a pair at the threshold shares none with a probability of UNSEEN at most."""
    for rows in range(20, 0, -1):
        bands = MINHASHES // rows
        if (1 - threshold**rows) ** bands <= UNSEEN:
            return bands, rows
    raise ValueError(f"{MINHASHES} minima can't find pairs of similarity {threshold}")


def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """By number of minima compared: the least number of matches at which P(similarity >= threshold) is miss or more.

    With a uniform prior, m matches in n leave a Beta(m+1, n-m+1), whose tail is a sum of binomial terms.
    """
    out = []
    for n in range(MINHASHES + 1):
        tail, least = 0.0, n + 1
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                least = m
                break
        out.append(least)
    return tuple(out)


def survivors(x: np.ndarray, y: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """The rows in which the signatures x and y [pair, minimum] may belong to a pair at the threshold, compared batch by batch."""
    at, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for b in range(0, MINHASHES, BATCH):
        matches = matches + (x[at, b : b + BATCH] == y[at, b : b + BATCH]).sum(axis=1)
        keep = matches >= least[b + BATCH]
        at, matches = at[keep], matches[keep]
    return at


def word_hashes() -> Memo:
    """Hashes of words, kept by the worker from one step to the next."""
    import xxhash

    return per_worker("hashes of words", lambda: Memo(xxhash.xxh3_64_intdigest, HASHED))


def shingle_sets(texts: list[str | None], k: int, hash_of: Memo) -> list[np.ndarray]:
    out = []
    for text in texts:
        w = words(text)
        out.append(shingles(np.fromiter(map(hash_of.__getitem__, w), np.uint64, len(w)), k))
    return out


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, version, salt, n_shingles, set_hash binary, signature binary, keys array<long>) per row of docs (doc_id, version, salt, text); the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        hash_of = word_hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = shingle_sets(batch.column("text").to_pylist(), k, hash_of)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = minima([sets[i] for i in full]) if full else np.zeros((0, MINHASHES), np.uint32)
                keys = band_keys(sig, bands, rows)
                place = {i: n for n, i in enumerate(full)}
                pick = lambda f: [f(i) if i in place else None for i in range(len(sets))]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("doc_id", "version", "salt")),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(pick(lambda i: hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()), pa.binary()),  # noqa: B023
                        pa.array(pick(lambda i: sig[place[i]].tobytes()), pa.binary()),  # noqa: B023
                        pa.array(pick(lambda i: keys[place[i]]), pa.list_(pa.int64())),  # noqa: B023
                    ],
                    names=["doc_id", "version", "salt", "n_shingles", "set_hash", "signature", "keys"],
                )

    return docs.select("doc_id", "version", "salt", "text").mapInArrow(run, "doc_id long, version long, salt int, n_shingles long, set_hash binary, signature binary, keys array<long>")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in edges (a, b), any two columns of longs: component is the least id reachable.

    Alternates the two steps by which neighbours are hung on the least one of them, above and then below a node, until
    nothing changes: a number of rounds that grows with the logarithm of the number of nodes. Each round is written to the shared folder. Only sums are
    collected. The neighbours of a hub are dealt out by with_least.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), name)
    mark = None
    while True:
        # every neighbour above a node is hung on the least of the node and its neighbours
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", "m", salt_of("b")).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # every neighbour below a node, and the node, is hung on the least of them
        small = with_least(large, "a", "b", "m", salt_of("b"))
        now = stored(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct(), name)
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == mark:
            break
        mark = (row["n"], row["s"])
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _dealt(pairs: DataFrame) -> DataFrame:
    """(a, block, id, second) from pairs (a, b): rows for b by blocks of BLOCK, and one for a, which comes first, in each of its blocks."""
    counted = with_least(pairs.select("a", "b"), "a", "b", "least", salt_of("b"))
    blocks = F.ceil(F.col("n") / BLOCK)
    placed = counted.select("a", "b", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
    return placed.select("a", "block", F.col("b").alias("id"), F.lit(1).alias("second")).union(placed.select("a", "block", F.col("a").alias("id"), F.lit(0).alias("second")).distinct())


def _in_turn(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("a", "block").sortWithinPartitions("a", "block", "second", "id")


def _firsts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size: int) -> Iterator[tuple[list, list]]:
    """(seconds, their firsts), as rows of columns, for some rows at a time: a task holds one first and `size` seconds."""
    first = None
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            batch = whole.slice(at, size)
            rows, own = [], []
            for second, *row in zip(*(batch.column(c).to_pylist() for c in ("second", *columns)), strict=True):
                if second:
                    rows.append(row)
                    own.append(first)
                else:
                    first = row
            yield rows, own


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def prune(pairs: DataFrame, reps: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """The pairs (a, b) of ids in reps (id, signature) that may reach the threshold, by their minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in _firsts(batches, ("id", "signature"), 2000):
            if rows:
                x, y = (np.frombuffer(b"".join(r[1] for r in side), np.uint32).reshape(len(side), MINHASHES) for side in (rows, own))
                yield _pairs([(own[i][0], rows[i][0]) for i in survivors(x, y, least).tolist()])

    return _in_turn(_dealt(pairs).join(reps.select("id", "signature"), "id")).mapInArrow(run, "a long, b long")


def decide(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids in reps (id, version) that are linked, by the full sets of the texts in docs (doc_id, version, text)."""
    texts = docs.filter("doc_id is not null and text is not null").groupBy("doc_id", "version").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = word_hashes()
        known, own_set = None, None
        for rows, own in _firsts(batches, ("id", "text"), 64):
            found = []
            for (b, text), first in zip(rows, own, strict=True):
                if first is not known:
                    known, own_set = first, shingle_sets([first[1]], k, hash_of)[0]
                other = shingle_sets([text], k, hash_of)[0]
                both = len(np.intersect1d(own_set, other, assume_unique=True))
                if 100 * both >= percent * (len(own_set) + len(other) - both):
                    found.append((first[0], b))
            if found:
                yield _pairs(found)

    wanted = _dealt(pairs).join(reps.select("id", "version"), "id")
    met = wanted.join(texts, (F.col("id") == F.col("doc_id")) & (wanted["version"] == texts["version"]))
    return _in_turn(met.select("a", "block", "id", "second", "text")).mapInArrow(run, "a long, b long")


class Block:
    """Classes of one band key that a task compares: rows (id, component, place, n_shingles, signature), of block i, or of blocks i and j."""

    def __init__(self, rows: list[tuple], i: int, j: int, band: int, percent: int, bands: int, width: int, least: tuple[int, ...]):
        self.ids, self.part, self.place, self.sizes = (np.array([r[c] for r in rows], np.int64) for c in range(4))
        self.signatures = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), MINHASHES)
        self.keys = band_keys(self.signatures, bands, width)
        self.i, self.j, self.band, self.percent, self.least = i, j, band, percent, least

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """(x, ys): rows that may be linked, by sizes and minima. A pair with several keys in common is taken by the first band alone, pairs of one component are passed over."""
        second = np.flatnonzero(self.place == self.j)
        for x in np.flatnonzero(self.place == self.i).tolist():
            others = second[second > x] if self.i == self.j else second
            others = others[self.part[others] != self.part[x]]
            # sizes alone rule out what can't reach the threshold
            others = others[100 * np.minimum(self.sizes[others], self.sizes[x]) >= self.percent * np.maximum(self.sizes[others], self.sizes[x])]
            others = others[(self.keys[others] == self.keys[x]).argmax(axis=1) == self.band]
            if len(others):
                kept = others[survivors(self.signatures[others], np.broadcast_to(self.signatures[x], (len(others), MINHASHES)), self.least)]
                if len(kept):
                    yield x, kept

    def busy(self) -> list[int]:
        """Ids in any candidate."""
        found = [np.concatenate([[x], ys]) for x, ys in self.candidates()]
        return self.ids[np.unique(np.concatenate(found))].tolist() if found else []

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links by the full sets; what they connect becomes one component, whose pairs need no more looking at."""
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        mark, found = np.zeros(int(flat.max()) + 1, bool), []
        for x, ys in self.candidates():
            own = flat[at[x] : at[x + 1]]
            mark[own] = True
            for y in ys.tolist():
                if self.part[y] == self.part[x]:
                    continue
                other = flat[at[y] : at[y + 1]]
                both = int(np.count_nonzero(mark[other]))
                if 100 * both >= self.percent * (len(own) + len(other) - both):
                    found.append((int(self.ids[x]), int(self.ids[y])))
                    self.part[self.part == self.part[y]] = self.part[x]
            mark[own] = False
        return found


def across(reps: DataFrame, linked: DataFrame, docs: DataFrame, k: int, percent: int, bands: int, width: int, least: tuple[int, ...]) -> DataFrame:
    """Links (a, b) between classes of different components that share a band key.

    A key's classes are compared in blocks, by minima first; only classes that have a candidate there fetch their texts, and pairs are never rows. A key's most common
    component is only compared with the key's other classes, so a group of copies and a stranger cost as many comparisons as there are copies.
    """
    tagged = reps.join(linked, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("part"), F.posexplode("keys").alias("band", "key"))
    parts = tagged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "part", "shingles")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / SHINGLES)).cast("int")
    mains, rests = blocks(F.col("main.n"), F.col("main.shingles")), blocks(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles"))
    # keys with several components are few; each goes to SALTS parts, since one of them may be in very many classes
    mixed = mixed.select(F.col("key").alias("of"), F.col("main.part").alias("main"), mains.alias("mains"), rests.alias("rests"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = tagged.withColumn("own", salt_of("id")).join(mixed, (F.col("key") == F.col("of")) & (F.col("own") == F.col("salt")))
    is_main = F.col("part") == F.col("main")
    block = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda a, b: F.struct(a.alias("i"), b.alias("j"))
    with_rest = F.transform(upto(F.col("rests")), lambda o: pair(F.least("block", o), F.greatest("block", o)))
    with_main = F.transform(upto(F.col("mains")), lambda o: pair(F.col("block"), F.col("rests") + o))
    of_main = F.transform(upto(F.col("rests")), lambda o: pair(o, F.col("rests") + F.col("block")))
    met = met.withColumn("block", block).withColumn("is_main", is_main)
    dealt = met.select("key", "band", "id", "part", F.when(F.col("is_main"), F.col("rests") + F.col("block")).otherwise(F.col("block")).alias("place"), F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(with_rest, with_main))).alias("p"))
    key, own = ("key", "band", "i", "j"), ("id", "part", "place", "n_shingles", "signature")

    def by_task(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple[tuple, list, list]]:
        """(key, rows, their other columns), one task's block or pair of blocks after the other."""
        now, held, rest = None, [], []
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                for row in zip(*(batch.column(c).to_pylist() for c in (*key, *own, *more)), strict=True):
                    if row[:4] != now:
                        if len(held) > 1:
                            yield now, held, rest
                        now, held, rest = row[:4], [], []
                    held.append(row[4:9])
                    rest += [shingle_sets([t], k, word_hashes())[0] for t in row[9:]]
        if len(held) > 1:
            yield now, held, rest

    def made(now: tuple, held: list) -> Block:
        return Block(held, now[2], now[3], now[1], percent, bands, width, least)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, held, _ in by_task(batches):
            block = made(now, held)
            place = dict(zip(block.ids.tolist(), zip(block.part.tolist(), block.place.tolist(), strict=True), strict=True))
            found = block.busy()
            columns = [[x] * len(found) for x in now] + [found, [place[i][0] for i in found], [place[i][1] for i in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=[*key, *own[:3]])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, held, sets in by_task(batches, ("text",)):
            yield _pairs(made(now, held).links(sets))

    def in_turn(rows: DataFrame) -> DataFrame:
        # the rows of a task's block or pair of blocks come one after the other
        return rows.repartition("key", "i", "j").sortWithinPartitions(*key, "id")

    sized = dealt.join(reps.select("id", "n_shingles", "signature"), "id").select("key", "band", "p.i", "p.j", *own)
    busy = stored(in_turn(sized).mapInArrow(seek, "key long, band int, i int, j int, id long, part long, place int"), "busy")
    texts = docs.join(busy.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id", "version").agg(F.first("text").alias("text"))
    wanted = busy.join(reps.select("id", "version", "n_shingles", "signature"), "id")
    full = wanted.join(texts, (F.col("id") == F.col("doc_id")) & (wanted["version"] == texts["version"])).select(*key, *own, "text")
    return in_turn(full).mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, miss: float = MISS) -> DataFrame:
    """Returns (doc_id, n_shingles, component_id, kept), one row per row of docs (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| for their sets of runs of k words (lower-cased A-Z, split at ASCII
    white space; a shorter text is one run). component_id is the least doc_id reachable by links, kept says that it is the row's own.
    A pair at the threshold is missed with a probability of at most UNSEEN (no band in common) and miss (given up by its minima); what is linked is decided on full sets.
    Texts without words, null texts among them, are linked with nothing. Rows with a null doc_id are returned with kept = true and no component_id, linked with
    nothing. Repeated rows get the same answer. Rows of one doc_id with several texts count as one document with the text whose set has the least hash; all of them get
    its component. Other columns are ignored; an empty table gives no rows.
    """
    bands, width = banding(percent / 100)
    least = least_matches(percent / 100, miss)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("version", F.xxhash64("text"))
    sigs = stored(signatures(source.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")), k, bands, width), "signatures")
    whole = F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull()
    known = sigs.filter(whole)
    # one class for equal sets, named by the least doc_id
    classes = known.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    once = known.groupBy("doc_id", "set_hash").agg(F.min("version").alias("version"), *[F.first(c).alias(c) for c in ("n_shingles", "signature", "keys")])
    named = classes.select(F.col("id").alias("__id"), F.col("set_hash").alias("__set"))
    reps = once.join(named, (F.col("doc_id") == F.col("__id")) & (F.col("set_hash") == F.col("__set")), "left_semi")
    reps = stored(reps.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("set_hash", "version", "n_shingles", "signature", "keys")).alias("r")).select("id", "r.version", "r.n_shingles", "r.signature", "r.keys"), "classes")
    keyed = reps.select("id", F.explode("keys").alias("key"))
    stars = with_least(keyed, "key", "id", "head", salt_of("id")).filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    near = stored(prune(stars, reps, least), "near")
    links = stored(decide(near, reps, source, k, percent), "links")
    linked = components(links)
    more = stored(across(reps, linked, source, k, percent, bands, width, least), "more-links")
    if not more.isEmpty():
        linked = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    # a class with very many rows is joined with its component in parts
    sizes = classes.groupBy(F.col("id").alias("of")).agg(F.max("n").alias("most"))
    answer = linked.join(sizes, F.col("id") == F.col("of")).select("of", "component", F.explode(F.when(F.col("most") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
    own = with_least(known.select("doc_id", "n_shingles", "set_hash", "salt"), "set_hash", "doc_id", "id", F.col("salt"))
    own = own.select("doc_id", "n_shingles", "id", F.when(F.col("n") > HOT, F.col("salt")).otherwise(F.lit(0)).alias("own_part"))
    found = own.join(answer, (F.col("id") == F.col("of")) & (F.col("own_part") == F.col("part")), "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = found.union(sigs.filter(~whole).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | F.col("component_id").eqNullSafe(F.col("doc_id"))).alias("kept"))
