"""The index of vectors, the manifest and the trie of conversations, against plain versions."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from common_cases import awkward, empty
from pyspark.sql import functions as F

from penumbra.llm import merkle, multi_index, prefix_trie, queries, ranking
from penumbra.llm.common import stored


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- ranks


def test_ranks_equal_sorting(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, *range(-3, 4), 2**62, -(2**63), 10**6]), f"{rng.randrange(40):064X}") for g in "aabbbc" for _ in range(120)]
    rows = sorted(set(rows), key=str)
    df = stored(spark.createDataFrame(rows, "g string, id long, tie string"), "rows")
    for first, most in ((0, 5), (15, 2048)):
        got = ranking.ranked(df, "g", F.concat(ranking.digits(F.col("id")), F.col("tie")), [F.col("id").asc_nulls_first(), F.col("tie")], first=first, most=most)
        expected = []
        for g in "abc":
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            expected += [(*r, i, len(own)) for i, r in enumerate(own)]
        assert sorted((tuple(r[c] for c in ("g", "id", "tie", "rank", "total")) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_ranks_of_strings_and_copies(spark):
    names = ["", "a", "a ", "ab", "é", "日本", None, "A", "a" * 50, "a" * 50 + "b"]
    df = stored(spark.createDataFrame([("x", n, 1 + i % 3) for i, n in enumerate(names)], "g string, name string, copies int"), "names")
    for most in (1, 100):
        got = {r["name"]: r["rank"] for r in ranking.ranked(df, "g", ranking.letters(F.col("name")), [F.col("name").asc_nulls_first()], first=6, copies="copies", most=most).collect()}
        order = sorted(names, key=lambda n: (n is not None, (n or "").encode()))
        begun = itertools.accumulate((1 + names.index(n) % 3 for n in order), initial=0)
        assert [got[n] for n in order] == list(begun)[:-1]


# ---- manifest


def plain_manifest(rows, altered):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*map(field, (*r[:4], text)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            start = i // 3 * 3
            yield level[start:i], level[i + 1 : start + 3]
            i //= 3

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*way(trees[s], i), *way(top, k)]
            now = leaf(r, altered(r))
            for left, right in steps:
                now = digest(*left, now, *right)
            out.append((r[0], s, i, own, trees[s][-1][0], top[-1][0], digest(*(x for a, b in steps for x in a + b)), now, now == top[-1][0]))
    return sorted(out, key=str)


def no_breaks():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def without_breaks(r):
    return r[4].replace("\n", "") if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n,sources", [(1, 1), (4, 1), (243, 1), (800, 260)])
def test_manifest_equals_plain_version(spark, n, sources):
    """Chunks of 243 and their borders; as many sources as need two chunks."""
    rng = random.Random(n)
    rows = [(rng.randrange(-n, n), f"s{i % sources:03}" if i % 50 or n < 50 else None, None if i % 7 == 0 else "de", i, None if i % 11 == 0 else f"t\n{i}é") for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, FIELDS), no_breaks())
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows, without_breaks)


def test_manifest_awkward_rows(spark):
    docs = awkward(spark)
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in docs.collect()]
    rows += [(5, "s", None, 0, "again")] * 7 + [(None, None, None, None, f"x{i}") for i in range(20)] + [(None, "s", None, None, "")] * 2
    docs = spark.createDataFrame(rows, FIELDS).withColumns({"rank": F.lit("r"), "at": F.lit(1), "bin": F.lit(2), "lane": F.lit(3), "copies": F.lit(4)})
    got = sorted((tuple(r) for r in merkle.manifest(docs, no_breaks()).collect()), key=str)
    assert got == plain_manifest(rows, without_breaks)
    untouched = merkle.manifest(docs).collect()
    assert all(r.verified for r in untouched) and len({r.root for r in untouched}) == 1
    assert merkle.manifest(empty(spark)).count() == 0


def test_ranks_when_ids_pile_up(spark, monkeypatch):
    """Many rows of one doc_id are cut by their leaves."""
    monkeypatch.setattr(ranking, "MOST", 4)
    rows = [(7, "s", "de", 0, f"text {i}") for i in range(60)] + [(None, "s", None, None, f"text {i % 9}") for i in range(60)] + [(i, "s", None, None, None) for i in range(40)]
    got = sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, FIELDS)).collect()), key=str)
    assert got == plain_manifest(rows, lambda r: r[4])


# ---- trie


def plain_trie(rows, base, head):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {c: own.get(base(c), [])[: head(c)] + own[c][head(c) :] for c in own}
    members = collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(made[c]) == len(k)))) for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest(ends[k])) for k, m in members.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string"
@pytest.mark.parametrize("block", [3, 4096])
def test_trie_equals_plain_version(spark, block):
    """Any block size: conversations, paths and lists of ids are cut in blocks or not."""
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([None, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None])))
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(7)]
    c = F.col("conv_id")
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows, lambda c: c - c % 5, lambda c: zlib.crc32(str(c).encode()) % 9)


def test_trie_awkward_rows(spark):
    rows = [(None, 1, "user", "no id"), (1, None, None, None), (1, None, None, None), (1, 3, "user", "x" * 100_000), (6, 1, "u", "a"), (7, 1, "ua", ""), (8, 1, "u", "a"), (-4, 2, "u", "a")]
    rows += [(9, 0, "u", "again")] * 12
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], TURNS + ", node string, depth long, c long")
    for block in (3, 4096):
        got = prefix_trie.prefix_trie(df, block=block).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows, lambda c: c, lambda c: 0)
    # nothing of a conversation is left where its base is absent and its own turns are all left out
    bare = prefix_trie.prefix_trie(df.filter("conv_id = 6"), base=F.lit(99), head=F.lit(8)).collect()
    assert [tuple(r) for r in bare] == [(6, 0, None, 1, 0, 1, 0, digest("6"))]
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


# ---- index of vectors


def plain_nearest(rows, k, is_query):
    fine = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(np.isfinite(v)) and any(v):
            fine[i] = min(fine.get(i, v), v)
    lengths = collections.Counter(map(len, fine.values()))
    usual = min(lengths, key=lambda n: (-lengths[n], n), default=None)
    fine = {i: np.array(v, float) for i, v in fine.items() if len(v) == usual}
    out = {}
    for q in filter(is_query, fine):
        scores = sorted((-float((fine[q] * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((fine[q] ** 2).sum()))), i) for i, v in fine.items() if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


def test_recall_on_the_given_table(spark, sf):
    """At least 0.9 of the true neighbours, in the order of their exact cosines."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_nearest(rows, 5, lambda i: i % 50 == 0)
    got = found(queries.op11_multi_index(spark, sf))
    assert got.keys() == want.keys() and all(len(v) == 5 and [-s for _, s in v] == sorted(-s for _, s in v) for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        for i, s in near:
            assert abs(s - vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i])) < 1e-12


def test_walk_takes_pairs_by_summed_distance():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b, counts = rng.random(7), rng.random(5), rng.integers(0, 3, (7, 5))
        enough = int(rng.integers(0, counts.sum() + 2))
        got = {(i, int(j)) for i, n in multi_index.walk(a, b, counts, enough) for j in np.argsort(b, kind="stable")[:n] if counts[i, j]}
        pairs, seen, want = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(5)), 0, set()
        for _, i, j in pairs:
            if seen >= enough:
                break
            seen += counts[i, j]
            if counts[i, j]:
                want.add((i, j))
        assert got == want


def test_all_reached_equals_brute_force_whatever_the_blocks(spark, monkeypatch):
    """Copies, multiples, unusable rows and repeated ids; the walk sees everything, so nothing may differ."""
    monkeypatch.setattr(multi_index, "VECTORS", 7)
    monkeypatch.setattr(multi_index, "QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).round(1).tolist()) for i in range(150)]
    rows += [(i, [1.0, 2.0, 2.0]) for i in range(200, 260)] + [(i, [2.0, 4.0, 4.0]) for i in range(260, 270)]
    rows += [(300, None), (305, []), (310, [0.0, 0.0, 0.0]), (315, [1.0, None, 0.0]), (320, [float("nan"), 1.0, 1.0]), (325, [float("inf"), 1.0, 1.0]), (330, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (10, [9.0, 1.0, 1.0]), (10, [9.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "v", 1, 2) for r in rows], "vec_id long, embedding array<double>, v string, i int, query long")
    got = found(multi_index.nearest(df, F.col("vec_id") % 5 == 0, reached=1.0, probes=300))
    want = plain_nearest(rows, 5, lambda i: i % 5 == 0)
    assert got == want


def test_few_vectors(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(multi_index.nearest(df([(0, [1.0]), (1, [2.0]), (2, [-1.0])]), F.col("vec_id") == 0)) == {0: [(1, 1.0), (2, -1.0)]}
    assert multi_index.nearest(df([(0, [1.0, 1.0])]), F.lit(True)).count() == 0
    assert multi_index.nearest(df([]), F.lit(True)).count() == 0
    assert multi_index.nearest(df([(0, None), (1, [0.0])]), F.lit(True)).count() == 0
