import random
import re

import numpy as np
import pytest
from common_cases import awkward, empty
from pyspark.sql import functions as F

from penumbra.llm import near_dedup


def brute(rows, k, percent):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and part[a] != part[b]:
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {i: new if p == old else p for i, p in part.items()}
    return {i: (len(sets[i]), part[i]) for i in sets}


def copies(seed, groups=12, each=14):
    """Texts with copies that have more and more words changed, so that many similarities lie near the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(2, 120))]
        for n in range(each):
            text = list(base)
            for _ in range(n // 3):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text).upper() if n == 1 else "\n".join(text)))
    return rows


@pytest.mark.parametrize("k, percent, seed", [(3, 85, 1), (5, 80, 2)])
def test_equals_all_pairs(spark, k, percent, seed):
    rows = copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_blocks_lose_no_link(spark, monkeypatch):
    """A group of many blocks: links within and between blocks are found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = copies(3, groups=2, each=60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 85)


def test_chained_boilerplate_is_told_apart(spark, monkeypatch):
    """Texts that overlap their neighbours by two thirds share bands from one end of the chain to the other, yet only real copies are linked."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(6)
    long = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]
    rows = [(i, " ".join(long[20 * i : 20 * i + 120])) for i in range(190)]
    rows += [(1000 + i, f"{t} end") for i, t in rows[::3]] + [(2000 + i, t) for i, t in rows[::7]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 85)


def test_banding_holds_its_promise():
    for percent in range(20, 100):
        bands, width = near_dedup.banding(percent / 100)
        assert bands * width <= near_dedup.MINHASHES and (1 - (percent / 100) ** width) ** bands <= near_dedup.UNSEEN
    with pytest.raises(ValueError):
        near_dedup.banding(0.05)


def test_pruning_keeps_what_reaches_the_threshold():
    least = near_dedup.least_matches(0.85)
    rng = np.random.default_rng(0)
    matches = (rng.random((200_000, near_dedup.MINHASHES)) < 0.85).cumsum(axis=1)
    lost = np.zeros(len(matches), bool)
    for n in range(near_dedup.BATCH, near_dedup.MINHASHES + 1, near_dedup.BATCH):
        lost |= matches[:, n - 1] < least[n]
    assert lost.mean() < 1e-4
    half = (rng.random((10_000, near_dedup.MINHASHES)) < 0.5).cumsum(axis=1)
    assert (half[:, 39] < least[40]).mean() > 0.5


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 90: 90, 95: 90, 100: 90}


def test_awkward_rows(spark):
    got = near_dedup.near_duplicates(awkward(spark)).orderBy("doc_id").collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].kept
    assert by[4].n_shingles == 1 and by[5].n_shingles == 6 and by[7].n_shingles == 1 and by[None].kept and by[None].component_id is None
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_same_as_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs.withColumn("id", F.lit(1))).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def test_one_row_very_often_and_two_texts_of_one_id(spark):
    """Ten thousand copies of one row; a doc_id that comes with two texts."""
    hot = spark.range(10_000).select(F.lit(50).cast("long").alias("doc_id"), F.lit("a b c d e f g").alias("text"))
    rest = spark.createDataFrame([(7, "a b c d e f g"), (60, "q r s t u"), (60, "v w x y z"), (None, "a b c d e f g")], "doc_id long, text string")
    got = near_dedup.near_duplicates(hot.union(rest)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(50, 7, False, 10_000), (7, 7, True, 1), (60, 60, True, 2), (None, None, True, 1)}


def test_few_hashes_are_kept():
    """Workers keep them beside all that the stages of a pipeline hold."""
    from penumbra.llm import decontam

    assert near_dedup.word_hashes().most == decontam.hasher().most == 50_000
