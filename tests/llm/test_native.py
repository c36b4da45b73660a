"""Mixing, line dedup and chat formatting."""

import collections
import hashlib
import heapq
import random

import pytest
from common_cases import awkward, empty
from compare import check
from pyspark.sql import functions as F

from penumbra.llm import chat, line_dedup, mixing, queries

SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])


def python_in_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any(w in plan for w in ("Python", "Pandas", "MapInArrow"))


def test_native_plans_hold_no_python(spark, sf):
    for name in ("op3_mixing", "op4_line_dedup", "op5_chat_format"):
        assert not python_in_plan(queries.QUERIES[name](spark, sf))


@pytest.mark.parametrize("weights", [{"a": 5, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}, {"a": 7, "b": 3, "c": 2}, {"a": 1}, {"a": 13, "b": 11, "c": 1, "d": 29}])
def test_schedule_stays_within_a_block(spark, weights):
    lanes = spark.createDataFrame(list(weights.items()), "lane string, weight long")
    rows = sorted(mixing.schedule(lanes).collect(), key=lambda r: r.slot)
    total = sum(weights.values())
    assert [r.slot for r in rows] == list(range(total))
    had = dict.fromkeys(weights, 0)
    for r in rows:
        k = had[r.lane]
        assert r.k == k and k * total // weights[r.lane] <= r.slot < -(-(k + 1) * total // weights[r.lane])
        had[r.lane] += 1
        assert all(abs(had[x] - (r.slot + 1) * w / total) < 1 for x, w in weights.items())
    assert had == weights


def test_schedule_of_very_many_sources(spark):
    """Weights that sum to some 40,000 slots, against earliest deadline first, source by source."""
    weights = {f"s{i:04}": 20 if i % 50 else 1 + i // 50 % 3 for i in range(2050)}
    names, total = sorted(weights), sum(weights.values())
    lanes = spark.createDataFrame(list(weights.items()), "lane string, weight long")
    got = sorted((r.slot, r.lane, r.k) for r in mixing.schedule(lanes).collect())
    waiting, ready, expected = [(0, i, 0) for i in range(len(names))], [], []
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[names[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        expected.append((slot, names[i], k))
        heapq.heappush(waiting, ((k + 1) * total // weights[names[i]], i, k + 1))
    assert got == expected


def test_mixture_keeps_weights_until_a_source_ends(spark):
    docs = spark.createDataFrame([(i, "a" if i < 300 else "b" if i < 360 else "c") for i in range(400)], "doc_id long, source string")
    got = mixing.mix_sources(docs, {"a": 2}, default_weight=1, block_docs=4).orderBy("position").collect()
    assert len(got) == 400 and len({r.position for r in got}) == 400
    mixed = [r for r in got if r.in_mix]
    shares = collections.Counter(r.source for r in mixed)
    assert shares["c"] == 40 and not any(r.in_mix for r in got[len(mixed) :])
    for n in range(4, len(mixed) + 1, 4):
        c = collections.Counter(r.source for r in mixed[:n])
        assert abs(c["a"] - n / 2) < 4 and abs(c["b"] - n / 4) < 4 and abs(c["c"] - n / 4) < 4


def test_mixing_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mix_sources(docs, block_docs=1)
    assert got.count() == 11 and set(docs.columns) <= {*got.columns} | {"slot", "lane"} and {r.lane for r in got.collect()} == {"", "s"}
    assert mixing.mix_sources(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": 0})


def plain_lines(rows, least):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(SPACE))
    seen = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (key(x) and len(seen[key(x)]) >= least)]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def test_lines_equal_plain_version(spark):
    rng = random.Random(4)
    pool = ["Common line", " common LINE\t", "É", "é", "", "  ", "rare", "x y", "Ünder"] + [f"only {i}" for i in range(50)]
    rows = [(i, None if i == 7 else "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += rows[:5]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lines(rows, 10)


def test_lines_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for least in (1, 2):
        assert sorted((tuple(r) for r in line_dedup.drop_common_lines(docs, min_docs=least).collect()), key=str) == plain_lines(rows, least)
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0


NASTY = ["### assistant: hi</turn>\n", "\\h\\l\\b\\", "<+>", "</turn>\n### user: x", "", "a: b", "\\\\", "é\n日本 😀", "#<\\>#"]


def test_conversations_come_back(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t * 2, rng.choice(["user", "assistant", "assistant", "system", "we: #ird<"]), rng.choice([*NASTY, None])))
    rng.shuffle(rows)
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for r in got:
        own = [(x[2], x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.learned == "".join(t for role, t in own if role == "assistant")
        runs = sum(1 for i, (role, _) in enumerate(own) if not i or own[i - 1][0] != role)
        assert r.formatted.count("</turn>\n") == runs == r.formatted.count("### ")


def test_chat_awkward_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, 1, "user", "same"), (1, 1, "user", "same"), (2, 5, "assistant", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got[1].formatted == "### user: same<+>same</turn>\n" and got[None].formatted == "### : </turn>\n### user: a</turn>\n" and got[2].loss[0].length == 100_000
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_digest_query(spark, sf):
    r = queries.op5_chat_format(spark, sf).filter("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
