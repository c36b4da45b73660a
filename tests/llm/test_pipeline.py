"""The corpus pipeline, stage by stage, against plain versions of what each stage decides."""

import pytest
from common_cases import awkward, empty
from pyspark.sql import functions as F
from test_near_dedup import brute
from test_tokens import expected

import corpus_pipeline
from penumbra.llm import decontam, mixing
from penumbra.llm.common import shared_folder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before each stage, and the result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark, "test")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_all_but_the_last_return_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_junk_goes_and_clean_stays(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(stages[1])
    clean, junk = [i in kept for i, q in labels.items() if q], [i in kept for i, q in labels.items() if not q]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.1


def test_one_of_each_group_stays(stages):
    parts = brute([(r.doc_id, r.text) for r in stages[1].collect()], 5, 80)
    assert ids(stages[2]) == {i for i, (_, c) in parts.items() if c == i}


def test_copies_of_the_benchmark_go(spark, stages):
    plain = lambda t: b" " + b" ".join(decontam.plain_words(t)) + b" "
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in stages[2].collect() if any(i in plain(r.text) for i in items)}
    gone = ids(stages[2]) - ids(stages[3])
    assert leaks <= gone and len(gone - leaks) <= 2


def test_mixture_has_its_weights(stages):
    before = {r.source: r["count"] for r in stages[3].groupBy("source").count().collect()}
    after = {r.source: r["count"] for r in stages[4].groupBy("source").count().collect()}
    largest = max(before.values())
    weights = {s: max(1, int(20 * (n / largest) ** 0.7 + 0.5)) for s, n in before.items()}
    total, share = sum(after.values()), sum(weights.values())
    assert ids(stages[4]) <= ids(stages[3])
    assert all(abs(after.get(s, 0) - total * w / share) <= 17 for s, w in weights.items())


def test_mixing_keeps_every_document(spark):
    """With a source of one document, a hot one, a null one and others: all stay, in the mixture's order."""
    source = lambda i: "one" if i == 0 else None if i == 1 else "hot" if i < 700 else f"s{i % 10}"
    docs = spark.createDataFrame([(i, source(i), f"text {i}") for i in range(1500)], "doc_id long, source string, text string")
    got = [tuple(r) for r in corpus_pipeline.mix_to_weights(spark, docs, SF).collect()]
    assert sorted(got, key=lambda r: r[0]) == [tuple(r) for r in docs.collect()]
    assert [r[0] for r in got] == [r.doc_id for r in mixing.mix_sources(docs).orderBy("position").collect()]


def test_tokens_are_those_of_the_documents(stages):
    got = [tuple(r) for r in stages[5].orderBy("start").collect()]
    assert got == expected([(r.doc_id, r.text) for r in stages[4].collect()])


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (3, None, "x"), (3, None, "x"), (None, "p q r", "x"), (None, "p q r", "x"), (None, None, "x"), (4, "", "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([rows[0], rows[3], rows[5], *rows[7:]], key=repr)


def test_stages_bear_awkward_rows(spark):
    docs, none = awkward(spark), empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.exceptAll(docs).count() == 0
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 11 and corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("n_tokens")).first() == stages[5].agg(F.sum("n_tokens")).first()


def test_tokens_of_a_run_are_in_the_order_of_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()]
    assert [r[0] for r in got] == [r.doc_id for r in mixing.mix_sources(docs).orderBy("position").collect()]
    plain = {r[0]: (r[2], r[3]) for r in expected([(r.doc_id, r.text) for r in docs.collect()])}
    assert {r[0]: r[2:] for r in got} == plain
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
