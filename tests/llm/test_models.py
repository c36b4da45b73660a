"""Quality, language model, fingerprints, decontamination and toxicity."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from common_cases import awkward, empty
from pyspark.sql import functions as F

from penumbra.llm import decontam, lattice_lm, quality, toxicity, winnow
from penumbra.llm.queries import tokenizer_file

PIECES = tokenizer_file("piece_bpe_32k.model")


# --- quality


def test_em_finds_the_labellers_accuracies():
    """Votes drawn from known accuracies: the posterior tells junk from clean far better than one labeller."""
    rng = np.random.default_rng(0)
    n, share = 20_000, 0.15
    junk = rng.random(n) < share
    digits = np.zeros((n, len(quality.LABELLERS)), int)
    for i in range(digits.shape[1]):
        right = rng.random(n) < 0.85
        digits[:, i] = np.where(rng.random(n) < 0.2, 0, np.where(right == junk, 2, 1))
    keys = (digits * 3 ** np.arange(digits.shape[1])).sum(1)
    counts = dict(zip(*(x.tolist() for x in np.unique(keys, return_counts=True)), strict=True))
    post = quality.weak_labels(counts)
    assert np.mean([(post[k] > 0.5) == j for k, j in zip(keys.tolist(), junk, strict=True)]) > 0.97
    assert quality.weak_labels({}) == {}


def test_quality_on_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.score_quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1]
    junk = [r.kept for r in got if r.quality == 0]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.1


def plain_votes(text):
    """A vote per labeller (0 nothing, 1 clean, 2 junk), counted byte by byte; None for a text without words."""
    raw, w = text.encode(), text.encode().split()
    if not w:
        return None
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    seen = {
        "symbols": sum(chr(b) in "#$%&*+/<=>@[\\]^_`{|}~" for b in raw) / len(raw),
        "capitals": upper / max(1, upper + lower),
        "repeats": sum(x == y for x, y in itertools.pairwise(w)) / len(w),
        "shouts": raw.count(b"!") / len(w),
        "bars": sum(x in (b"|", b"||", b"-", b"/") for x in w) / len(w),
        "variety": sum(len(set(w[i : i + 100])) for i in range(0, len(w), 100)) / len(w),
        "stops": sum(x.endswith((b".", b",", b";", b":", b"?")) for x in w) / len(w),
    }
    out = []
    for name, (clean, junk) in quality.LABELLERS.items():
        x = seen[name]
        vote = (1 if x < clean else 2 if x > junk else 0) if clean < junk else (1 if x > clean else 2 if x < junk else 0)
        out.append(0 if len(text.split()) < 5 and name in ("capitals", "variety", "stops") else vote)
    return out


def plain_posteriors(rows):
    """Expectation maximisation over the rows one by one, not over counts of patterns."""
    post = []
    for v in rows:
        junk, clean = v.count(2), v.count(1)
        post.append(junk / (junk + clean / 3) if junk else 0.02)
    for _ in range(100):
        share = [[[(0.5 + sum(p if c else 1 - p for p, v in zip(post, rows, strict=True) if v[i] == k)) / (1.5 + sum(p if c else 1 - p for p in post)) for k in range(3)] for i in range(len(rows[0]))] for c in (0, 1)]
        prior = [(1 + sum(p if c else 1 - p for p in post)) / (len(rows) + 2) for c in (0, 1)]
        new = []
        for v in rows:
            clean, junk = (math.log(prior[c]) + sum(math.log(share[c][i][k]) for i, k in enumerate(v)) for c in (0, 1))
            new.append(1 / (1 + math.exp(max(-50, min(50, clean - junk)))))
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9
        if done:
            break
        post = new
    return post


def test_quality_equals_plain_version(spark):
    """The result over a table: votes, posteriors, hashed shapes and scorer, each written out plainly; the sample holds all rows."""
    import xxhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").distinct()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    labels = plain_posteriors([plain_votes(t) or [0] * len(quality.LABELLERS) for _, t in rows])

    def shares(text):
        w, out = text.encode().split(), np.zeros(quality.FEATURES)
        for x in w:
            kinds = ["X" if 65 <= b <= 90 else "x" if 97 <= b <= 122 or b >= 128 else "9" if 48 <= b <= 57 else chr(b) for b in x]
            runs = "".join(k for k, _ in itertools.groupby(kinds)).encode()
            out[xxhash.xxh3_64_intdigest(runs + bytes([min(len(x), 24) // 4])) % (quality.FEATURES - 1)] += 1
        out[-1] = sum(x == y for x, y in itertools.pairwise(w))
        return out / (len(w) + quality.CALM)

    x, y = np.array([shares(t) for _, t in rows]), np.array(labels)
    share = (y.sum() + 1) / (len(y) + 2)
    w, b = np.zeros(x.shape[1]), math.log(share / (1 - share))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 401):
        slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    expected = {i: 1 / (1 + math.exp(s)) for (i, _), s in zip(rows, x @ w + b, strict=True)}
    got = {r.doc_id: r for r in quality.score_quality(docs).collect()}
    assert got.keys() == expected.keys()
    assert max(abs(got[i].score - s) for i, s in expected.items()) < 0.02
    assert all(got[i].kept == (s >= 0.5) for i, s in expected.items() if abs(s - 0.5) > 0.02)


def test_quality_awkward_rows(spark):
    got = quality.score_quality(awkward(spark)).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(empty(spark)).count() == 0


# --- language model


def brute_log(word, pieces, logs):
    """The sum over all segmentations, one by one."""
    s = lattice_lm.MARK + word

    def rest(i):
        if i == len(s):
            return 0.0
        terms = [logs[pieces.ids[s[i:j]]] + rest(j) for j in range(i + 1, len(s) + 1) if s[i:j] in pieces.ids and lattice_lm.MARK not in s[max(i, 1) : j]]
        if i:
            terms.append(sum(logs[pieces.bytes[b]] for b in s[i].encode()) + rest(i + 1))
        return np.logaddexp.reduce(terms) if terms else -np.inf

    return rest(0)


def test_forward_sums_equal_all_segmentations():
    pieces = lattice_lm.Pieces(PIECES)
    logs = np.append(np.log(np.random.default_rng(0).dirichlet(np.ones(pieces.size))), -np.inf)
    for group in (["the", "cat", "éèx", "日本語", "a▁b"], ["nation", "▁▁▁▁▁▁"], ["x"]):
        got = lattice_lm.lattices(group, pieces, logs)[3][:, -1]
        assert np.allclose(got, [brute_log(w, pieces, logs) for w in group])


def test_expected_counts_equal_derivatives():
    """Expected counts are the derivative of the log probability by the pieces' logs."""
    pieces = lattice_lm.Pieces(PIECES)
    logs, _ = pieces.log_probabilities({})
    word = "nation"
    counts = lattice_lm.expected_counts([word], np.ones(1), pieces, logs)
    for i in np.argsort(-counts)[:6]:
        up, down = logs.copy(), logs.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (lattice_lm.lattices([word], pieces, up)[3][0, -1] - lattice_lm.lattices([word], pieces, down)[3][0, -1]) / 2e-5
        assert counts[i] == pytest.approx(slope, abs=1e-4)


def test_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in lattice_lm.lattice_scores(docs, PIECES).collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = {}
    for i, t in rows.items():
        for w in [*(t.encode().lower().split()), None]:
            if i not in held:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert set(got) == set(rows)
    for i, t in rows.items():
        r, tokens = got[i], [*t.encode().lower().split(), None]
        assert r.held_out == (i in held) and r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(w in counts for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
        assert -20 * 10 * len(tokens) < min(r.score, r.word_score) and max(r.score, r.word_score) < 0
    per = lambda rs, c: sum(r[c] for r in rs) / sum(r.n_tokens for r in rs)
    for c in ("score", "word_score"):
        assert per([got[i] for i in held], c) < per([r for i, r in got.items() if i not in held], c) < -1


def test_scores_equal_all_segmentations_one_by_one(spark):
    """The query against a plain version: training by counts of segmentations that are listed one by one, with the same rounds."""
    texts = ["the cat sat", "The cat", "nation of cats the cat", "", "état née cat", "a rat sat on the nation", "xq zz cat"] * 4
    docs = list(enumerate(texts, 1))
    pieces = lattice_lm.Pieces(PIECES)
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 10 != 0]
    words = [w for t in train for w in t.encode().lower().decode().split()]

    def paths(word):
        """(pieces) of each segmentation."""
        s = lattice_lm.MARK + word

        def rest(i):
            if i == len(s):
                yield ()
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in pieces.ids:
                    yield from ((pieces.ids[s[i:j]], *p) for p in rest(j))
            if 0 < i < len(s):
                yield from ((*(pieces.bytes[b] for b in s[i].encode()), *p) for p in rest(i + 1))

        return list(rest(0))

    listed = {w: paths(w) for w in {w for _, t in docs for w in t.encode().lower().decode().split()}}

    def spread(counts):
        p = {i: lattice_lm.SMOOTH for i in pieces.known}
        for i, n in counts.items():
            p[i] += n
        total = sum(p.values()) + len(train) + lattice_lm.SMOOTH
        return {i: x / total for i, x in p.items()}, (len(train) + lattice_lm.SMOOTH) / total

    counts = {}
    for w in words:
        for i in pieces.model.encode(w):
            counts[i] = counts.get(i, 0) + 1
    p, end = spread(counts)
    for _ in range(2):
        counts = {}
        for w in words:
            weights = [math.prod(p[i] for i in path) for path in listed[w]]
            for path, x in zip(listed[w], weights, strict=True):
                for i in path:
                    counts[i] = counts.get(i, 0) + x / sum(weights)
        p, end = spread(counts)
    got = {r.doc_id: r.score for r in lattice_lm.lattice_scores(spark.createDataFrame(docs, "doc_id long, text string"), PIECES, rounds=2).collect()}
    for i, t in docs:
        plain = math.log10(end) + sum(math.log10(sum(math.prod(p[x] for x in path) for path in listed[w])) for w in t.encode().lower().decode().split())
        assert got[i] == pytest.approx(plain, rel=1e-6)


def test_probabilities_sum_to_one(spark):
    """Over all words that training has, and all spellings of one or two letters, no more than one; nearly all of it on training words."""
    docs = spark.createDataFrame([(i, "aa ab ba bb aa ab aa") for i in range(40)], "doc_id long, text string")
    probes = ["".join(p) for n in (1, 2) for p in itertools.product("abcdefghij", repeat=n)]
    ask = spark.createDataFrame([(1000 + i, w) for i, w in enumerate(probes)], "doc_id long, text string").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    got = lattice_lm.lattice_scores(docs.unionByName(ask), PIECES).collect()
    # one token in eight is an end, which each of these texts has once
    assert all(sum(10 ** r[c] for r in got if r.doc_id >= 1000) < 1 / 7 for c in ("score", "word_score"))


def test_head_and_tail_agree(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r.doc_id: r for r in lattice_lm.lattice_scores(docs, PIECES, rounds=0).collect()}
    monkeypatch.setattr(lattice_lm, "HEAD", 50)
    b = {r.doc_id: r for r in lattice_lm.lattice_scores(docs, PIECES, rounds=0).collect()}
    assert all(a[i].n_known == b[i].n_known and a[i].score == pytest.approx(b[i].score, rel=1e-9) and a[i].word_score == pytest.approx(b[i].word_score, rel=1e-9) for i in a)


def test_language_model_awkward_rows(spark):
    got = lattice_lm.lattice_scores(awkward(spark), PIECES).collect()
    assert len(got) == 11 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    twins = [r for r in got if r.doc_id == 5]
    assert len(twins) == 2 and twins[0].score == twins[1].score and twins[0].n_tokens == 9
    assert lattice_lm.lattice_scores(empty(spark), PIECES).count() == 0


# --- fingerprints


def plain_marks(text, k, window):
    h = winnow.gram_hashes(winnow.code_points(text), k).tolist()
    out = []
    for i in range(max(1, len(h) - window + 1)) if h else []:
        part = h[i : i + window]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1][1] != at:
            out.append((min(part), at))
    return out


def test_marks_equal_plain_winnowing():
    rng = random.Random(0)
    for n in [0, 1, 5, 15, 16, 17, 30, 31, 32, 33, 200, 500]:
        for letters in ("ab", "abcdefghijklmnop é日"):
            text = "".join(rng.choice(letters) for _ in range(n))
            for k, w in ((16, 16), (5, 4), (3, 7), (7, 1)):
                got = winnow.marks(winnow.code_points(text), k, w)
                assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == plain_marks(text, k, w)


def test_hashes_are_of_grams_alone():
    text = "the quick brown fox the quick brown fox"
    for k in (1, 2, 3, 5, 7, 16):
        h = winnow.gram_hashes(winnow.code_points(text), k).tolist()
        seen = {}
        for i, x in enumerate(h):
            assert seen.setdefault(text[i : i + k], x) == x
        assert len(set(h)) == len(seen)


def test_shared_run_has_a_shared_mark():
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(200):
        run = make(winnow.K + winnow.WINDOW - 1)
        a, b = (winnow.marks(winnow.code_points(make(rng.randint(0, 99)) + run + make(rng.randint(0, 99))))[0] for _ in range(2))
        assert set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("parts", [1, 7, 400])
def test_edits_follow_the_next_document(spark, sf, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in winnow.edited_likeness(docs, parts=parts).collect()}
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert all((x == y).all() for f, whole in ((r.fingerprint, t), (r.edited_fingerprint, edited)) for x, y in zip(winnow.read_marks(f), winnow.marks(winnow.code_points(whole)), strict=True))
        tally = lambda x: winnow.tally(winnow.marks(winnow.code_points(x))[0])
        assert r.near_edited == winnow.likeness(tally(t), tally(edited)) and r.near_next == winnow.likeness(tally(t), tally(after))


def test_fingerprints_awkward_rows(spark):
    got = winnow.edited_likeness(awkward(spark)).collect()
    assert len(got) == 11 and len({r.fingerprint for r in got if r.doc_id == 5}) == 1 and all(0 <= r.near_edited <= 1 for r in got)
    assert winnow.edited_likeness(empty(spark)).count() == 0 and winnow.fingerprints(empty(spark)).count() == 0
    by = {r.doc_id: r for r in winnow.fingerprints(awkward(spark)).collect()}
    assert by[1].marks == [] == by[2].marks and len(by[4].marks) == 1
    one = spark.createDataFrame([(1, "lonely")], "doc_id long, text string")
    assert winnow.edited_likeness(one).first().near_next == 1.0


# --- decontamination


def plain_align(item, words):
    h = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (decontam.MATCH if a == b else decontam.MISMATCH), h[i - 1][j] + decontam.GAP, h[i][j - 1] + decontam.GAP)
    return max(map(max, h))


def test_alignment_equals_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(40):
        item = rng.integers(0, 6, rng.integers(1, 25))
        passages = rng.integers(0, 6, (5, rng.integers(1, 50)))
        got = decontam.align(item, passages)[0]
        assert got.tolist() == [plain_align(item.tolist(), p.tolist()) for p in passages]


def test_copies_are_found_and_others_left(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [make(rng.randint(12, 40)) for _ in range(30)]
    docs, expected = [], set()
    for i in range(300):
        text = make(rng.randint(20, 150))
        if i % 3 == 0:
            n = rng.randrange(30)
            copy = list(items[n])
            for _ in range(len(copy) // 7 if i % 2 else 0):  # a word in seven changed, put in or left out
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = rng.choice([[], make(1), make(1)])
            at = rng.randrange(len(text))
            text[at:at] = copy
            expected.add((i, n))
        docs.append((i, " ".join(text).capitalize() + "."))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)] + [(98, None), (99, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == expected


def test_copies_with_words_changed_at_steps(spark):
    """Every fourth to sixth word changed, with and without word-for-word copies elsewhere, against a full search."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [make(n) for n in (15, 30, 60) for _ in range(2)]
    docs = [make(20) + item + make(20) for item in items[::2] for _ in range(2)]
    for item in items:
        for step in (4, 5, 6):
            for begin in range(step):
                docs.append(make(20) + [f"new{i}" if i % step == begin else w for i, w in enumerate(item)] + make(20))
    expected = {(i, n): s for i, d in enumerate(docs) for n, item in enumerate(items) if (s := plain_align(item, d) / (2 * len(item))) >= 0.5}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), bench).collect()}
    assert len(expected) == len(docs) and got == {k: pytest.approx(s, abs=1e-4) for k, s in expected.items()}


def test_decontamination_equals_full_search(spark, sf):
    """All documents against all items by containment of the item's words as a whole."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: b" " + b" ".join(decontam.plain_words(t)) + b" "
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in plain(r.text)}
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    assert whole == {k for k, s in got.items() if s == 1.0} and whole
    left = decontam.without_contaminated(docs, bench)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - {i for i, _ in got}


def test_short_items_are_whole_clauses(spark):
    bench = spark.createDataFrame([(1, "Yes."), (2, "forty two"), (3, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Is it? Yes! Or so"), (2, "yes it is"), (3, "The answer:\nForty, two\nis known"), (4, "forty two trees"), (5, "a\none. two! Three four\nb"), (6, None), (7, "so: one two three four")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.last_word) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1): (1.0, 3), (3, 2): (1.0, 4), (5, 3): (1.0, 5), (7, 3): (1.0, 5)}


def test_common_runs_are_no_seeds_unless_the_item_has_no_others(spark):
    """A run of words in every document; an item with other words beside it, and one of common runs alone."""
    docs = [(i, f"it is known that everybody says so d{i} e{i} f{i}") for i in range(400)]
    docs += [(1000, "alpha beta gamma it is known that delta epsilon zeta eta theta")]
    items = [(1, "alpha beta gamma it is known that delta epsilon zeta eta theta"), (2, "it is known that everybody says so")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    own = decontam.items_of(bench, 5)
    source = frame.withColumn("row", F.xxhash64("doc_id"))
    seeds = {(r.item_id, r["at"]) for r in decontam.seeds_of(own, decontam.occurrences(source, own)).collect()}
    assert {(1, 0), (1, 1), (1, 7), (1, 9)} <= seeds and not {(1, 3), (1, 4)} & seeds and {at for i, at in seeds if i == 2} == set(range(5))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert got == {(1000, 1), (1000, 2)} | {(i, 2) for i in range(400)}


def test_every_stretch_of_an_item_has_a_seed(spark):
    """Twenty words that many documents hold, and twenty of its own: a copy of the common half alone is found beyond FEW documents."""
    common, own = [f"c{i}" for i in range(20)], [f"o{i}" for i in range(20)]
    docs = [(i, " ".join([f"d{i}", *common])) for i in range(decontam.FEW + 50)] + [(1000, " ".join(own))]
    bench = spark.createDataFrame([(1, " ".join(common + own))], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = decontam.items_of(bench, 5)
    seeds = sorted(r["at"] for r in decontam.seeds_of(items, decontam.occurrences(frame.withColumn("row", F.xxhash64("doc_id")), items)).collect())
    among = [at for at in seeds if at < 18]
    assert 0 < len(among) < 18 and all(any(s <= at < s + decontam.STRETCH for at in among) for s in range(18 - decontam.STRETCH + 1)) and set(range(20, 38)) <= set(seeds)
    got = {r.doc_id: r.score for r in decontam.contaminated(frame, bench).collect()}
    assert got == {i: 0.5 for i, _ in docs}


def test_recall_against_all_alignments(spark):
    """Every document of the given table aligned with every item of five words or more, without seeds."""
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    items = {r.item_id: decontam.plain_words(r.text) for r in bench}
    codes: dict[bytes, int] = {}
    number = lambda w: np.array([codes.setdefault(x, len(codes)) for x in w], np.int64)
    coded = {i: number(w) for i, w in items.items() if len(w) >= 5}
    expected = set()
    for r in docs:
        words = number(decontam.plain_words(r.text))[None, :]
        for i, w in coded.items():
            # a score of one half needs as many matching words
            if words.size and 2 * np.isin(w, words).sum() >= len(w) and decontam.align(w, words)[0][0] >= decontam.MATCH * len(w) / 2:
                expected.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r.item_id in coded}
    assert expected and got == expected


def test_decontamination_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (None, None), (3, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()] == [(5, 1)]
    assert decontam.contaminated(empty(spark), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.without_contaminated(docs, bench).count() == 9


# --- toxicity


def plain_kernel(a, b):
    """Likeness of two words by their gapped triples, counted one by one."""

    def vector(word):
        s, out = toxicity.EDGE[0] + word + toxicity.EDGE[1], []
        for i in range(len(s)):
            for x, y in toxicity.GAPS:
                if i + x + y < len(s):
                    out.append((s[i] + s[i + x] + s[i + x + y], toxicity.DISCOUNT ** (x + y - 2)))
        norm = math.sqrt(sum(w * w for _, w in out))
        return [(t, w / norm) for t, w in out]

    return min(1.0, sum(v * w for t, v in vector(a) for u, w in vector(b) if t == u))


def test_kernel_equals_plain_version():
    landmarks = ["idiot", "clown", "worthless", "achlichte"]
    words = ["idiot", "idixot", "idiots", "clwn", "worthless", "worth", "tree", "achlich", "achlichkeit"]
    table = toxicity.landmark_table(landmarks)
    at, near = toxicity.kernel(words, table, table.max(axis=1))
    got = np.zeros((len(words), len(landmarks)))
    got[at] = near
    for i, w in enumerate(words):
        for j, m in enumerate(landmarks):
            k = plain_kernel(w, m)
            assert got[i, j] == pytest.approx(k**toxicity.POWER if k >= toxicity.FLOOR else 0, abs=0.02)
    assert got[1, 0] > 0 and got[6].max() == 0


# likeness by the kernel's formula with gaps up to three, fixed so that a smaller kernel or a higher floor shows
INSERTED = [("idiot", "ixdixot", 0.4484), ("moron", "moxxron", 0.4711), ("clown", "clxxown", 0.4053), ("idiot", "idxxiot", 0.4382), ("idiot", "ixdxixot", 0.3026), ("moron", "moxxrxon", 0.3487), ("clown", "clxxxown", 0.3154), ("idiot", "idxxxiot", 0.346)]


@pytest.mark.parametrize("insult, word, likeness", INSERTED)
def test_two_and_three_letters_put_in(insult, word, likeness):
    assert plain_kernel(word, insult) == pytest.approx(likeness, abs=1e-3)
    table = toxicity.landmark_table([insult])
    at, near = toxicity.kernel([word], table, table.max(axis=1))
    assert at.tolist() == [0] and near[0, 0] == pytest.approx(likeness**3, abs=0.005)


def test_units_see_through_marks_and_spaces():
    assert toxicity.units("you i d i o t now") == ["you", "idiot", "now"] and toxicity.units("a b c") == ["a", "b", "c"]
    assert toxicity.unit("Id-i.ot!") == "idiot" and toxicity.units("") == []


def test_long_words_are_seen_whole():
    """An insult far behind the 40th letter of a run-together word adds as much as behind the 20th; every run of a piece's letters less a step is in one piece."""
    word = "abcdefghijklmnopqrstuvwxyz" * 8
    for size in (41, 57, 100, 208):
        cut = toxicity.pieces(word[:size])
        runs = {p[i : i + toxicity.PIECE - toxicity.STEP] for p in cut for i in range(len(p))}
        assert all(word[i : i + toxicity.PIECE - toxicity.STEP] in runs for i in range(size - toxicity.PIECE + toxicity.STEP + 1))
    rows = [(f"you are an idiot number {i}. go away", 1, i % 2) for i in range(40)] + [(f"the tree stands by house {i}. it is green", 0, i % 2) for i in range(40)]
    model = toxicity.fit_toxicity(rows, (40, 40))
    junk = "qzwxvkjh" * 12
    near, far, none = model.valued([junk[:24] + "idiot" + junk[:16], junk + "idiot" + junk, junk + junk]).values()
    assert far == pytest.approx(near, abs=0.05) and far > none + 0.05


def test_scores_are_the_machines_decisions(spark):
    """Scores of the query against a plain version: likenesses letter by letter, sums by sentence, the bias, and the curve."""
    rng = random.Random(3)
    harmless = "tree house river walk green stone path light the a of and is".split()
    insults = ["idiot", "ixdiot", "moron", "clown", "i d i o t"]
    rows = []
    for i in range(240):
        w = [rng.choice(harmless) for _ in range(rng.randint(4, 30))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        text = " ".join(w)
        rows.append((i, text.replace(" and ", ". And ") + rng.choice([".", "!", ""]), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    learned = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    part = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.shiftright(F.xxhash64("doc_id"), 20), F.lit(2)).alias("p")).collect()}
    counts = (sum(y == 0 for *_, y in learned), sum(y for *_, y in learned))
    model = toxicity.fit_toxicity([(t, y, part[i]) for i, t, y in learned], counts)
    marks = toxicity.pick_landmarks([[set(map(toxicity.unit, toxicity.units(t))) for i, t, y in learned if part[i] == 0 and y == c] for c in (0, 1)])

    def value(word):
        likes = [plain_kernel(word, m) for m in marks] if len(word) >= 3 else []
        return sum(k**toxicity.POWER * w for k, w in zip(likes, model.weights, strict=False) if k >= toxicity.FLOOR)

    for i, t, _ in rows:
        decided, now = [], []
        for token in toxicity.units(t):
            now.append(value(toxicity.unit(token)))
            if token[-1] in ".!?":
                decided.append(sum(now) + model.bias)
                now = []
        decided += [sum(now) + model.bias] if now else []
        total = sum(max(0, d) for d in decided)
        z = np.dot([max(decided), math.log1p(total), math.log1p(200 * total / max(20, len(toxicity.units(t))))], model.curve[:3]) + model.curve[3]
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=0.03)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    toxic, other = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.8 and sum(other) / len(other) < 0.03


def test_toxicity_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, 0), (5, 1), (None, 1), (6, None), (7, 3)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == 11 and toxicity.score_toxicity(empty(spark), labels).count() == 0


def test_pieces_are_found_letter_by_letter():
    """Every substring that is a piece and no other, with word marks, unknown letters and lone surrogates in the words."""
    pieces = lattice_lm.Pieces(PIECES)
    assert len(pieces.steps) == len(pieces.next) == len(pieces.at) - 1
    for group in (["the", "\u2581he", "t\u2581e", "\ud800\U0001f600e"[:3], "日本\x00"], ["internationally", "xqzjkvwpyxqzjkv"], ["a"]):
        ids = lattice_lm.lattices(group, pieces, np.zeros(pieces.size + 1))[0]
        for r, w in enumerate(lattice_lm.MARK + w for w in group):
            for i in range(len(w)):
                for k in range(ids.shape[2]):
                    part = w[i : i + k + 1]
                    fits = i + k < len(w) and lattice_lm.MARK not in w[max(i, 1) : i + k + 1]
                    assert ids[r, i, k] == (pieces.ids.get(part, -1) if fits else -1)
