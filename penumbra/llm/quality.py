"""Quality classifier: a weak-label model over heuristic labellers teaches a hashed linear scorer.

Seven heuristics vote junk, clean or nothing on each text. Expectation maximisation over the counts of vote patterns of all documents (at most 3**7
patterns) estimates how often each labeller votes what on junk and on clean texts, with no labels given. The posterior probabilities of
a bounded sample of documents then train a logistic scorer on hashed shapes of words, which scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import Memo

#: Expected number of documents in the scorer's training sample.
SAMPLE = 4000
FEATURES, CALM = 2048, 6
#: name: (clean if below, junk if above) of a share between 0 and 1, or the other way round if the first is larger.
LABELLERS = {
    "symbols": (0.02, 0.06),  # of all characters, ASCII marks that prose has no use for
    "capitals": (0.2, 0.4),  # of all letters
    "repeats": (0.05, 0.15),  # words equal to the word before
    "shouts": (0.05, 0.25),  # exclamation marks per word
    "bars": (0.02, 0.2),  # words that are separators
    "variety": (0.25, 0.12),  # distinct words in every 100 words, of all words
    "stops": (0.03, 0.005),  # words that end a sentence or clause
}
ODD = np.zeros(256, bool)
ODD[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True


def measures(text: str | None) -> list[float] | None:
    """A number for each labeller; none for texts without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = raw.split()
    if not w:
        return None
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(w)
    upper = counts[UPPER].sum()
    again = sum(map(bytes.__eq__, w, w[1:]))
    variety = sum(len(set(w[i : i + 100])) for i in range(0, n, 100)) / n
    stops = sum(x[-1] in b".,;:?" for x in w)
    return [counts[ODD].sum() / len(raw), upper / max(1, upper + counts[LOWER].sum()), again / n, counts[33] / n, sum(x in (b"|", b"||", b"-", b"/") for x in w) / n, float(variety), stops / n]


def votes(text: str | None) -> int:
    """The vote pattern: a base-3 digit per labeller, 0 nothing, 1 clean, 2 junk. Texts of under 5 words get no votes on capitals, variety and stops."""
    m = measures(text)
    if m is None:
        return 0
    few, out = len((text or "").split(maxsplit=5)) < 5, 0
    for i, (x, (name, (clean, junk))) in enumerate(zip(m, LABELLERS.items(), strict=True)):
        if few and name in ("capitals", "variety", "stops"):
            continue
        sign = 1 if clean < junk else -1
        out += 3**i * (1 if sign * x < sign * clean else 2 if sign * x > sign * junk else 0)
    return out


def weak_labels(patterns: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior probability of junk by vote pattern, from counts of patterns: Dawid-Skene with a distribution of votes per labeller and class."""
    if not patterns:
        return {}
    keys = np.array(sorted(patterns))
    n = np.array([patterns[k] for k in keys.tolist()], float)
    digits = (keys[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    junk, clean = (digits == 2).sum(1), (digits == 1).sum(1)
    # to begin with, one vote for junk in a text weighs as much as three for clean
    post = np.where(junk > 0, junk / np.maximum(junk + clean / 3, 1e-9), 0.02)
    for _ in range(rounds):
        logs = []
        for p in (1 - post, post):
            total = (n * p).sum()
            log = np.full(len(keys), np.log((total + 1) / (n.sum() + 2)))
            for i in range(digits.shape[1]):
                share = (np.bincount(digits[:, i], n * p, minlength=3) + 0.5) / (total + 1.5)
                log += np.log(share)[digits[:, i]]
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(keys.tolist(), post.tolist(), strict=True))


#: Upper case to X, lower case and bytes of longer characters to x, digits to 9, ASCII marks as they are.
KINDS = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
RUN = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> int:
    """The bucket of a word's shape: its runs of one kind of byte, as one each, and its length in steps of four, 24 bytes and more being one step."""
    import xxhash

    return xxhash.xxh3_64_intdigest(RUN.sub(rb"\1", word.translate(KINDS)) + bytes([min(len(word), 24) // 4])) % (FEATURES - 1)


def features(text: str | None, shapes: Memo) -> np.ndarray:
    """Shares of words by bucket, the last for a word said again at once; as if CALM more words fell into none, so that few words prove little."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    out = np.bincount(np.fromiter(map(shapes.__getitem__, w), np.int64, len(w)), minlength=FEATURES).astype(float)
    out[-1] = sum(map(bytes.__eq__, w, w[1:]))
    return out / (len(w) + CALM)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights by full-batch gradient steps with running scales; y are probabilities. The bias stays at the share of y overall: it is the
    verdict on a text with nothing to go by."""
    share = (y.sum() + 1) / (len(y) + 2)
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(share / (1 - share)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        err = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        g = x.T @ err / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float64), b


def fit_quality(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer's weights and bias. Counts of votes cover all rows of docs (doc_id, text); the scorer sees about `sample` different rows.

    Rows are chosen by a hash of doc_id and text, each once however often it is repeated, so a job that runs again chooses the same. Null texts are empty ones; a null
    doc_id is a value like others. An empty table gives weights of zero and a bias for clean.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id"), "text")

    def vote_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in batch.column("text").to_pylist()], pa.int64())], names=["pattern"])

    rows = texts.select("text").mapInArrow(vote_run, "pattern long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = {r["pattern"]: r["n"] for r in rows}
    posterior = weak_labels(patterns)
    total = sum(patterns.values())
    if not total:
        return np.zeros(FEATURES), -1.0
    part = min(1.0, sample / total)
    chosen = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(part * (1 << 30))).distinct()

    def feature_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Memo(shape)
        for batch in batches:
            t = batch.column("text").to_pylist()
            x = [features(s, shapes) for s in t]
            yield pa.RecordBatch.from_arrays([pa.array([np.flatnonzero(r).astype(np.int32) for r in x], pa.list_(pa.int32())), pa.array([r[r > 0] for r in x], pa.list_(pa.float64())), pa.array([votes(s) for s in t], pa.int64())], names=["at", "share", "pattern"])

    # as many rows as the sample has, and only their features
    data = chosen.mapInArrow(feature_run, "at array<int>, share array<double>, pattern long").select("at", "share", "pattern", F.xxhash64("at", "share").alias("order")).toArrow().combine_chunks()
    if not data.num_rows:
        return np.zeros(FEATURES), -1.0
    # columns as they come, not a Python object for each number; in an order that a job run again has too
    data = data.sort_by([("order", "ascending"), ("pattern", "ascending")])
    at, share = (data.column(c).combine_chunks() for c in ("at", "share"))
    x = np.zeros((data.num_rows, FEATURES), np.float32)
    x[np.repeat(np.arange(data.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = share.flatten().to_numpy()
    y = np.array([posterior.get(p, 0.0) for p in data.column("pattern").to_pylist()], np.float32)
    del data, at, share
    return fit_logistic(x, y)


def with_quality(docs: DataFrame, model: tuple[np.ndarray, float], score: str = "score") -> DataFrame:
    """docs with a column of the probability of being clean, 0 to 1; it replaces a column of that name. No shuffle.

    A null or empty text gets the share of clean documents; all rows and other columns stay. An empty table gives no rows.
    """
    weights, bias = model

    @F.pandas_udf("double")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes = Memo(shape)
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(np.clip(features(t, shapes) @ weights + bias, -50, 50))) for t in texts], dtype=float)

    return docs.withColumn(score, clean("text"))


def score_quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Returns (doc_id, score, kept): the probability that a text is clean, and whether it is at least `least`.

    A null text is an empty one, which is judged by the share of junk overall. Repeated rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    return with_quality(docs.select("doc_id", "text"), fit_quality(docs)).select("doc_id", "score", (F.col("score") >= least).alias("kept"))
