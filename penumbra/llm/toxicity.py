"""Toxicity: a support vector machine with a gapped subsequence string kernel, made linear by Nyström landmarks.

Two words are alike by the letter triples that both hold in order, gaps allowed and discounted (up to two letters passed over within a gap, GAPS lists which), so an insult
with letters put in or between still is like itself. Landmarks are words that tell toxic training documents from others, and harmless words most like them. A sentence is
the sum of its words' likenesses to the landmarks, whitened; a linear machine is trained on the sentences of labelled documents. A document is judged by the machine's
decisions on its sentences, the highest and the sum of those above zero, through a logistic curve fitted on training documents that the machine hasn't seen.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from penumbra.llm.common import per_worker

#: The most toxic and other documents that training reads, and the most characters of them, whole texts as long as there is room.
TOXIC, OTHERS, CHARACTERS = 2000, 3000, 50_000_000
#: The landmarks of each kind.
LANDMARKS, HARMLESS = 96, 32
#: Gaps between the letters of a triple (1: none), the discount for each letter passed over, buckets for triples, the power of the kernel.
GAPS, DISCOUNT, BUCKETS, POWER = ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1)), 0.6, 1 << 13, 3
#: Likenesses below this count as none, which spares most words the whole kernel.
FLOOR = 0.3
#: Marks that end a sentence with the word they stand at; a sentence of more words than this goes on as a new one.
ENDS, SENTENCE = (".", "!", "?"), 50
SPELLED = re.compile(r"(?:^|\s)\S(?:\s+\S){3}(?=\s|$)")
EDGE = "\x02\x03"  # stand for a word's begin and end
#: What a document is judged by: see Model.decisions.
JUDGED = 3
#: Odd factors that spread letters over buckets.
SPREAD = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: The kernel looks at words of more letters by overlapping pieces: PIECE letters from each STEP-th on.
LONGEST, PIECE, STEP = 40, 16, 4


def unit(word: str) -> str:
    """A word's letters in lower case: marks between them don't hide it."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def units(text: str) -> list[str]:
    """Words as letters; four or more single letters in a row are one word."""
    raw = text.split()
    if not SPELLED.search(text):
        return raw
    out: list[str] = []
    run: list[str] = []
    for x in [*raw, ""]:
        if len(x) == 1 and x.isalpha():
            run.append(x)
            continue
        out += ["".join(run)] if len(run) >= 4 else run
        run = []
        if x:
            out.append(x)
    return out


def sentence_starts(tokens: list[str]) -> list[int]:
    """Where sentences begin, the first at 0; none in an empty list."""
    starts, begin = [], 0
    for i, t in enumerate(tokens, 1):
        if t.endswith(ENDS) or i - begin >= SENTENCE:
            starts.append(begin)
            begin = i
    if begin < len(tokens):
        starts.append(begin)
    return starts


def pieces(word: str) -> list[str]:
    """The word, or what the kernel looks at of a longer one: every run of PIECE - STEP letters is within a piece."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE + STEP, STEP)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, weight) of all gapped triples, in no order; each word's weights have length 1."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer((EDGE[0] + (EDGE[1] + EDGE[0]).join(words) + EDGE[1]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # letters from here to the word's end
    who, where, weight = [], [], []
    with np.errstate(over="ignore"):
        first, second, third = (flat * f for f in SPREAD)
        for a, b in GAPS:
            at = np.flatnonzero(left > a + b)
            h = first[at] + second[at + a] + third[at + a + b]
            who.append(owner[at])
            where.append(((h ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1)).astype(np.int32))
            weight.append(np.full(len(at), DISCOUNT ** (a + b - 2), np.float32))
    who, where, weight = np.concatenate(who), np.concatenate(where), np.concatenate(weight)
    norm = np.sqrt(np.bincount(who, weight * weight, minlength=len(words))).astype(np.float32)
    return who, where, weight / norm[who]


def landmark_table(landmarks: list[str]) -> np.ndarray:
    """[bucket, landmark] weights of the landmarks' triples."""
    table = np.zeros((BUCKETS, len(landmarks)), np.float32)
    who, where, weight = triples(landmarks)
    np.add.at(table, (where, who), weight)
    return table


def kernel(words: list[str], table: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): the words that are at all like a landmark, and their likenesses to each, to the power POWER."""
    if not words:
        return np.zeros(0, np.int64), np.zeros((0, table.shape[1]), np.float32)
    who, where, weight = triples(words)
    # no landmark can be more like the word than the sum of its triples' best
    hopeful = np.bincount(who, weight * ceiling[where], minlength=len(words)) >= FLOOR
    keep = np.flatnonzero(hopeful[who] & (ceiling > 0)[where])
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros((0, table.shape[1]), np.float32)
    keep = keep[np.argsort(who[keep], kind="stable")]
    who, where, weight = who[keep], where[keep], weight[keep]
    starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    out = np.empty((len(starts), table.shape[1]), np.float32)
    for i in range(0, len(starts), 2000):  # bounded memory
        a, b = starts[i], starts[i + 2000] if i + 2000 < len(starts) else len(who)
        out[i : i + 2000] = np.add.reduceat(table[where[a:b]] * weight[a:b, None].astype(np.float32), starts[i : i + 2000] - a, axis=0)
    out = np.minimum(out, 1)
    out[out < FLOOR] = 0
    some = out.any(axis=1)
    return who[starts][some], out[some] ** POWER


def pick_landmarks(docs: list[list[set[str]]]) -> list[str]:
    """Words by how much more often toxic than other documents hold them; docs: the others' word sets and the toxic ones'."""
    counts = [Counter(w for words in side for w in words) for side in docs]
    others, toxic = (max(1, len(side)) for side in docs)
    gain = {}
    for w, n in counts[1].items():
        if 3 <= len(w) <= LONGEST:
            p, q = (n + 0.1) / (toxic + 1), (counts[0][w] + 0.1) / (others + 1)
            if p > 4 * q and (n > 1 or toxic < 20):
                gain[w] = n * np.log(p / q)
    best = sorted(gain, key=lambda w: (-gain[w], w))[: 8 * LANDMARKS]
    if not best:
        return []
    # words much like a better one add little
    table = landmark_table(best)
    alike, chosen = table.T @ table > 0.8, []
    for i in range(len(best)):
        if len(chosen) < LANDMARKS and not alike[i, chosen].any():
            chosen.append(i)
    best = [best[i] for i in chosen]
    table = table[:, chosen]
    usual = [w for w, n in sorted(counts[0].items(), key=lambda x: (-x[1], x[0]))[:20_000] if len(w) >= 3 and w not in set(best) and n >= max(2, 0.002 * others)]
    at, near = kernel(usual, table, table.max(axis=1))
    order = np.argsort(-near.max(axis=1), kind="stable")[:HARMLESS] if len(at) else []
    return best + [usual[at[i]] for i in order]


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 500, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss; y is -1 or 1."""
    w, b = np.zeros(x.shape[1]), -1.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * weight
        g = np.append(-2 * (x.T @ (slack * y)) + decay * w, -2 * (slack * y).sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class Values(dict):
    """What words add to the machine's decision; a word not met before is not a number."""

    def __missing__(self, word):
        return math.nan


class Model:
    """What scoring needs: a value per word, the machine's bias, and the curve that turns a document's decisions into a probability."""

    #: Words whose values are kept, of up to LONGEST characters.
    MOST = 400_000

    def __init__(self, table, weights, bias, curve, prior):
        self.table, self.weights, self.bias, self.curve, self.prior = table, weights, bias, curve, prior
        self.ceiling = None if table is None else table.max(axis=1)
        self.values, self.units = Values(), Values()

    def plain(self) -> tuple:
        """All that a task needs to make the model again."""
        return self.table, self.weights, self.bias, self.curve, self.prior

    def valued(self, words: list[str]) -> dict[str, float]:
        """The values of units: of a long one, that of its piece with the highest."""
        out = dict.fromkeys(words, 0.0)
        owners, parts = [], []
        for w in words:
            if len(w) >= 3:
                cut = pieces(w)
                parts += cut
                owners += [w] * len(cut)
        for i in range(0, len(parts), 10_000):
            at, near = kernel(parts[i : i + 10_000], self.table, self.ceiling)
            for j, value in zip(at.tolist(), (near @ self.weights).tolist(), strict=True):
                w = owners[i + j]
                out[w] = value if len(w) <= LONGEST else max(out[w], value)
        return out

    def learn(self, words: set[str]) -> dict[str, float]:
        """The values of words not met before; keeps those of short ones, and forgets all when there are very many."""
        if len(self.values) > self.MOST:
            self.values.clear()
            self.units.clear()
        plain = {w: unit(w) for w in words}
        new = self.valued([u for u in set(plain.values()) if u not in self.units])
        self.units.update({u: v for u, v in new.items() if len(u) <= LONGEST})
        found = {w: new[u] if u in new else self.units[u] for w, u in plain.items()}
        self.values.update({w: v for w, v in found.items() if len(w) <= LONGEST})
        return found

    def decisions(self, texts: list[list[str]]) -> np.ndarray:
        """A row for each text: the highest decision on a sentence, and the sum of those above zero, as it is and by the text's length."""
        found = [np.fromiter(map(self.values.__getitem__, w), float, len(w)) for w in texts]
        gaps = [np.flatnonzero(np.isnan(v)).tolist() for v in found]
        new = self.learn({w[j] for w, at in zip(texts, gaps, strict=True) for j in at})
        out = np.zeros((len(texts), JUDGED))
        out[:, 0] = self.bias
        for n, (w, v, at) in enumerate(zip(texts, found, gaps, strict=True)):
            if at:
                v[at] = [new[w[j]] for j in at]
            if v.any():
                by_sentence = np.add.reduceat(v, sentence_starts(w)) + self.bias
                total = float(np.maximum(by_sentence, 0).sum())
                out[n] = by_sentence.max(), np.log1p(total), np.log1p(200 * total / max(20, len(w)))
        return out

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.prior)
        z = self.decisions(texts) @ self.curve[:JUDGED] + self.curve[JUDGED]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_toxicity(rows: list[tuple[str, int, int]], counts: tuple[int, int]) -> Model:
    """rows: (text, toxic 0 or 1, part 0 or 1); counts: the labelled documents of each class, for the natural share.

    Part 0 trains the machine, part 1 the curve; where a part lacks a class, all rows train both. With one class only, every score is its share.
    """
    prior = (counts[1] + 0.5) / (sum(counts) + 1)
    if len({y for _, y, _ in rows}) < 2:
        return Model(None, None, 0.0, None, prior)
    split = [[r for r in rows if r[2] == p] for p in (0, 1)]
    if any(sum(y == c for _, y, _ in part) < 4 for part in split for c in (0, 1)):
        split = [rows, rows]
    documents = [(units(t), y) for t, y, _ in split[0]]
    sets = [[set(map(unit, w)) for w, y in documents if y == c] for c in (0, 1)]
    landmarks = pick_landmarks(sets)
    if not landmarks:
        return Model(None, None, 0.0, None, prior)
    table = landmark_table(landmarks)
    ceiling = table.max(axis=1)
    # whitening: likenesses among the landmarks to the power -1/2
    gram = np.minimum(table.T @ table, 1).astype(float)
    gram[gram < FLOOR] = 0
    values, vectors = np.linalg.eigh(gram**POWER)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    known: dict[str, np.ndarray] = {}
    vocabulary = [w for w in sorted(set().union(*sets[0], *sets[1])) if 3 <= len(w) <= LONGEST]
    for i in range(0, len(vocabulary), 20_000):
        at, near = kernel(vocabulary[i : i + 20_000], table, ceiling)
        known.update({vocabulary[i + j]: near[n] for n, j in enumerate(at.tolist())})
    x, y = [], []
    for tokens, label in documents:
        starts = sentence_starts(tokens)
        for begin, end in zip(starts, [*starts[1:], None], strict=False):
            hit = [known[u] for u in map(unit, tokens[begin:end]) if u in known]
            if hit:
                x.append(np.sum(hit, axis=0))
                y.append(2 * label - 1)
    # sentences without likeness to any landmark tell toxic from harmless nothing, but hold the machine's zero at harmless
    x.append(np.zeros(len(landmarks)))
    y.append(-1)
    x, y = np.array(x, float) @ whiten, np.array(y, float)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = fit_machine(x, y, weight)
    model = Model(table, (whiten @ w).astype(np.float32), b, np.zeros(JUDGED + 1), prior)
    z = model.decisions([units(t) for t, _, _ in split[1]])
    label = np.array([y for _, y, _ in split[1]], float)
    # rows stand for as many as their class has
    share = np.where(label > 0, counts[1] / max(1, label.sum()), counts[0] / max(1, (1 - label).sum()))
    share /= share.sum()
    curve, m, v = (np.zeros(JUDGED + 1) for _ in range(3))
    z1 = np.c_[z, np.ones(len(z))]
    for t in range(1, 3001):
        g = z1.T @ (share * (1 / (1 + np.exp(-np.clip(z1 @ curve, -50, 50))) - label)) + 1e-4 * curve * ([1] * JUDGED + [0])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        curve = curve - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    model.curve = curve
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, others: int = OTHERS, characters: int = CHARACTERS, predict_from: float = 0.3) -> DataFrame:
    """Returns (doc_id, held_out, score, predicted) for every row of docs (doc_id, text), from labels (doc_id, toxic).

    Labels of rows whose crc32(doc_id as text) mod 4 is 2 are never read for learning. Of the others, at most `toxic` toxic and
    `others` other documents, chosen by a hash of doc_id, train the model on the driver, and of these, in that order, as many as have `characters` characters together;
    null labels are no labels, of several labels of a document the highest counts, and of several texts of a labelled doc_id a shortest. A null or empty text has no toxic words and gets the score of such texts; a null doc_id counts as empty text. Other columns are ignored; repeated rows are scored
    alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    fold = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == 2
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(~fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    # ids of a bounded sample: at most `toxic` + `others` rows, which bounds what is broadcast
    picked = known.filter("toxic = 1").orderBy(order, "doc_id").limit(toxic).union(known.filter("toxic = 0").orderBy(order, "doc_id").limit(others))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(picked), "doc_id")
    # how long their texts are, a row per document: toxic and others in turn, so that both have room
    sizes_of = chosen.groupBy("doc_id", "toxic").agg(F.min(F.length("text")).alias("n")).withColumn("turn", F.row_number().over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")))
    until = F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("turn", "toxic").rowsBetween(W.unboundedPreceding, 0))
    fitting = sizes_of.withColumn("until", until).filter(F.col("until") <= characters).select("doc_id", "toxic", "n")
    sample = (
        texts.join(F.broadcast(fitting), "doc_id").filter(F.length("text") == F.col("n")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .orderBy("doc_id").select("text", "toxic", F.pmod(F.shiftright(order, 20), F.lit(2)).cast("int").alias("part")).toArrow()
    )
    rows = list(zip(*(sample.column(c).to_pylist() for c in ("text", "toxic", "part")), strict=True))
    # arrays alone travel, so executors need no copy of this module to read them
    model = spark.sparkContext.broadcast(fit_toxicity(rows, (sizes.get(0, 0), sizes.get(1, 0))).plain())
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one model at a time, with the words it has met in this worker's tasks so far
        kept = per_worker("toxicity", dict)
        if kept.get("name") != name:
            kept.update(name=name, model=Model(*model.value))
        own = kept["model"]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                score = own.scores([units(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= predict_from).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return texts.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
