"""Language-model scores by subword lattices: the probability of a text is summed over all its segmentations.

Words are spelled with the pieces of an existing vocabulary (a sentencepiece model), the first with the word mark; a word's lattice has an edge for each
piece that fits and one for the bytes of each character, so that no text has probability 0. The probability of a word is the sum over all paths, found with a
forward recursion in log space; a text's is the product over its words and its end. A text is thus a run of pieces, drawn one by one from one distribution with the end in it.

The vocabulary's own scores are merge ranks, not probabilities: the pieces' probabilities are counts of its own segmentation of the training words, each as often as it
occurs, followed by rounds of expectation maximisation over their lattices. Word counts and expected piece counts come from all training rows, by shuffles.

Beside that score, word_score is that of a lattice in which every training word is an edge of its own: it has its training count less a discount, which is
estimated from how many words occur once and twice; the pieces share what is discounted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import row_key, stored, words

MARK = "▁"
LN10 = math.log(10)
#: Pieces seen this often less than never still have this count.
SMOOTH = 0.1
#: A word with more than 1 / HEAD of all training tokens is a head word; there can't be more than HEAD of them.
HEAD = 1_000_000
#: Words of equal length handled at a time.
GROUP = 4096
#: Bits of a code point, and a number that is none.
LETTER, NO_LETTER = 21, (1 << 21) - 1


class Pieces:
    """A sentencepiece vocabulary: ids of spellings and of bytes."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.model.get_piece_size()
        usual = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.ids = {self.model.id_to_piece(i): i for i in usual}
        self.bytes = {int(self.model.id_to_piece(i)[3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        for b in range(256):  # a vocabulary without byte pieces gets them
            self.bytes.setdefault(b, n + b)
        self.size = n + 256
        self.longest = max(map(len, self.ids))
        # beginnings of pieces, each by a number, from which a letter leads to the next, and the piece that a beginning is
        number = {"": 0}
        steps = {}
        for piece in self.ids:
            for j in range(1, len(piece) + 1):
                if piece[:j] not in number:
                    number[piece[:j]] = len(number)
                    steps[number[piece[: j - 1]] << LETTER | ord(piece[j - 1])] = number[piece[:j]]
        self.steps = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[x] for x in self.steps.tolist()], np.int64)
        self.at = np.array([self.ids.get(x, -1) for x in number], np.int64)
        self.known = sorted({*self.ids.values(), *self.bytes.values()})

    def log_probabilities(self, counts: dict[int, float], ends: float = 0.0) -> tuple[np.ndarray, float]:
        """Natural logs by id, with -inf at the last place for ids of -1, and that of the end, of which there were `ends`."""
        p = np.zeros(self.size + 1)
        p[self.known] = SMOOTH
        for i, c in counts.items():
            p[i] += c
        total = p.sum() + ends + SMOOTH
        with np.errstate(divide="ignore"):
            return np.log(p / total), math.log((ends + SMOOTH) / total)


def letters(group: list[str]) -> tuple[list[int], np.ndarray]:
    """Of words of one length: the code points in them, and for each word those of its characters by their number in that list."""
    codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(group), -1)
    known, which = np.unique(codes, return_inverse=True)
    return known.tolist(), which.reshape(codes.shape)


def lattices(group: list[str], pieces: Pieces, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length n (in characters): piece ids [words, n + 1, longest] or -1, log weights of these, of the byte spellings of each character
    [words, n + 1], and forward sums [words, n + 2]."""
    codes, which = letters(group)
    spelled = np.array(codes, np.int64)[which]
    # in a word it is no word mark: bytes alone spell it
    spelled = np.where(spelled == ord(MARK), NO_LETTER, spelled)
    spelled = np.concatenate([np.full((len(group), 1), ord(MARK)), spelled], axis=1)
    n = spelled.shape[1]
    width = min(pieces.longest, n)
    ids = np.full((len(group), n, width), -1)
    # from each place on, letter by letter, as long as some piece goes on so
    row, begin = (x.ravel() for x in np.indices((len(group), n)))
    state = np.zeros(len(row), np.int64)
    for k in range(width):
        key = state << LETTER | spelled[row, begin + k]
        at = np.minimum(np.searchsorted(pieces.steps, key), len(pieces.steps) - 1)
        on = np.flatnonzero(pieces.steps[at] == key)
        row, begin, state = row[on], begin[on], pieces.next[at[on]]
        ids[row, begin, k] = pieces.at[state]
        more = np.flatnonzero(begin + k + 1 < n)
        row, begin, state = row[more], begin[more], state[more]
    edge = logs[ids]
    raw = np.full((len(group), n), -np.inf)
    raw[:, 1:] = np.array([sum(logs[pieces.bytes[b]] for b in chr(c).encode("utf-8", "surrogatepass")) for c in codes], float)[which]
    alpha = np.full((len(group), n + 1), -np.inf)
    alpha[:, 0] = 0
    for j in range(1, n + 1):
        terms = [alpha[:, j - k] + edge[:, j - k, k - 1] for k in range(1, min(width, j) + 1)]
        terms.append(alpha[:, j - 1] + raw[:, j - 1])
        alpha[:, j] = np.logaddexp.reduce(terms, axis=0)
    return ids, edge, raw, alpha


def expected_counts(group: list[str], times: np.ndarray, pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """How often each piece is used in spelling the words, each as often as times says, over all segmentations by their probability."""
    ids, edge, raw, alpha = lattices(group, pieces, logs)
    rows, n, width = ids.shape
    beta = np.full((rows, n + 1), -np.inf)
    beta[:, n] = 0
    for i in range(n - 1, -1, -1):
        terms = [beta[:, i + k] + edge[:, i, k - 1] for k in range(1, min(width, n - i) + 1)]
        terms.append(beta[:, i + 1] + raw[:, i])
        beta[:, i] = np.logaddexp.reduce(terms, axis=0)
    out = np.zeros(pieces.size)
    total = alpha[:, n]
    # only where a piece fits
    at = np.flatnonzero(ids >= 0)
    row, cell = np.divmod(at, n * width)
    begin, more = np.divmod(cell, width)
    p = np.exp(alpha[row, begin] + edge.ravel()[at] + beta[row, begin + more + 1] - total[row]) * times[row]
    out += np.bincount(ids.ravel()[at], p, minlength=pieces.size)
    p = np.exp(alpha[:, 1:n] + raw[:, 1:] + beta[:, 2:] - total[:, None]) * times[:, None]
    codes, which = letters(group)
    for c, times_spelled in zip(codes, np.bincount(which.ravel(), np.where(p > 1e-9, p, 0.0).ravel(), minlength=len(codes)).tolist(), strict=True):
        for b in chr(c).encode("utf-8", "surrogatepass"):
            out[pieces.bytes[b]] += times_spelled
    return out


def by_length(raw: list[bytes]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places, words) of words of one length, a bounded number of characters at a time."""
    text = [w.decode("utf-8", "surrogatepass") for w in raw]
    sizes = np.array([len(t) for t in text])
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        step = max(1, min(GROUP, 40_000 // (n + 1)))
        for i in range(0, len(at), step):
            yield at[i : i + step], [text[j] for j in at[i : i + step]]


def word_counts(source: DataFrame) -> DataFrame:
    """(word binary, c) of all words of source (text, train); c counts those in training rows only and may be 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text, train in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
                w = words(text)
                if train:
                    seen.update(w)
                else:
                    for x in set(w):
                        seen.setdefault(x, 0)
                if len(seen) > 400_000:
                    yield told()
        if seen:
            yield told()

    return source.select("text", "train").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(counts: DataFrame, model_file: str, logs: np.ndarray | None) -> dict[int, float]:
    """Counts of pieces in the words of counts (word, c): of the vocabulary's own segmentation, or expected ones under logs. As many as pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_file)
        total = np.zeros(pieces.size)
        for batch in batches:
            raw, times = batch.column("word").to_pylist(), batch.column("c").to_numpy(zero_copy_only=False).astype(float)
            if logs is None:
                ids = pieces.model.encode([w.decode("utf-8", "surrogatepass") for w in raw], num_threads=1)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                total += np.bincount(np.fromiter(chain.from_iterable(ids), np.int64), np.repeat(times, sizes), minlength=pieces.size)
            else:
                for at, group in by_length(raw):
                    total += expected_counts(group, times[at], pieces, logs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["piece", "n"])

    rows = counts.select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}


def lattice_scores(docs: DataFrame, model_file: str, rounds: int = 2) -> DataFrame:
    """Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score for every row of docs (doc_id, text).

    Rows whose crc32(doc_id as text) mod 10 is 0 are held out of learning (a null doc_id counts as empty text). Tokens are the words, lower-cased A-Z and
    split at ASCII white space, and an end. score is the log10 probability of the text, summed over all segmentations into pieces; word_score that with training words as
    edges of their own; base_score that under the smoothed unigram frequencies of words. A null or empty text is the end alone. Without training rows the pieces and the end
    are equally likely. Repeated rows are rows of their own;
    other columns are ignored; an empty table gives no rows.

    Head words (at most HEAD, by their share of all tokens) are looked up in the tasks that read the texts; only
    the other words of a document are shuffled to meet their scores.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.crc32(name.cast("binary")) % 10 != 0).alias("train"))
    counts = stored(word_counts(source), "words")
    trained = source.filter("train").count()
    row = counts.agg(F.sum("c").alias("n"), *[F.count_if(F.col("c") > n if n == 0 else F.col("c") == n).alias(f"v{n}") for n in (0, 1, 2)]).first()
    tokens, kinds = (row["n"] or 0) + trained, row["v0"] + (trained > 0)
    discount = (row["v1"] + 0.5) / (row["v1"] + 2 * row["v2"] + 1)
    shared_part = math.log(discount * row["v0"] / tokens) if row["v0"] else 0.0
    logs, end_log = Pieces(model_file).log_probabilities({})
    if row["v0"]:
        for step in range(rounds + 1):
            logs, end_log = Pieces(model_file).log_probabilities(piece_counts(counts.filter("c > 0"), model_file, logs if step else None), trained)
    space = tokens + 0.1 * (kinds + 1)
    base = lambda c: np.log10((c + 0.1) / space)
    end_base, end_score, end_word = float(base(trained)), end_log / LN10, math.log10(trained / tokens) if trained else 0.0

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model_file)
        for batch in batches:
            raw, c = batch.column("word").to_pylist(), batch.column("c")
            out = np.zeros(len(raw))
            for at, group in by_length(raw):
                out[at] = lattices(group, own, logs)[3][:, -1]
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c.to_numpy(zero_copy_only=False) - discount, 0) / max(1, tokens))
            mixed = np.logaddexp(whole, out + shared_part) / LN10
            yield pa.RecordBatch.from_arrays([batch.column("word"), c, pa.array(base(c.to_numpy(zero_copy_only=False))), pa.array(out / LN10), pa.array(mixed)], names=["word", "c", "base", "score", "mixed"])

    scored = stored(counts.mapInArrow(score_words, "word binary, c long, base double, score double, mixed double"), "word-scores")
    least = max(1, math.ceil(tokens / HEAD))
    head = scored.filter(F.col("c") > least).toArrow()
    shared = spark.sparkContext.broadcast((head.column("word").to_pylist(), *(head.column(c).to_numpy() for c in ("base", "score", "mixed"))))

    class Places(dict):
        def __missing__(self, word):
            return -1

    def score_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, head_base, head_score, head_mixed = shared.value
        places = Places(zip(listed, range(len(listed)), strict=True))
        names = ["doc_id", "row", "held_out", "word", "n", "n_tokens", "n_known", "base_score", "score", "word_score"]
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sums, rest, times, owners = [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    w = words(text)
                    at = np.fromiter(map(places.__getitem__, w), np.int64, len(w))
                    tail = Counter([w[j] for j in np.flatnonzero(at < 0).tolist()])
                    at = at[at >= 0]
                    sums.append((len(w) + 1, len(at) + (trained > 0), head_base[at].sum() + end_base, head_score[at].sum() + end_score, head_mixed[at].sum() + end_word))
                    rest += tail.keys()
                    times += tail.values()
                    owners += [i] * len(tail)
                own, m = batch.num_rows, len(rest)
                which = pa.array(owners, pa.int64())
                pad = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(m, t)])  # noqa: E731, B023
                n_tokens, n_known, *scores = zip(*sums, strict=True)
                both = lambda c: pa.concat_arrays([batch.column(c), batch.column(c).take(which)])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [both("doc_id"), both("row"), both("held_out"), pa.concat_arrays([pa.nulls(own, pa.binary()), pa.array(rest, pa.binary())]), pa.concat_arrays([pa.array([1] * own, pa.int64()), pa.array(times, pa.int64())]), pad(n_tokens, pa.int64()), pad(n_known, pa.int64()), *(pad(x, pa.float64()) for x in scores)],
                    names=names,
                )

    parts = source.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), (~F.col("train")).alias("held_out"), "text").mapInArrow(
        score_texts, "doc_id long, row long, held_out boolean, word binary, n long, n_tokens long, n_known long, base_score double, score double, word_score double"
    )
    # read once from the shared folder, since the sums of the texts and their other words go different ways
    parts = stored(parts, "text-parts")
    tail = parts.filter("word is not null").select("doc_id", "row", "held_out", "word", "n").join(scored.filter(F.col("c") <= least), "word")
    tail = tail.select("doc_id", "row", "held_out", F.lit(0).alias("rows"), F.lit(0).alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * F.col("base")).alias("base_score"), (F.col("n") * F.col("score")).alias("score"), (F.col("n") * F.col("mixed")).alias("word_score"))
    whole = parts.filter("word is null").select("doc_id", "row", "held_out", F.lit(1).alias("rows"), "n_tokens", "n_known", "base_score", "score", "word_score")
    sums = whole.unionByName(tail).groupBy("doc_id", "row", "held_out").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base_score", "score", "word_score")])
    each = F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))
    return sums.select("doc_id", "held_out", each.alias("one"), (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_score") / F.col("rows")).alias("base_score"), *[(F.col(c) / F.col("rows")).alias(c) for c in ("score", "word_score")]).drop("one")
