"""Language-model scoring: hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history).

* **Counts** of all training tokens (words and one end per text) are a partial aggregate.
* **Classes**: words of relative frequency ``EXPLICIT`` or more (at most 1 / EXPLICIT of them) are binned
  by frequency into ``BINS`` classes of about equal mass. All other words, seen or not, belong to one of
  ``RARE`` classes by a hash of their ending; within it, P(word | class) is the add-one estimate.
* **Features** of the history: the last word (bigram), the two last words (trigram) and the word
  before the last (skip), hashed into a table of ``ROWS`` x classes; a smaller table holds the
  weights of bigram and skip features for the words inside a class.
* **Training**: in each round every task runs AdaGrad over its partition's tokens, starting from the
  common weights; updated rows are averaged over tasks by their number of updates, summed in two
  shuffles whose rows are blocks of the tables. The model's size is a parameter.
* **Scoring** runs over Arrow batches in numpy: only active feature rows are read. Counts of frequent
  words (at most 1 / HEAD) are broadcast; the others are joined: per text the distinct tail words are
  joined with the count table by word, so that every count is exact.

Defined cases: null text is empty (one end token); an empty training set gives N = V = 0 and the
uniform base; texts of any length are scored whole; repeated rows are scored alike.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import LOWER_ASCII, crc_mod, stage

EXPLICIT = 2e-4
HEAD = 1e-6
BINS = 16
RARE = 32
ROWS = 1 << 13
WORD_ROWS = 1 << 10
BLOCK = 64
ROUNDS = 1
BATCH = 16384
RATE = 0.4
HELD = 400_000
END = b""
#: Weights stay within this bound, so that sums of a history's weights cannot overflow.
LARGEST = 15.0
LN10 = math.log(10)


def tokens(text: str | None) -> list[bytes]:
    """Words of the text (UTF-8) with A-Z lower-cased, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    words.append(END)
    return words


def rare_class(word: bytes) -> int:
    """Class of a word by its last letters."""
    stem = word.rstrip(b".,;:!?\"')]}*%$#&|")
    return zlib.crc32((stem or word)[-3:]) % RARE


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, n) of a one-column table of texts; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    return stage(texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


class Vocabulary:
    """Frequent words: counts, classes and places in their class. Bounded by 1 / HEAD entries."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, kinds: int, rare: dict[int, tuple[int, int]]):
        self.total, self.kinds = total, kinds
        self.words = {w: i for i, (w, _) in enumerate(head)}
        n = np.array([c for _, c in head], np.float64)
        explicit = [i for i, (w, c) in enumerate(head) if c >= EXPLICIT * total]
        self.explicit = len(explicit)
        self.cls = np.array([BINS + rare_class(w) for w, _ in head], np.int64)
        self.place = np.full(len(head), -1, np.int64)
        self.context = RARE_BASE + self.cls
        mass = n[explicit].sum() or 1.0
        done = 0.0
        self.sizes = np.zeros(BINS, np.int64)
        for rank, i in enumerate(explicit):  # most frequent first
            c = min(BINS - 1, int(BINS * done / mass))
            self.cls[i], self.place[i], self.context[i] = c, self.sizes[c], rank
            self.sizes[c] += 1
            done += n[i]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.log_n = np.log10(n + 1)
        # class priors, and add-one denominators of the rare classes
        self.denominator = np.zeros(RARE)
        prior = np.zeros(BINS + RARE)
        for k, (tokens_in, kinds_in) in rare.items():
            self.denominator[k] = tokens_in + kinds_in
            prior[BINS + k] = tokens_in
        self.word_prior = np.zeros(int(self.starts[-1]), np.float32)
        for i in explicit:
            c = self.cls[i]
            if self.place[i] >= 0:
                prior[c] += n[i]
                self.word_prior[self.starts[c] + self.place[i]] = math.log((n[i] + 1) / total)
                # explicit words are not in the rare counts
        self.denominator += 1
        self.prior = np.log((prior + 0.5) / (prior + 0.5).sum()).astype(np.float32)

    def encode(self, texts: list[str | None]) -> dict:
        """Flat token arrays of several texts; tail words get index -1."""
        words = self.words
        lists = [tokens(t) for t in texts]
        flat = [w for x in lists for w in x]
        index = np.array([words.get(w, -1) for w in flat], np.int64)
        tail = np.flatnonzero(index < 0)
        cls, place, context = (np.zeros(len(flat), np.int64) for _ in range(3))
        seen = index >= 0
        for to, table in ((cls, self.cls), (place, self.place), (context, self.context)):
            to[seen] = table[index[seen]]
        known: dict[bytes, int] = {}
        for i in tail.tolist():
            w = flat[i]
            k = known.get(w)
            if k is None:
                k = known[w] = rare_class(w)
            cls[i] = BINS + k
        place[tail] = -1
        context[tail] = RARE_BASE + cls[tail]
        lengths = np.array([len(x) for x in lists], np.int64)
        first = np.zeros(len(flat), bool)
        first[np.cumsum(lengths) - lengths] = True
        last = np.empty_like(context)
        last[1:], last[:1] = context[:-1], START
        last[first] = START
        before = np.empty_like(context)
        before[1:], before[:1] = last[:-1], START
        before[first] = START
        return {"flat": flat, "index": index, "tail": tail, "cls": cls, "place": place, "lengths": lengths, "features": features(last, before)}


#: Context numbers: explicit words by rank, rare classes above them, and the start of a text.
RARE_BASE = 1 << 20
START = (1 << 21) - 1


def features(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashed rows of the bigram, skip and trigram features, one line each."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    a, b = last.astype(np.uint64), before.astype(np.uint64)
    keys = np.stack([a * np.uint64(4) + np.uint64(1), b * np.uint64(4) + np.uint64(2), (a << np.uint64(24) ^ b) * np.uint64(4) + np.uint64(3)])
    keys *= mix
    keys ^= keys >> np.uint64(29)
    keys *= mix
    return (keys >> np.uint64(64 - 13)).astype(np.int64)


class Weights:
    """Class table and word table, with AdaGrad state while training."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray | None = None, words: np.ndarray | None = None):
        self.v = vocabulary
        shape = (WORD_ROWS, int(vocabulary.starts[-1]))
        self.tables = [np.zeros((ROWS, BINS + RARE), np.float32) if classes is None else classes.copy(), np.zeros(shape, np.float32) if words is None else words.copy()]
        self.updates = [np.zeros(ROWS, np.float32), np.zeros(WORD_ROWS, np.float32)]
        self.squares = [np.full(ROWS, 1e-2, np.float32), np.full(WORD_ROWS, 1e-2, np.float32)]

    @staticmethod
    def _softmax(z: np.ndarray, target: np.ndarray, learn: bool) -> np.ndarray:
        """Log probability of the targets; with ``learn``, ``z`` becomes the gradient of the loss."""
        every = np.arange(len(z))
        chosen = z[every, target]
        np.exp(z, out=z)
        total = z.sum(axis=1)
        if learn:
            z *= (1 / total)[:, None]
            z[every, target] -= 1
        return chosen - np.log(total)

    def _step(self, which: int, rows: np.ndarray, gradient: np.ndarray, cols: slice = slice(None)) -> None:
        """AdaGrad on the touched rows, with the gradients of a row summed first."""
        order = np.argsort(rows, kind="stable")
        ranked = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sums = np.add.reduceat(np.take(gradient, order, axis=0), starts, axis=0)
        at = ranked[starts]
        table = self.tables[which]
        self.squares[which][at] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        self.updates[which][at] += np.diff(np.append(starts, len(rows)))
        sums *= (RATE / np.sqrt(self.squares[which][at]))[:, None]
        table[at, cols] = np.clip(table[at, cols] - sums, -LARGEST, LARGEST)

    def run(self, cls: np.ndarray, place: np.ndarray, rows: np.ndarray, learn: bool = False) -> np.ndarray:
        """Natural log probability of the class and, for explicit words, of the word in it."""
        v, out = self.v, np.zeros(len(cls))
        for at in range(0, len(cls), BATCH):
            c, p, f = cls[at:at + BATCH], place[at:at + BATCH], rows[:, at:at + BATCH]
            z = np.take(self.tables[0], f[0], axis=0)
            z += np.take(self.tables[0], f[1], axis=0)
            z += np.take(self.tables[0], f[2], axis=0)
            z += v.prior
            out[at:at + BATCH] = self._softmax(z, c, learn)
            if learn:
                for line in f:
                    self._step(0, line, z)
            word_rows = f[:2] & (WORD_ROWS - 1)
            order = np.argsort(c, kind="stable")
            ends = np.searchsorted(c[order], np.arange(BINS + 1))
            for k in range(BINS):
                own = order[ends[k]:ends[k + 1]]
                if not len(own) or v.sizes[k] < 2:
                    continue
                cols = slice(int(v.starts[k]), int(v.starts[k + 1]))
                z = self.tables[1][word_rows[0, own], cols] + self.tables[1][word_rows[1, own], cols]
                z += v.word_prior[cols]
                out[at + own] += self._softmax(z, p[own], learn)
                if learn:
                    for line in word_rows:
                        self._step(1, line[own], z, cols)
        return out


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = sums.n or 0, sums.v
    head = counts.filter(F.col("n") >= HEAD * total).orderBy(F.desc("n"), "word").collect() if total else []

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = rare_class(w)
                n[k] += c
                v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(RARE), pa.int32()), pa.array(n), pa.array(v)], ["k", "n", "v"])

    rare = counts.filter(F.col("n") < EXPLICIT * total).mapInArrow(classes, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect() if total else []
    return Vocabulary([(bytes(r.word), r.n) for r in head], total, kinds, {r.k: (r.n, r.v) for r in rare})


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add up the payloads of equal keys, streaming: a task holds one sum per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for t, b, s, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = np.frombuffer(payload, np.float32)
                key = (t, b, s if "salt" in keys else 0)
                sums[key] = sums[key] + x if key in sums else x
        for (t, b, s), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([b], pa.int32()), pa.array([s], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["tab", "block", "salt", "payload"])

    return parts.repartition(*keys).mapInArrow(run, "tab int, block int, salt int, payload binary")


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Fit the weights by averaged AdaGrad over every partition of a one-column table of texts."""
    weights = Weights(vocabulary)
    sc = texts.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast((vocabulary, *weights.tables))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Weights(*shared.value)
            lines = 0
            for batch in batches:
                column = batch.column(0)
                for at in range(0, len(column), 64):
                    x = own.v.encode(column.slice(at, 64).to_pylist())
                    own.run(x["cls"], x["place"], x["features"], learn=True)
                    lines += 1
            salt = zlib.crc32(str(lines).encode()) % 16
            for t, (table, n) in enumerate(zip(own.tables, own.updates)):
                for b in range(0, len(table), BLOCK):
                    if n[b:b + BLOCK].any():
                        payload = np.concatenate([n[b:b + BLOCK], (n[b:b + BLOCK, None] * table[b:b + BLOCK]).ravel()]).astype(np.float32)
                        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([b], pa.int32()), pa.array([salt], pa.int32()), pa.array([payload.tobytes()], pa.binary())], ["tab", "block", "salt", "payload"])

        parts = texts.mapInArrow(run, "tab int, block int, salt int, payload binary")
        for r in _summed(_summed(parts, ["tab", "block", "salt"]), ["tab", "block"]).collect():  # the size of the tables
            x = np.frombuffer(r.payload, np.float32)
            n, sums = x[:BLOCK], x[BLOCK:].reshape(BLOCK, -1)
            at = np.flatnonzero(n)
            weights.tables[r.tab][r.block + at] = sums[at] / n[at, None]
    return weights


def score(docs: DataFrame, counts: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of (doc_id, held_out, text) rows."""
    v = weights.v
    shared = docs.sparkSession.sparkContext.broadcast((v, *weights.tables))
    schema = "doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, logp double, words array<binary>, tf array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(*shared.value)
        v = own.v
        log_denominator = np.log10(v.denominator)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                rows = whole.slice(at, 64)
                x = v.encode(rows.column(2).to_pylist())
                logp = own.run(x["cls"], x["place"], x["features"]) / LN10
                head = x["index"] >= 0
                log_n = np.zeros(len(head))
                log_n[head] = v.log_n[x["index"][head]]
                rare = x["place"] < 0
                logp[rare] += log_n[rare] - log_denominator[x["cls"][rare] - BINS]
                ends = np.cumsum(x["lengths"])
                starts = ends - x["lengths"]
                cuts = np.searchsorted(x["tail"], ends).tolist()
                tails, last = [], 0
                for cut in cuts:
                    tails.append(Counter(x["flat"][i] for i in x["tail"][last:cut].tolist()))
                    last = cut
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1), pa.array(x["lengths"]), pa.array(np.add.reduceat(head.astype(np.int64), starts)),
                        pa.array(np.add.reduceat(log_n, starts)), pa.array(np.add.reduceat(logp, starts)),
                        pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "held_out", "n_tokens", "head_known", "head_log", "logp", "words", "tf"],
                )

    scored = stage(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "lm-scored")
    tail = scored.select("rid", F.explode(F.arrays_zip("words", "tf")).alias("t")).select("rid", "t.words", "t.tf")
    found = tail.join(counts, F.col("words") == F.col("word"))
    sums = found.groupBy("rid").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("tail_log"))
    out = scored.drop("words", "tf").join(sums, "rid", "left")
    known, tail_log = F.coalesce("tail_known", F.lit(0)), F.coalesce("tail_log", F.lit(0.0))
    base = F.col("head_log") + tail_log - F.col("n_tokens") * F.lit(math.log10(v.total + v.kinds + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + known).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("logp") + tail_log).alias("score"),
    )


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of every row of documents; learned from six sevenths of the ids."""
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    texts = rows.filter("not held_out").select("text")
    counts = count_tokens(texts)
    return score(rows, counts, train(texts, build_vocabulary(counts), rounds))
