"""Language-model scoring with a log-bilinear neural model.

The corpus gives exact counts of all training words (a distributed count, its size follows the input). The
model's classes are the TOP most frequent words, BUCKETS groups of all other words by their last two bytes,
and the end of a text. From embeddings r of the two classes before, a class w has the score
    s(w) = q_w . (C1 r_1 + C2 r_2) + b_w,
trained in numpy by noise-contrastive estimation on all training texts: biases and noise are of the exact counts,
and in each of EPOCHS rounds every partition trains from the same weights on its share of the round's texts, and
the weights are averaged by tokens. A round takes a window of the rows by hash, a sixth of them or more where
EPOCH_TOKENS needs more, and the windows of all rounds hold every row; so training grows with the input, and null
or repeated texts enter at their share. What stays fixed is the size of the model. Scores are then normalised exactly: the sums over all classes for every pair of classes before are one product of two
matrices, as exp(s) factors. A word in a bucket further has its smoothed share (c + 0.1) / (N_b + 0.1 (V_b + 1))
of the bucket, so the model is a normalised distribution over all words, unseen ones included.

Counts of frequent words (HOT, a fixed bound) go to the executors; all others are joined by word, so
nothing that is broadcast grows with the corpus.

Defined cases: a null or empty text has the end alone; repeated rows are scored (and counted) each; without
training texts both scores use N = V = 0; words of equal count are ranked by their bytes; an empty table gives no rows;
columns of the input named like an added one (n_tokens, n_known, base_score, score) come back as name_in; texts of any
length are scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.llm.common import Hidden, arrow_map, as_bytes, remainder, whole_text
from vernal.llm.known import Words, cut
from vernal.sources.scratch import written

TOP, BUCKETS, HOT = 1_791, 256, 200_000
DIM, NOISE, BATCH, EPOCHS, RATE = 32, 128, 2048, 6, 0.05
#: Tokens of a round at least, where there are so many; more where a sixth of all are more.
EPOCH_TOKENS = 600_000
#: Tokens that a task holds at a time, and that a task of a round has at least where partitions are small.
HELD, TASK_TOKENS = 1_000_000, 100_000
ALPHA = 0.1
_FLUSH = 300_000
_PIECE = 1 << 20


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts of _PIECE bytes or a little more at a time; a longer one is whole."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= _PIECE or i + 1 == len(texts):
            yield texts[at : i + 1]
            at, held = i + 1, 0


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all texts: counted in each task first, then summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words, counts = Words(), [], np.zeros(0, np.int64)

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], names=["word", "c"])

        for b in batches:
            for part in pieces(as_bytes(b.column(0))):
                raw = b" ".join(part).lower()
                at, size = cut(raw)
                number, new = known.numbers(raw, at, size)
                words += [raw[i:j] for i, j in zip(at[new].tolist(), (at[new] + size[new]).tolist(), strict=True)]
                more = np.bincount(number, minlength=len(known))
                more[: len(counts)] += counts
                counts = more
                if len(known) >= _FLUSH:
                    yield given()
                    known, words, counts = Words(), [], np.zeros(0, np.int64)
        if words:
            yield given()

    return arrow_map(docs.select(whole_text(text).alias("text")), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


@dataclass
class Model:
    """Classes: 0 to top-1 words, then buckets, then the end; one more before a text's beginning."""

    first: np.ndarray  # [before, w]: q_w . C1 r + b_w
    second: np.ndarray  # [second before, w]: q_w . C2 r
    log_sum: np.ndarray  # [before, second before]: log of the sum over all classes

    def log10(self, w: np.ndarray, before: np.ndarray, second: np.ndarray) -> np.ndarray:
        k, n = self.first.shape[1], self.log_sum.shape[1]
        s = self.first.ravel().take(before * k + w) + self.second.ravel().take(second * k + w) - self.log_sum.ravel().take(before * n + second)
        return s.astype(np.float64) / math.log(10)


def normalised(first: np.ndarray, second: np.ndarray) -> Model:
    """All sums over classes as one matrix product, some rows at a time."""
    first, second = first.astype(np.float32, copy=False), second.astype(np.float32, copy=False)
    top = second.max(axis=1, keepdims=True)
    right = np.exp(second - top).T
    log_sum = np.empty((len(first), len(second)), np.float32)
    for at in range(0, len(first), 256):
        a = first[at : at + 256]
        most = a.max(axis=1, keepdims=True)
        log_sum[at : at + 256] = np.log(np.maximum(np.exp(a - most) @ right, 1e-37)) + most + top.T
    return Model(first, second, log_sum)


@dataclass
class Weights:
    """What is trained: r, q, b, c1, c2, and the sums of squares of their gradients."""

    params: list[np.ndarray]
    squares: list[np.ndarray]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.params, *self.squares)])

    def like(self, flat: np.ndarray) -> Weights:
        """Weights of these shapes from one array."""
        shapes = [x.shape for x in (*self.params, *self.squares)]
        parts = np.split(flat.astype(np.float32), np.cumsum([math.prod(x) for x in shapes])[:-1])
        parts = [p.reshape(x).copy() for p, x in zip(parts, shapes, strict=True)]
        return Weights(parts[:5], parts[5:])

    def model(self) -> Model:
        r, q, b, c1, c2 = self.params
        return normalised((r @ c1) @ q.T + b, (r @ c2) @ q.T)


def noise_law(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.5) / (counts.sum() + 0.5 * len(counts))


def begun(counts: np.ndarray, seed: int = 1) -> Weights:
    """Weights before training, from the counts of the classes."""
    classes = len(counts)
    r = np.random.default_rng(seed).normal(0, 0.1, (classes + 1, DIM)).astype(np.float32)
    params = [r, np.zeros((classes, DIM), np.float32), np.log(noise_law(counts)).astype(np.float32), np.eye(DIM, dtype=np.float32), np.eye(DIM, dtype=np.float32)]
    return Weights(params, [np.full_like(p, 1e-4) for p in params])


def rate_of(epoch: int) -> float:
    return RATE * (1 - 0.8 * epoch / EPOCHS)


def trained(weights: Weights, texts: list[np.ndarray], counts: np.ndarray, rate: float, rng: np.random.Generator) -> int:
    """Trains the weights in place, once over the texts; the number of tokens."""
    start = classes = len(counts)
    w, one, two = [], [], []
    for t in texts:
        x = np.full(len(t) + 2, start, dtype=np.int32)
        x[2:] = t
        w.append(x[2:])
        one.append(x[1:-1])
        two.append(x[:-2])
    if not w:
        return 0
    met = np.stack([np.concatenate(w), np.concatenate(one), np.concatenate(two)], axis=1)
    noise = noise_law(counts)
    cut = np.cumsum(noise)
    log_noise = np.log(NOISE * noise).astype(np.float32)
    r, q, b, c1, c2 = weights.params

    def step(p: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
        s += g * g
        g *= rate
        g /= np.sqrt(s)
        p -= g

    order = rng.permutation(len(met))
    for at in range(0, len(order), BATCH):
        x, y1, y2 = met.take(order[at : at + BATCH], axis=0).T.astype(np.int64)
        h = (r @ c1).take(y1, axis=0)
        h += (r @ c2).take(y2, axis=0)
        # the noise is shared by the batch; a class that is drawn some times is computed once
        times = np.bincount(np.minimum(np.searchsorted(cut, rng.random(NOISE)), classes - 1), minlength=classes)
        z = np.flatnonzero(times)
        q_x, q_z = q.take(x, axis=0), q.take(z, axis=0)
        true = np.einsum("ij,ij->i", h, q_x) + (b - log_noise).take(x)
        g_true = (1 / (1 + np.exp(-true)) - 1) / len(x)
        g_false = h @ -q_z.T  # times / (1 + exp(-score)) / len(x), in place
        g_false -= (b - log_noise).take(z)
        np.exp(g_false, out=g_false)
        g_false += 1
        g_false *= (len(x) / times[z]).astype(np.float32)
        np.reciprocal(g_false, out=g_false)
        q_x *= g_true[:, None]
        g_h = g_false @ q_z
        g_h += q_x
        g_q, g_b = np.zeros_like(q), np.bincount(x, weights=g_true, minlength=classes).astype(np.float32)
        _add_rows(g_q, x, h * g_true[:, None])
        g_q[z] += g_false.T @ h
        g_b[z] += g_false.sum(axis=0)
        # sums by class first: what follows is then by class, not by token
        g_1, g_2 = np.zeros_like(r), np.zeros_like(r)
        _add_rows(g_1, y1, g_h)
        _add_rows(g_2, y2, g_h)
        g_r = g_1 @ c1.T
        g_r += g_2 @ c2.T
        for p, s, g in zip(weights.params, weights.squares, (g_r, g_q, g_b, r.T @ g_1, r.T @ g_2), strict=True):
            step(p, s, g)
    return len(met)


def train(texts: list[np.ndarray], classes: int, seed: int = 1) -> Model:
    """The model of texts that are here; texts: classes of the words and the end (the last class)."""
    counts = np.bincount(np.concatenate(texts), minlength=classes) if texts else np.zeros(classes)
    weights, rng = begun(counts, seed), np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        trained(weights, texts, counts, rate_of(epoch), rng)
    return weights.model()


def window(docs: DataFrame, epoch: int, n: int) -> DataFrame:
    """The rows of a round, of n tokens in all. Hashes are of the whole row, so that null or repeated texts are dealt like others."""
    share = min(1.0, max(1 / EPOCHS, EPOCH_TOKENS / max(n, 1)))
    size = 1 << 30
    first, width = size * epoch // EPOCHS, math.ceil(size * share)
    return docs.where(F.pmod(F.pmod(F.xxhash64(*docs.columns), F.lit(size)) - first, F.lit(size)) < width)


def train_all(docs: DataFrame, scorer: Scorer, counts: np.ndarray, text: str = "text") -> Model:
    """The model of all texts: rounds of training in the partitions, averaged."""
    weights, n, sc = begun(counts), int(counts.sum()), docs.sparkSession.sparkContext
    if not n:
        return weights.model()
    shared = sc.broadcast(scorer)
    rows = docs.withColumn(text, whole_text(text))
    share = min(1.0, max(1 / EPOCHS, EPOCH_TOKENS / n))
    tasks = max(1, int(n * share / TASK_TOKENS))  # coalesce() never makes more than there are
    for epoch in range(EPOCHS):
        now = sc.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch, now=now) -> Iterator[pa.RecordBatch]:
            s, own = shared.value, now.value.like(now.value.flat())
            rng = np.random.default_rng((epoch, TaskContext.get().partitionId()))
            end, done, held, texts = len(counts) - 1, 0, 0, []
            for b in batches:
                for part in pieces(as_bytes(b.column(0))):
                    p = s.placed(part)
                    x = p.with_ends(end).astype(np.int32)
                    for t in np.split(x, p.ends[:-1] + np.arange(1, len(part))):
                        texts.append(t)
                        held += len(t)
                        if held >= HELD:
                            done += trained(own, texts, counts, rate_of(epoch), rng)
                            held, texts = 0, []
            done += trained(own, texts, counts, rate_of(epoch), rng)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([own.flat().tobytes()], pa.binary())], names=["n", "weights"])

        total, tokens = np.zeros(len(weights.flat())), 0
        for r in written(arrow_map(window(rows, epoch, n).select(text).coalesce(tasks), run, "n long, weights binary"), "weights").toLocalIterator():
            total += r["n"] * np.frombuffer(r["weights"], dtype=np.float32)
            tokens += r["n"]
        weights = weights.like(total / tokens) if tokens else weights
        now.unpersist()
    return weights.model()


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at] += rows, with repeats summed; two numbers at a time, as one complex one."""
    half = out.shape[1] // 2
    np.add.at(out.view(np.complex64).reshape(-1), (at[:, None] * half + np.arange(half)).ravel(), np.ascontiguousarray(rows, np.float32).view(np.complex64).ravel())


@cache
def _buckets() -> np.ndarray:
    """The bucket of a word by its last two bytes, and (last 256) by its only one."""
    return np.array([bucket(bytes((i >> 8, i & 255))) for i in range(1 << 16)] + [bucket(bytes((i,))) for i in range(256)], np.int16)


@dataclass
class Placed:
    """The words of some texts: raw[at : at + size]; those of text i are begin[i] to ends[i]."""

    raw: bytes
    at: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    ends: np.ndarray
    k: np.ndarray  # place among the frequent words (-1: not frequent)
    c: np.ndarray  # class

    def word(self, i: int) -> bytes:
        return self.raw[self.at[i] : self.at[i] + self.size[i]]

    def with_ends(self, end: int) -> np.ndarray:
        """Classes, and the end after each text."""
        out = np.full(len(self.c) + len(self.ends), end, dtype=np.int64)
        inner = np.ones(len(out), dtype=bool)
        inner[self.ends + np.arange(len(self.ends))] = False
        out[inner] = self.c
        return out


@dataclass
class Scorer:
    """What executors need: the model and the frequent words."""

    model: Model
    words: bytes  # frequent words by count downwards, spaces between
    hot_class: np.ndarray
    hot_base: np.ndarray  # log10 of the base probability
    hot_share: np.ndarray  # log10 of the share of its bucket (0: a class of its own)
    top: int
    end_base: float
    log_tokens: float  # log10(N + 0.1 (V + 1))
    log_bucket: np.ndarray  # the same of each bucket
    known_end: int

    @cached_property
    def hot(self) -> tuple[Words, np.ndarray]:
        """The frequent words, and the place of each by its number (the last, -1, of those without)."""
        known, (at, size) = Words(), cut(self.words)
        place = np.full(len(at) + 1, -1, np.int32)
        place[known.numbers(self.words, at, size)[0]] = np.arange(len(at))
        return known, place

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "hot"}  # each worker makes it once

    def placed(self, texts: list[bytes]) -> Placed:
        """All words of the texts, looked up."""
        raw = b" ".join(texts).lower()
        at, size = cut(raw)
        known, place = self.hot
        k = place.take(known.find(raw, at, size))
        c = self.hot_class.take(k) if len(self.hot_class) else np.zeros(len(k), np.int64)
        rare = np.flatnonzero(k < 0)
        letters, last = np.frombuffer(raw, np.uint8), at[rare] + size[rare] - 1
        final = letters.take(last).astype(np.int64)
        c[rare] = self.top + _buckets().take(np.where(size[rare] > 1, letters.take(last - 1, mode="wrap") * np.int64(256) + final, 65_536 + final))
        stop = np.cumsum([len(t) + 1 for t in texts])
        ends = np.searchsorted(at, stop)
        return Placed(raw, at, size, np.r_[0, ends[:-1]], ends, k, c)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """n_tokens, known frequent tokens, base and model score without the rare words' log10(c + 0.1), and the rare words."""
        p = self.placed(texts)
        begin, ends, k, c = p.begin, p.ends, p.k, p.c
        rare = k < 0
        base, share = np.full(len(k), -self.log_tokens), np.zeros(len(k))
        if len(self.hot_class):
            base[~rare], share[~rare] = self.hot_base[k[~rare]], self.hot_share[k[~rare]]
        share[rare] = -self.log_bucket[c[rare] - self.top]
        # classes with the end after each text, and the two before
        n = ends - begin
        size = n + 1
        x = p.with_ends(self.top + BUCKETS)
        last = np.cumsum(size) - 1
        start = self.top + BUCKETS + 1
        one, two = np.r_[start, x[:-1]], np.r_[start, start, x[:-2]]
        first = last - n
        one[first] = two[first] = start
        two[first[n > 0] + 1] = start
        per = self.model.log10(x, one, two)
        add = lambda v, b, e: (t := np.r_[0.0, np.cumsum(v)])[e] - t[b]
        model = add(per, first, last + 1) + add(share, begin, ends)
        known = add(~rare, begin, ends).astype(np.int64) + self.known_end
        met = np.flatnonzero(rare)
        edge = np.searchsorted(met, np.r_[0, ends]).tolist()
        met = [p.word(i) for i in met.tolist()]
        unknown = [met[a:b] for a, b in pairwise(edge)]
        return size, known, add(base, begin, ends) + self.end_base, model, unknown


def fit(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> tuple[Scorer, int]:
    """Model and frequent words from training texts and their (word, c); and the number of tokens N."""
    n_docs = docs.count()
    total = vocabulary.agg(F.sum("c"), F.count("*")).first()
    n, v = (total[0] or 0) + n_docs, total[1] + (n_docs > 0)
    rows = vocabulary.orderBy(F.col("c").desc(), "word").limit(HOT).toArrow()
    words, counts = rows.column("word").to_pylist(), rows.column("c").to_numpy().astype(np.float64)
    del rows
    top = min(TOP, len(words))
    # buckets: all words but the classes of their own
    by_bucket = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(BUCKETS))
    sizes = {r["k"]: (r["n"], r["v"]) for r in vocabulary.groupBy(by_bucket.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # BUCKETS rows
    in_n, in_v = (np.array([sizes.get(k, (0, 0))[j] for k in range(BUCKETS)], dtype=np.float64) for j in (0, 1))
    groups = np.array([bucket(w) for w in words], dtype=np.int64)
    np.subtract.at(in_n, groups[:top], counts[:top])
    np.subtract.at(in_v, groups[:top], 1)
    log_bucket = np.log10(in_n + ALPHA * (in_v + 1))
    log_tokens = math.log10(n + ALPHA * (v + 1))
    hot_class = np.where(np.arange(len(words)) < top, np.arange(len(words)), top + groups)
    share = np.where(np.arange(len(words)) < top, 0.0, np.log10(counts + ALPHA) - log_bucket[groups] if len(words) else 0.0)
    empty = Model(np.zeros((1, 1)), np.zeros((1, 1)), np.zeros((1, 1)))
    scorer = Scorer(empty, b" ".join(words), hot_class, np.log10(counts + ALPHA) - log_tokens, share, top, math.log10(n_docs + ALPHA) - log_tokens, log_tokens, log_bucket, int(n_docs > 0))
    del words
    scorer.model = train_all(docs, scorer, np.r_[counts[:top], in_n, n_docs], text)
    return scorer, n


def score(docs: DataFrame, scorer: Scorer, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """docs (without text) with n_tokens, n_known, base_score and score."""
    spark, h = docs.sparkSession, Hidden(docs)
    own = h.name(text)
    shared = spark.sparkContext.broadcast(scorer)  # HOT words and the model's matrices, both of fixed size
    keep = [c for c in h.df.columns if c != own]
    d = h.df.select(*keep, whole_text(own).alias("text"))
    schema = d.select(*keep).schema.add("uid", "long").add("n_tokens", "long").add("n_hot", "long").add("base_part", "double").add("model_part", "double")
    schema.add("rare", spark.createDataFrame([], "x array<binary>").schema["x"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = as_bytes(b.column(b.schema.get_field_index("text")))
            at = 0
            for part in pieces(texts):
                size, known, base, model, rare = s.score(part)
                n = len(part)
                kept = [b.column(b.schema.get_field_index(c)).slice(at, n) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.arange(uid, uid + n)), pa.array(size), pa.array(known), pa.array(base), pa.array(model), pa.array(rare, pa.list_(pa.binary()))], names=schema.names)
                uid, at = uid + n, at + n

    parts = written(arrow_map(d, run, schema), "scores")  # row numbers hold from here on
    words = parts.where("size(rare) > 0").select("uid", F.explode("rare").alias("word"))
    counted = words.join(vocabulary, "word", "left").groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("rare_part"), F.count("c").alias("n_rare"))
    zero = F.lit(0.0)
    out = parts.drop("rare").join(counted, "uid", "left")
    return h.shown(out, "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), (F.col("base_part") + F.coalesce("rare_part", zero)).alias("base_score"), (F.col("model_part") + F.coalesce("rare_part", zero)).alias("score"), without=(own,))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 10) == 0)
    training = docs.where("NOT held_out")
    vocabulary = written(word_counts(training), "vocabulary")
    scorer, n = fit(training, vocabulary)
    return score(docs, scorer, vocabulary).withColumn("train_tokens", F.lit(n).cast("long"))
