"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings is trained in numpy from confirmed toxic texts (P) and
unlabelled ones (U). With class prior pi, the risk of the negative class is E_U - pi E_P; where that estimate
falls below zero it is held at zero and its gradient is reversed (the non-negative estimator), so that the
model can't explain unlabelled texts away. Label 0 enters the prior alone, never the risk.

A text's inputs are the shares that its features have among its words (times 100, at most CLIP), so that
short and long texts are alike. Defined cases: a null or empty text, or one without a letter, scores the
bias; repeated rows score alike; without a confirmed text, or without any unlabelled, every score is 0;
duplicate label rows of a document count as toxic if one is; features of equal z-score are taken in their order;
an empty table gives no rows; a column of the input called score comes back as score_in; texts of any length are
scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.llm.common import Hidden, appended, remainder, whole_text

#: Expected sizes of the samples that the classifier is fitted on, picked by hash, and bytes of each sample at most
#: (a text gives its first SAMPLE_CHARS to the fit; it is scored whole).
POSITIVES, UNLABELLED = 3_000, 6_000
SAMPLE_BYTES, SAMPLE_CHARS = 64 << 20, 1 << 16
FEATURES = 4_096
CLIP = 2.0
_WORDS = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings.
HEADS = (3, 4, 5, 6, 7)
_CACHE = 500_000


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:n] + "~" for n in HEADS if len(word) >= n)]


def shares(words: Counter, index: dict[str, int]) -> dict[int, float]:
    n = max(sum(words.values()), 1)
    out: dict[int, float] = {}
    for w, c in words.items():
        for f in features(w):
            if (i := index.get(f)) is not None:
                out[i] = out.get(i, 0.0) + 100.0 * c / n
    return {i: min(x, CLIP) for i, x in out.items()}


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from texts to scores; the features of known words are remembered."""
        known: dict[str, tuple[int, ...]] = {}

        def of(w: str) -> tuple[int, ...]:
            if (x := known.get(w)) is None:
                if len(known) >= _CACHE:
                    known.clear()
                x = known[w] = tuple(i for f in features(w) if (i := self.index.get(f)) is not None)
            return x

        def score(text: str) -> float:
            words = _WORDS.findall(text.lower())
            x = np.zeros(len(self.weights))
            hits = [i for t in map(of, words) if t for i in t]
            if hits:
                at, n = np.unique(hits, return_counts=True)
                x = np.minimum(100.0 * n / len(words), CLIP)
                return float(1 / (1 + np.exp(-(x @ self.weights[at] + self.bias))))
            return float(1 / (1 + np.exp(-self.bias)))

        return score


def _select(pos: list[Counter], unl: list[Counter]) -> dict[str, int]:
    """Features by the z-score of the difference of their document rates."""
    def rates(docs: list[Counter]) -> Counter:
        c: Counter = Counter()
        for d in docs:
            c.update({f for w in d for f in features(w)})
        return c

    p, u, n, m = rates(pos), rates(unl), len(pos), len(unl)
    scored = []
    for f, c in p.items():
        if c < 2:
            continue
        a, b = c / n, u.get(f, 0) / m
        scored.append((-(a - b) / np.sqrt((c + u.get(f, 0) + 1) / (n + m) * (1 / n + 1 / m)), f))
    return {f: i for i, (_, f) in enumerate(sorted(scored)[:FEATURES])}


def train(positive: list[str], unlabelled: list[str], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-3) -> Model | None:
    """Full-batch Adam on the non-negative risk with the logistic loss."""
    if not positive or not unlabelled:
        return None
    prior = min(max(prior, 1e-3), 0.999)
    pos, unl = ([Counter(_WORDS.findall(t.lower())) for t in x] for x in (positive, unlabelled))
    index = _select(pos, unl)
    rows, cols, values = [], [], []
    for r, d in enumerate([*pos, *unl]):
        for i, x in shares(d, index).items():
            rows.append(r)
            cols.append(i)
            values.append(x)
    rows, cols, values = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), np.array(values)
    n, m = len(pos), len(unl)
    w, b = np.zeros(len(index)), -2.0
    mean, square = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=values * w[cols], minlength=n + m) + b
        s = sigmoid(z)
        loss_neg = np.logaddexp(0, z)
        negative = loss_neg[n:].mean() - prior * loss_neg[:n].mean()
        g = np.zeros(n + m)
        if negative >= 0:
            g[:n] = -prior * (1 - s[:n]) / n - prior * s[:n] / n
            g[n:] = s[n:] / m
        else:  # give back what the negative part has taken too much
            g[:n] = prior * s[:n] / n
            g[n:] = -s[n:] / m
        grad = np.r_[np.bincount(cols, weights=values * g[rows], minlength=len(index)) + decay * w / max(n, 1), g.sum()]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    live = np.abs(w) > 1e-4
    names = [f for f, i in index.items() if live[i]]
    return Model({f: i for i, f in enumerate(names)}, np.array([w[index[f]] for f in names]), float(b))


def fit(labelled: DataFrame, unlabelled: DataFrame, positives: int = POSITIVES, others: int = UNLABELLED) -> Model | None:
    """From (text, toxic, ...) and (text, ...): bounded samples of both, picked by a hash of the whole row, so that copies
    and null texts enter at their share."""
    part = lambda df, most, n: df.withColumn("text", whole_text("text")).withColumn("pick", F.xxhash64(*df.columns)).where(F.pmod("pick", F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1))))
    counts = labelled.where("toxic IS NOT NULL").groupBy((F.col("toxic") == 1).alias("yes")).count().collect()
    n = {r["yes"]: r["count"] for r in counts}
    if not n.get(True):
        return None

    def texts(df: DataFrame) -> list[str]:
        out, held = [], 0
        for r in df.select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "pick").sort("pick", "text").toLocalIterator():
            held += len(r["text"])
            if held > SAMPLE_BYTES:
                break
            out.append(r["text"])
        return out

    pos = texts(part(labelled.where("toxic = 1"), positives, n[True]))
    unl = texts(part(unlabelled, others, unlabelled.count()))
    return train(pos, unl, n[True] / sum(n.values()))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score."""
    h = Hidden(docs)
    own = h.name(text)
    if model is None:
        return h.shown(h.df, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def make():
        of = shared.value.scorer()
        return lambda b: [np.array([of(t or "") for t in b.column(b.schema.get_field_index(own)).to_pylist()], dtype=np.float64)]

    return h.shown(appended(h.df, "score double", make), "score")


def op7_toxicity(spark, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", whole_text("text").alias("text")).withColumn("held_out", remainder("doc_id", 3) == 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.where("NOT held_out")
    model = fit(known.join(labels, "doc_id").select("doc_id", "text", "toxic"), known.select("doc_id", "text"))
    scored = score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
