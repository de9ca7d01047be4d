"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Texts and items become words (lower case, ASCII punctuation as space). Seeds are an item's word n-grams, all
of them: the seeds that an edit leaves are not known before. Where a document holds a seed, the item is
aligned with the words around it: local alignment, match +2, mismatch and gap -1, as a share of the best
possible score. A document that reaches ``least`` with any item is contaminated by it; edited and paraphrased
copies lose a few points for each edit only.

What makes frequent seeds cheap loses nothing: an alignment has at most as many matches as the item has
places whose word is in the window, and as the window has places whose word is in the item, and scores 2 for
each at best. Windows that can't reach ``least`` by that are not aligned.

The benchmark is taken in blocks of BLOCK_WORDS words, so what goes to the executors is bounded, and each
block passes over the documents once. Nothing is paired but documents and items that share a seed.

Defined cases: null and empty texts have no words and no leaks; an item with fewer words than a seed is found where
all its words stand in a row; a null item, or one without words, is not found; an item repeated under several ids is
reported under each; of alignments with equal scores the last end counts; repeated rows of documents are reported
alike; an empty table of documents gives no rows, an empty benchmark no leaks; a column of documents called leaks
comes back as leaks_in; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.llm.common import Hidden, appended, as_bytes

N = 3
LEAST = 0.5
BLOCK_WORDS = 1 << 20
_PIECE = 4 << 20
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPACED).split()


class Items:
    """A block of items as word ids and seeds. Id 0 is any other word."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t or "")], dtype=np.int32) for _, t in items]
        self.base = len(self.vocabulary) + 1
        code, item, at = [], [], []
        for k, w in enumerate(self.words):
            c = self.codes(w)
            code.append(c)
            item.append(np.full(len(c), k))
            at.append(np.arange(len(c)))
        self.code, self.item, self.at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (code, item, at))
        order = np.lexsort((self.at, self.item, self.code))
        self.code, self.item, self.at = self.code[order], self.item[order], self.at[order]
        self.seeds, self.first = np.unique(self.code, return_index=True)
        #: items of fewer words than a seed, by length: their words as one number, and the items
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, N):
            own = [k for k, w in enumerate(self.words) if len(w) == n]
            if own:
                c = np.array([int(self.codes(self.words[k], n)[0]) for k in own], dtype=np.int64)
                order = np.argsort(c, kind="stable")
                self.short[n] = c[order], np.array(own)[order]

    def codes(self, w: np.ndarray, grams: int = N) -> np.ndarray:
        """n-grams of word ids as numbers. From some two million distinct words on they wrap round, so that different seeds
        can have one number: that adds places to align, and takes none away."""
        n = max(len(w) - grams + 1, 0)
        code = np.zeros(n, np.int64)
        for j in range(grams):
            code = code * self.base + w[j : j + n]
        return code

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts, N-1 zeros after each, and where each text begins."""
        get = self.vocabulary.get
        ids: list[int] = []
        begin = []
        for t in texts:
            begin.append(len(ids))
            ids += [get(w, 0) for w in t.decode("utf-8", "replace").lower().encode().translate(_SPACED).split()]
            ids += [0] * (N - 1)
        return np.array(ids, dtype=np.int32), np.array(begin, dtype=np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, seed) of all seeds in the word ids."""
        if len(ids) < N or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(ids) - N + 1
        at = np.flatnonzero((ids[:n] > 0) & (ids[1 : n + 1] > 0) & (ids[2 : n + 2] > 0))
        code = np.zeros(len(at), np.int64)
        for j in range(N):
            code = code * self.base + ids[at + j]
        seed = np.minimum(np.searchsorted(self.seeds, code), len(self.seeds) - 1)
        found = self.seeds[seed] == code
        return at[found], seed[found]


    def verbatim(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first place, length) of items shorter than a seed, wherever their words stand in a row."""
        for n, (code, item) in self.short.items():
            here = np.ones(max(len(ids) - n + 1, 0), dtype=bool)
            for j in range(n):
                here &= ids[j : j + len(here)] > 0
            at = np.flatnonzero(here)
            own = self.codes(ids, n)[at]
            low, high = np.searchsorted(code, own), np.searchsorted(code, own, side="right")
            for i in np.flatnonzero(high > low):
                for k in item[low[i] : high[i]]:
                    if (self.words[k] == ids[at[i] : at[i] + n]).all():
                        yield int(k), int(at[i]), n


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of an item against each row of word ids, and where the best alignment ends."""
    n, width = windows.shape
    j = np.arange(width, dtype=np.int32)
    h = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for w in item:
        step = np.where(windows == w, 2, -1) + h[:, :-1]
        np.maximum(step, h[:, 1:] - 1, out=step)
        np.maximum(step, 0, out=step)
        step = np.maximum.accumulate(step + j, axis=1) - j  # gaps in the item
        h[:, 1:] = step
        top = step.max(axis=1)
        better = top > best
        end[better] = step[better].argmax(axis=1)
        best = np.maximum(best, top)
    return best, end


def reachable(item: np.ndarray, windows: np.ndarray, known: int) -> np.ndarray:
    """Upper bounds of the scores of an item against each row of word ids (below ``known``)."""
    inside = np.zeros(known + 1, dtype=bool)  # the last for ids of -1
    inside[item] = True
    held = inside[windows]
    most = held.sum(axis=1)
    few = np.flatnonzero(most)
    # places of the item whose word is in the window
    times = np.bincount(item, minlength=known)
    row, column = np.nonzero(held[few])
    pairs = np.unique(row * known + windows[few[row], column])
    most[few] = np.minimum(most[few], np.bincount(pairs // known, weights=times[pairs % known], minlength=len(few)))
    return 2 * most


def leaks(items: Items, texts: list[bytes], least: float = LEAST) -> list[list[dict]]:
    """For each text its leaks: item_id, score, end_word (the word after the aligned passage)."""
    out: list[list[dict]] = [[] for _ in texts]
    ids, begin = items.read(texts)
    found: dict[tuple[int, int], tuple[float, int]] = {}
    for k, at, n in items.verbatim(ids):
        d = int(np.searchsorted(begin, at, side="right")) - 1
        found[k, d] = max(found.get((k, d), (0.0, 0)), (1.0, at - int(begin[d]) + n))
    place, seed = items.hits(ids)
    if len(place):
        _aligned(items, ids, begin, place, seed, least, found)
    for (k, d), (score, end) in sorted(found.items()):
        out[d].append({"item_id": items.ids[k], "score": score, "end_word": end})
    return out


def _aligned(items: Items, ids: np.ndarray, begin: np.ndarray, place: np.ndarray, seed: np.ndarray, least: float, found: dict) -> None:
    """Adds to found, by (item, text), the best score and its end of the alignments at seeds that reach ``least``."""
    # all (document, item, cell of the diagonal) that share a seed
    last = np.r_[items.first[1:], len(items.code)]
    n = last[seed] - items.first[seed]
    flat = np.repeat(items.first[seed] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    place = np.repeat(place, n)
    item, diagonal = items.item[flat], place - items.at[flat]
    doc = np.searchsorted(begin, place, side="right") - 1
    size = np.array([len(w) for w in items.words])
    slack = size[item] // 4 + 4
    cell = np.floor_divide(diagonal - begin[doc], slack)
    keys = np.unique(np.stack([item, doc, cell]), axis=1)
    ends = np.r_[begin[1:], len(ids)]
    padded = np.r_[ids, np.int32(-1)]
    for k in np.unique(keys[0]):
        own = keys[1:, keys[0] == k]
        m, s = int(size[k]), int(size[k]) // 4 + 4
        at = (begin[own[0]] + own[1] * s - s)[:, None] + np.arange(m + 3 * s)
        at[(at < begin[own[0]][:, None]) | (at >= ends[own[0]][:, None])] = len(ids)
        for part in range(0, len(at), 4096):
            windows = padded[at[part : part + 4096]]
            able = np.flatnonzero(reachable(items.words[k], windows, items.base) >= least * 2 * m)
            score, end = align(items.words[k], windows[able])
            for j in np.flatnonzero(score >= least * 2 * m):
                i, d = able[j], int(own[0][part + able[j]])
                new = (float(score[j]) / (2 * m), int(at[part + i][end[j]] - begin[d]) + 1)
                found[k, d] = max(found.get((k, d), (0.0, 0)), new)


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").sort("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"].split())
        if size >= BLOCK_WORDS:
            yield Items(held)
            held, size = [], 0
    if held:
        yield Items(held)


def _pieces(texts: list[bytes]) -> Iterator[slice]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= _PIECE:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


LEAKS = "array<struct<item_id:bigint,score:double,end_word:bigint>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with leaks: array of (item_id, score, end_word), empty for a clean document."""
    h = Hidden(docs)
    own = h.name(text)
    out = h.df.withColumn("leaks", F.array().cast(LEAKS))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("end_word", pa.int64())]))
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make(shared=shared):
            def columns(b: pa.RecordBatch) -> list:
                texts = as_bytes(b.column(b.schema.get_field_index(own)).cast(pa.string()))
                return [pa.array([x for part in _pieces(texts) for x in leaks(shared.value, texts[part], least)], kind)]

            return columns

        out = appended(out, f"more {LEAKS}", make).withColumn("leaks", F.concat("leaks", F.col("more").cast(LEAKS))).drop("more")
    return h.shown(out, "leaks")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.score", "leak.end_word")
