"""Language identification by prediction by partial matching.

For each language, byte contexts up to order 3 are counted on a bounded, documented sample of labelled
texts, all of them, and then frozen. A symbol seen after a context costs -log2 c/(n+q) (n: occurrences, q: distinct
symbols); an unseen one pays the escape q/(n+q), renormalised over what the shorter context still allows
(exclusion), so each context's probabilities sum to one and a text's cost is an exact code length. The
language with the shortest code wins; ``score`` is its posterior under equal priors.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled text
every row is ``und``; equal code lengths go to the language first by code point; repeated rows are coded alike; an
empty table gives no rows; columns of the input named like an added one (lang_pred, score, bits) come back as name_in;
texts of any length are coded whole, in pieces that carry their context over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.llm.common import Hidden, appended, as_bytes, remainder

ORDER = 3
#: Bytes of labelled text, all languages together, that the statistics are fitted on (expected size, at most twice as
#: many; rows are picked by hash).
SAMPLE_BYTES = 6_000_000
#: Order-3 contexts with a row of their own in a table, the most frequent ones; all others are searched for.
DENSE_CONTEXTS = 65_536
PIECE = 1 << 20


@dataclass
class Ppm:
    """Frozen statistics: context ids as chained tables, log2 costs per language. Id 0 stands for "not seen"."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    size: int  # symbols, one for all bytes that were not seen
    t2: np.ndarray
    t3: np.ndarray
    kept: np.ndarray  # trigram id -> row of t4
    t4: np.ndarray
    rest: np.ndarray  # trigram id * size + symbol of the 4-grams that are not in t4, ascending
    rest_id: np.ndarray
    v: list[np.ndarray]  # v[k]: log2 P of the (k+1)-grams
    esc: list[np.ndarray]  # esc[k]: log2 escape weight of contexts of length k+1

    def cost(self, texts: list[bytes]) -> np.ndarray:
        """log2 probability of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        pieces, owner, held = [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), PIECE):
                pieces.append(b"\0" * (ORDER - at) + t[: at + PIECE] if at < ORDER else t[at - ORDER : at + PIECE])
                owner.append(i)
                held += len(pieces[-1])
                if held >= PIECE:
                    np.add.at(out, owner, self._cost(pieces))
                    pieces, owner, held = [], [], 0
        if pieces:
            np.add.at(out, owner, self._cost(pieces))
        return out

    def _cost(self, pieces: list[bytes]) -> np.ndarray:
        """Each piece begins with ORDER bytes of context, which are not counted."""
        n, a = len(self.languages), self.size
        s = self.symbol[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        g2 = self.t2[s[:-1] * a + s[1:]]
        g3 = self.t3[g2[:-1] * a + s[2:]]
        row = self.kept[g3[:-1]]
        g4 = self.t4[row * a + s[3:]]  # for the symbols from the fourth on
        if len(self.rest):
            at = np.flatnonzero((row == 0) & (g3[:-1] > 0))
            code = g3[at].astype(np.int64) * a + s[3:][at]
            j = np.minimum(np.searchsorted(self.rest, code), len(self.rest) - 1)
            g4[at] = np.where(self.rest[j] == code, self.rest_id[j], 0)
        value = self.v[3][g4]
        at = np.flatnonzero(g4 == 0)
        for k in (3, 2, 1):
            if not len(at):
                break
            context = g3[at] if k == 3 else g2[at + 1] if k == 2 else s[at + 2] + 1
            value[at] += self.esc[k - 1][context]
            if k == 1:
                value[at] += self.v[0][s[at + 3]]
                break
            gram = g3[at + 1] if k == 3 else g2[at + 2]
            hit = gram > 0
            value[at[hit]] += self.v[k - 1][gram[hit]]
            at = at[~hit]
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.r_[0, ends[:-1]]
        total = np.vstack([np.zeros((1, n)), np.cumsum(value, axis=0, dtype=np.float64)])
        return total[ends - ORDER] - total[starts]  # context bytes belong to nobody


def _grams(symbols: np.ndarray, live: np.ndarray, k: int, a: int) -> tuple[np.ndarray, np.ndarray]:
    code = np.zeros(len(symbols) - k + 1, dtype=np.int64)
    for j in range(k):
        code = code * a + symbols[j : len(symbols) - k + 1 + j]
    return np.unique(code[live[k - 1 :]], return_counts=True)


def train(samples: dict[str, list[bytes]]) -> Ppm:
    """Statistics of the languages' texts."""
    languages = sorted(samples)
    streams = {x: np.frombuffer(b"".join(b"\0" * ORDER + t for t in samples[x]) or b"\0" * ORDER, dtype=np.uint8) for x in languages}
    seen = np.zeros(256, dtype=bool)
    seen[0] = True
    for x in streams.values():
        seen[np.unique(x)] = True
    symbol = np.full(256, seen.sum(), dtype=np.int64)
    symbol[seen] = np.arange(seen.sum())
    a, n = int(seen.sum()) + 1, len(languages)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(4)]
    for x in languages:
        s = symbol[streams[x]]
        live = np.concatenate([np.r_[np.zeros(ORDER, dtype=bool), np.ones(len(t), dtype=bool)] for t in samples[x]] or [np.zeros(ORDER, dtype=bool)])
        for k in range(1, 5):
            counts[k - 1].append(_grams(s, live, k, a))
    grams = [np.unique(np.concatenate([c[0] for c in counts[k]] or [np.zeros(0, np.int64)])).astype(np.int64) for k in range(4)]
    # contexts that occur only before the text (padding) have no id of their own as grams; add them
    for k in (1, 2):
        grams[k] = np.unique(np.r_[grams[k], grams[k + 1] // a]) if k + 1 < 4 else grams[k]
    grams[1] = np.unique(np.r_[grams[1], grams[2] // a])
    # the most frequent order-3 contexts
    total = np.zeros(len(grams[2]))
    for code, c in counts[3]:
        np.add.at(total, np.searchsorted(grams[2], code // a), c)
    keep = np.sort(np.argsort(-total, kind="stable")[:DENSE_CONTEXTS])
    keep = keep[total[keep] > 0]
    kept = np.zeros(len(grams[2]) + 1, dtype=np.int64)
    kept[keep + 1] = np.arange(1, len(keep) + 1)
    t2 = np.zeros(a * a, dtype=np.int64)
    t2[grams[1]] = np.arange(1, len(grams[1]) + 1)
    t3 = np.zeros((len(grams[1]) + 1) * a, dtype=np.int32)
    t3[t2[grams[2] // a] * a + grams[2] % a] = np.arange(1, len(grams[2]) + 1)
    t4 = np.zeros((len(keep) + 1) * a, dtype=np.int32)
    trigram = np.searchsorted(grams[2], grams[3] // a) + 1
    dense = kept[trigram] > 0
    t4[kept[trigram[dense]] * a + grams[3][dense] % a] = np.flatnonzero(dense) + 1
    other, other_id = (trigram * a + grams[3] % a)[~dense], np.flatnonzero(~dense) + 1  # ascending as the grams are
    # probabilities, from the shortest context on
    v = [np.zeros((a, n), np.float32)]
    esc: list[np.ndarray] = []
    for j in range(n):
        code, c = counts[0][j]
        p = np.zeros(a)
        q, m = len(code), c.sum()
        p[code] = c / (m + q) if m else 0
        rest = np.setdiff1d(np.arange(a), code)
        p[rest] = (q / (m + q) if m else 1.0) / max(256 - q, 1)
        v[0][:, j] = np.log2(np.maximum(p, 1e-30))
    for k in (1, 2, 3):
        gram = grams[k]
        context = gram // a if k == 1 else np.searchsorted(grams[k - 1], gram // a)
        shorter = gram % (a**k)
        low = shorter if k == 1 else np.searchsorted(grams[k - 1], shorter)
        n_context = a if k == 1 else len(grams[k - 1])
        table, escape = np.zeros((len(gram) + 1, n), np.float32), np.zeros((n_context + 1, n), np.float32)
        for j in range(n):
            code, c = counts[k][j]
            at = np.searchsorted(gram, code)
            lower = v[k - 1][low if k == 1 else low + 1, j].astype(float)
            m = np.bincount(context[at], weights=c, minlength=n_context)
            q = np.bincount(context[at], minlength=n_context)
            used = np.bincount(context[at], weights=2.0 ** lower[at], minlength=n_context)
            live = m > 0
            e = np.zeros(n_context)
            e[live] = np.log2(q[live] / (m[live] + q[live])) - np.log2(np.maximum(1 - used[live], 1e-9))
            own = e[context] + lower
            own[at] = np.log2(c / (m[context[at]] + q[context[at]]))
            table[1:, j], escape[1:, j] = own, e
        v.append(table)
        esc.append(escape)
    return Ppm(languages, symbol, a, t2, t3, kept, t4, other, other_id, v, esc)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", sample_bytes: int = SAMPLE_BYTES) -> Ppm:
    """Statistics from labelled rows. Each language gives an equal share of ``sample_bytes`` at most, as texts picked by a hash
    of the whole row (so that copies enter at their share), for the fit cut to that share; where that picks none, the
    text of least hash gives its first bytes, so no language is without statistics."""
    h = Hidden(docs)
    pick = F.xxhash64(*h.df.columns)
    rows = h.df.select(F.col(h.name(lang)).cast("string").alias("lang"), F.col(h.name(text)).cast("string").alias("text"), pick.alias("pick")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sizes = {r["lang"]: r["b"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    if not sizes:
        return train({})
    share = sample_bytes / len(sizes)
    ratio = F.create_map(*[x for k, b in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, share / b)))])
    most = max(int(share), 1)
    part = F.substring("text", 1, most)
    picked = rows.where((F.pmod("pick", F.lit(1 << 30)) / float(1 << 30)) < ratio[F.col("lang")])
    samples: dict[str, list[bytes]] = {k: [] for k in sizes}
    held = dict.fromkeys(sizes, 0)
    for r in picked.select("lang", part.alias("text"), "pick").sort("lang", "pick", "text").toLocalIterator():
        if held[r["lang"]] < 2 * most:
            samples[r["lang"]].append(r["text"].encode()[:most])
            held[r["lang"]] += len(samples[r["lang"]][-1])
    if missing := [k for k, x in samples.items() if not x]:
        first = rows.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by(part, F.col("pick")).alias("text"))
        for r in first.toLocalIterator():
            samples[r["lang"]].append(r["text"].encode()[:most])
    return train(samples)


def identify(docs: DataFrame, model: Ppm, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, and bits (code length a byte in the language found)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_BYTES
    h = Hidden(docs)
    own = h.name(text)
    flagged = h.df.withColumn("letter", F.coalesce(F.col(own).cast("string").rlike(r"\p{L}"), F.lit(False)))

    def make():
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)

        def columns(batch: pa.RecordBatch) -> list:
            letter = np.asarray(batch.column(batch.schema.get_field_index("letter")).to_pylist(), dtype=bool) & bool(m.languages)
            texts = as_bytes(batch.column(batch.schema.get_field_index(own)))
            best, score, bits = np.full(len(texts), len(m.languages)), np.zeros(len(texts)), np.zeros(len(texts))
            at = np.flatnonzero(letter)
            if len(at):
                cost = m.cost([texts[i] for i in at])
                best[at] = cost.argmax(axis=1)
                top = cost.max(axis=1)
                score[at] = 1 / np.exp2(np.maximum(cost - top[:, None], -1000)).sum(axis=1)
                bits[at] = -top / [len(texts[i]) for i in at]
            return [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(bits)]

        return columns

    found = appended(flagged, "lang_pred string, score double, bits double", make, keep=h.df.columns)
    return h.shown(found, "lang_pred", "score", "bits")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", F.col("bits").alias("bits_per_byte"))
