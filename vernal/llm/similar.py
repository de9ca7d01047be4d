"""Near copies (Jaccard similarity of five-word shingles at 0.8 or more) by SimHash and anchor-point covering.

A text of 5 words or more has two 64-bit fingerprints: over its distinct words, which an edit moves least, and
over its distinct five-word shingles. Anchors are the words of a covering code, the product of two perfect
Golay (23,12) codes over 46 bits of the first fingerprint (2^24 anchors, covering radius 6). A text is
replicated to the home anchors of all words within 2 bits (about 61), so texts up to 4 bits apart always share
an anchor, and texts 8 bits apart mostly do. Where texts share an anchor, those within WORD_BITS and
SHINGLE_BITS bits are candidates; a minimum spanning forest of them by distance goes on, never all pairs, and
each of its links is checked exactly: sizes of the intersection and union of the shingle sets (64-bit hashes).

The forest holds the closest candidates, so most near copies are in one group after that. What it leaves out, and
what the anchors miss (a block of words appended or cut moves the first fingerprint far), comes from BANDS keys of
ROWS least shingle hashes each: texts of similarity s share a key but for a chance of (1 - s**ROWS)**BANDS, 3e-6 at
0.8 and less above. Where texts that are not in one group yet share a key, every two of them whose sizes allow it are
checked exactly, in one task for the key (keys of the same texts are taken once), and the links that join groups are
added. No link is chosen before its check here, so links below the bound hide none above it.

An anchor of more than HOT texts is compared in blocks, a task for each pair of blocks, so none is skipped; so is
a key of more than APART texts.

Defined cases: null, empty and white-space texts are copies of each other; texts of fewer than 5 words are one
shingle, so only copies are alike; case (A-Z) and white space don't count; repeated rows share their group;
null doc_ids stay; empty tables give no rows; only doc_id and text are read, so other columns can't clash; texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.llm.common import appended, arrow_map, as_bytes
from vernal.llm.graph import components
from vernal.llm.simhash import _leaders
from vernal.sources.scratch import written

WORDS, LEAST = 5, 0.8
#: Bits that candidates differ in at most: of the words' fingerprint, and of the shingles'.
WORD_BITS, SHINGLE_BITS = 10, 19
#: Texts at one anchor above which it is compared in blocks of about so many.
HOT = 8192
#: Keys of least hashes, and least hashes in each.
BANDS, ROWS = 24, 4
#: Texts at one key above which it is compared in blocks of about so many.
APART = 2048
_GOLAY = (23, 0b110001110101, 3)
_PART = 1 << 17
#: Cells of the 2^24 anchors, for counting.
_CELL_BITS = 8
_CELLS = 1 << 24 - _CELL_BITS


def shingles(text: bytes, words: int = WORDS) -> list[bytes]:
    """Distinct word shingles of the lower-cased text; the whole sequence where it is shorter."""
    w = text.lower().split()
    if len(w) < words:
        return [b" ".join(w)]
    return list(dict.fromkeys(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))))


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype="<u8", count=len(parts))


def votes(hashes: np.ndarray) -> int:
    """64 majority votes over the hashes of distinct parts."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _PART):
        h = hashes[at : at + _PART]
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


_MIX = np.random.default_rng(17).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_MIX[1] |= np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS least hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        h = hashes[at : at + 2048] ^ _MIX[0]
        h *= _MIX[1]
        np.minimum(low, h.min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in low.reshape(BANDS, ROWS).T:
        key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _prints(rows: DataFrame) -> DataFrame:
    """rows with node (hash of the word sequence), n (words), by_word and by_shingle (fingerprints; 0 below 5 words) and
    bands (keys; none below 5 words)."""

    def make():
        def columns(b: pa.RecordBatch) -> list:
            out, keys = [], []
            for t in as_bytes(b.column(b.schema.get_field_index("text"))):
                w = t.lower().split()
                node, by_word, by_shingle, key = xxhash.xxh64_intdigest(b" ".join(w), 7), 0, 0, []
                if len(w) >= WORDS:
                    h = _hashes(shingles(t))
                    by_word, by_shingle, key = votes(_hashes(list(dict.fromkeys(w)))), votes(h), bands(h)
                out.append((node, len(w), by_word, by_shingle))
                keys.append(key)
            table = np.array(out, dtype=np.uint64).reshape(-1, 4).view(np.int64)
            return [*table.T, pa.array(keys, pa.list_(pa.int64()))]

        return columns

    return appended(rows, "node long, n long, by_word long, by_shingle long, bands array<long>", make)


class Cover:
    """Anchors of the homes of all words within 2 bits. How a home moves with the flipped bits depends on the
    syndrome alone, so the moves are listed once for each of the 2048 syndromes."""

    def __init__(self) -> None:
        n, poly, weight = _GOLAY
        self.one, self.leaders = _leaders(n, poly, weight)
        self.moves: list[list[np.ndarray]] = []
        flips = [(1 << i, int(self.one[i])) for i in range(n)]
        pairs = [(e | f, s ^ t) for k, (e, s) in enumerate(flips) for f, t in flips[:k]]
        for s in range(1 << 11):
            moved = lambda found, s=s: {e ^ int(self.leaders[s ^ t]) ^ int(self.leaders[s]) for e, t in found}
            none, single = {0}, {0} | moved(flips)
            self.moves.append([np.array(sorted(x), dtype=np.uint64) for x in (none, single, single | moved(pairs))])

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into fp, anchor): each fingerprint's anchors, no repeats."""
        own, lists = [], []
        for at in (0, 23):
            word = (fp >> np.uint64(at)) & np.uint64((1 << 23) - 1)
            syndrome = np.zeros_like(word)
            for i in range(23):
                syndrome ^= ((word >> np.uint64(i)) & np.uint64(1)) * self.one[i]
            own.append(word ^ self.leaders[syndrome])
            lists.append(syndrome)
        at, anchors = [], []
        for i, (x, y, s, t) in enumerate(zip(*own, *lists, strict=True)):
            (x0, x1, x2), (y0, y1, y2) = self.moves[int(s)], self.moves[int(t)]
            both = [(x ^ a)[:, None] >> np.uint64(11) << np.uint64(12) | (y ^ b)[None, :] >> np.uint64(11) for a, b in ((x2, y0), (x1, y1), (x0, y2))]
            found = np.unique(np.concatenate([z.ravel() for z in both]))
            at.append(np.full(len(found), i))
            anchors.append(found)
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(at), np.concatenate(anchors).astype(np.int32)


_COVER: list[Cover] = []


def cover() -> Cover:
    """One in a worker."""
    if not _COVER:
        _COVER.append(Cover())
    return _COVER[0]


def _replicas(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, by_word, by_shingle = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            i, anchor = cover().near(by_word.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, node[i], by_word[i], by_shingle[i])], names=["anchor", "node", "by_word", "by_shingle"])

    return arrow_map(nodes.select("node", "by_word", "by_shingle"), run, "anchor int, node long, by_word long, by_shingle long")


def _crowded(nodes: DataFrame, hot: int) -> DataFrame:
    """(anchor, blocks) of anchors of more than hot texts, exactly. A first pass counts cells of anchors, a fixed number in each
    task; the second counts the anchors of cells that hold more than hot, which all crowded ones are in."""

    def anchors(b: pa.RecordBatch) -> np.ndarray:
        return cover().near(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))[1]

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_CELLS, np.int64)
        for b in batches:
            n += np.bincount(anchors(b) >> _CELL_BITS, minlength=_CELLS)
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], names=["cell", "n"])

    cells = arrow_map(nodes.select("by_word"), coarse, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    full = np.zeros(_CELLS, bool)
    full[[r["cell"] for r in cells.select("cell").collect()]] = True  # _CELLS at most

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def give() -> pa.RecordBatch:
            anchor, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

        for b in batches:
            anchor = anchors(b)
            held.append(anchor[full[anchor >> _CELL_BITS]])
            if sum(map(len, held)) > 2_000_000:
                yield give()
        if held:
            yield give()

    few = nodes.select("by_word") if full.any() else nodes.select("by_word").limit(0)
    counts = arrow_map(few, fine, "anchor int, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > hot).select("anchor", F.ceil(F.col("n") / hot).cast("int").alias("blocks"))


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the links of a minimum spanning forest by distance d (ties by place)."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    order = np.argsort(d, kind="stable")
    i, j = at[: len(a)][order], at[len(a) :][order]
    label, live, chosen = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        p, q = label[i[live]], label[j[live]]
        live, p, q = live[p != q], p[p != q], q[p != q]
        if not len(live):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, p, live)
        np.minimum.at(best, q, live)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        p, q, joined = label[i[pick]], label[j[pick]], np.arange(len(nodes))
        while True:
            low, was = np.minimum(joined[p], joined[q]), joined.copy()
            np.minimum.at(joined, p, low)
            np.minimum.at(joined, q, low)
            joined = joined[joined]
            if (joined == was).all():
                break
        label = joined[label]


def _compare(group: np.ndarray, node: np.ndarray, by_word: np.ndarray, by_shingle: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows sorted by group: spanning forest (a, b, d) of the candidates within groups."""
    kept = [(node[:0], node[:0], np.zeros(0, np.int64))]
    at, lag = np.arange(len(node)), 1

    def forest() -> tuple[np.ndarray, ...]:
        a, b, d = (np.concatenate(x) for x in zip(*kept, strict=True))
        f = spanning(a, b, d)
        return a[f], b[f], d[f]

    while len(at):
        at = at[at + lag < len(node)]
        at = at[group[at] == group[at + lag]]
        d = np.bitwise_count(by_shingle[at] ^ by_shingle[at + lag])
        near = (d <= SHINGLE_BITS) & (np.bitwise_count(by_word[at] ^ by_word[at + lag]) <= WORD_BITS)
        kept.append((node[at[near]], node[at[near] + lag], d[near].astype(np.int64)))
        lag += 1
        if sum(len(x[0]) for x in kept) > 1_000_000 + 2 * len(kept[0][0]):
            kept = [forest()]
    return forest()


def candidates(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b), a < b, of likely near copies: forests whose union keeps the closest."""
    crowded = written(_crowded(nodes, hot), "crowded")
    replicas = _replicas(nodes)
    if crowded.isEmpty():
        dealt = replicas.withColumn("pair", F.lit(0))
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        own = F.pmod("node", blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        dealt = replicas.join(crowded, "anchor", "left").withColumn("own", own).withColumn("other", other)
        dealt = dealt.withColumn("pair", F.least("own", "other") * blocks + F.greatest("own", "other")).drop("own", "other", "blocks")
    dealt = dealt.select("anchor", "pair", "node", "by_word", "by_shingle").repartition("anchor", "pair").sortWithinPartitions("anchor", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def give(group, node, by_word, by_shingle) -> pa.RecordBatch:
            a, b, _ = _compare(group, node, by_word.view(np.uint64), by_shingle.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            anchor, pair, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            held.append((anchor.astype(np.int64) << 32 | pair, *rest))
            if sum(len(x[0]) for x in held) >= 200_000:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
                yield give(*(x[:cut] for x in whole))
                held = [tuple(x[cut:] for x in whole)]
        if held:
            yield give(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return arrow_map(dealt, run, "a long, b long").distinct()


def _sets(rows: DataFrame) -> DataFrame:
    """(node, shingles: array of hashes) of rows (node, text)."""

    def make():
        return lambda b: [pa.array([_hashes(shingles(t)).view(np.int64) for t in as_bytes(b.column(b.schema.get_field_index("text")))], pa.list_(pa.int64()))]

    return appended(rows, "shingles array<long>", make, keep=["node"])


def checked(links: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """links (a, b) whose texts, in sets (node, shingles), have a similarity of least or more."""
    # sizes alone rule out most links of texts with a common passage, before any set is moved
    size = sets.select("node", F.size("shingles").alias("n"))
    links = links.join(size.select(F.col("node").alias("a"), F.col("n").alias("p")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("q")), "b")
    links = links.where(F.least("p", "q") >= least * F.greatest("p", "q") - 1e-9).select("a", "b")
    both = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= least * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def _met(nodes: DataFrame) -> DataFrame:
    """(met, node): nodes that share a key with others; keys of the same nodes are one."""
    dealt = nodes.select(F.explode("bands").alias("key"), "node").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def give(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.r_[begin, len(key)])
            mixed = node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
            met = np.add.reduceat(mixed, begin) if len(begin) else mixed
            many = np.repeat(n > 1, n)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(met, n)[many].view(np.int64)), pa.array(node[many])], names=["met", "node"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            if sum(len(x[0]) for x in held) >= 200_000:
                key, node = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                yield give(key[:cut], node[:cut])
                held = [(key[cut:], node[cut:])]
        if held:
            yield give(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return arrow_map(dealt, run, "met long, node long").distinct()


def joining(root: np.ndarray, sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Places of texts with a similarity of least or more, of different roots: as many links as join all roots that any
    two texts join. All pairs of different roots are compared."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    start, label = np.r_[0, np.cumsum(size)], np.unique(root[order], return_inverse=True)[1]
    here, links = np.zeros(len(ids), dtype=bool), []
    for i in range(len(size)):
        end = int(np.searchsorted(size, size[i] / least + 1e-6, side="right"))  # longer ones can't be similar
        if not (label[i + 1 : end] != label[i]).any():
            continue
        own = ids[start[i] : start[i + 1]]
        here[own] = True
        shared = np.add.reduceat(here[ids[start[i + 1] : start[end]]], start[i + 1 : end] - start[i + 1], dtype=np.int64)
        here[own] = False
        for j in np.flatnonzero(shared >= least * (size[i] + size[i + 1 : end] - shared) - 1e-9) + i + 1:
            if label[j] != label[i]:
                links.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return links


def missing(met: DataFrame, root: DataFrame, sets: DataFrame, least: float = LEAST, most: int = APART) -> DataFrame:
    """Links (a, b) between the groups of root (node, root) that are left: of nodes that met (met, node)."""
    named = met.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = named.groupBy("met").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high")
    blocks = F.ceil(F.col("size") / most).cast("int")
    dealt = named.join(apart.select("met", blocks.alias("blocks")), "met").withColumn("own", F.pmod("node", "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("pair", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    dealt = dealt.select("met", "pair", "node", "root").join(sets, "node").select("met", "pair", "node", "root", "shingles")
    dealt = dealt.repartition("met", "pair").sortWithinPartitions("met", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node, root, sets = None, [], [], []

        def give() -> pa.RecordBatch:
            found = joining(np.array(root), sets, least)
            return pa.RecordBatch.from_arrays([pa.array([node[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            columns = [c.to_pylist() for c in b.columns[:4]]
            shingled = b.column(4)
            cuts, values = shingled.offsets.to_numpy(), shingled.values.to_numpy(zero_copy_only=False)
            for i, (m, p, x, r) in enumerate(zip(*columns, strict=True)):
                if (m, p) != now:
                    if len(sets) > 1:
                        yield give()
                    now, node, root, sets = (m, p), [], [], []
                node.append(x)
                root.append(r)
                sets.append(values[cuts[i] : cuts[i + 1]].copy())
        if len(sets) > 1:
            yield give()

    return arrow_map(dealt, run, "a long, b long").distinct()


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, h: text hash, root: of the group), a row for each row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # a text that is there many times goes through the fingerprints once for each copy; rows stay where they are
    prints = written(_prints(rows).drop("text"), "prints")
    nodes = written(prints.where(F.col("n") >= WORDS).groupBy("node").agg(F.min("by_word").alias("by_word"), F.min("by_shingle").alias("by_shingle"), F.first("bands").alias("bands")), "nodes")
    links = written(candidates(nodes, hot), "candidates")
    met = written(_met(nodes), "met")
    named = prints.select("h", "node").distinct()
    wanted = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).unionByName(met.select("node")).distinct()
    few = named.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("h").alias("h")).groupBy("h").agg(F.min("node").alias("node"))
    # one of each text's copies: first in each task, then by hash, where the join finds them
    texts = rows.select("h", "text").dropDuplicates(["h"]).join(few, "h")
    sets = written(_sets(texts.select("node", "text")), "sets")
    root = components(checked(links, sets, least))
    more = written(missing(met, root, sets, least, min(hot, APART)), "missing")
    if not more.isEmpty():
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    found = prints.select("doc_id", "h", "node").join(root, "node", "left")
    return found.select("doc_id", "h", F.coalesce("root", "node").alias("root"))
