"""SimHash near-duplicate groups by anchor-point covering.

A fingerprint has one bit for each of 64 majority votes over the XXH64 values of a text's word shingles.
Fingerprints link when they differ in at most 2 bits. To find all links without comparing everything, a
covering code gives the anchors: the product of four perfect codes over the 64 bits, Golay (23,12) twice,
Hamming (15,11) and the repetition code (3,1) - 2^36 anchors, covering radius 3+3+1+1 = 8, so every 64-bit
word has exactly one home anchor within 8 bits. Two fingerprints at distance 2 have a midpoint one bit from
either; its home anchor is within radius plus half the threshold (8+1) of both. So each distinct fingerprint
is replicated to the homes of the words within one bit of it (22 at most: 1 + 7 + 7 + ... distinct ones), and
fingerprints are compared only where they share an anchor. No link is lost and none is invented: candidates
are checked bit by bit.

Copies share a fingerprint, and only distinct fingerprints are replicated. An anchor that holds more than
HOT fingerprints is dealt anew by the finest covering code, all 64-bit words at radius 0: there a
fingerprint goes to its 65 neighbours at most one bit away, and no bucket can hold more than 65. Each task
gives a spanning forest of its links, never all pairs; components are found by star contraction.

Defined cases: null and empty texts, or white space only, have fingerprint zero, which links like any
other; fewer words than a shingle: the whole sequence is the shingle; repeated rows stay, each with the
same component; null doc_ids stay, with the least non-null doc_id of their group (null if there is none); of
documents of one group the one of least doc_id, then least text hash, stands for it; an empty table gives no rows;
only doc_id and text are read, so other columns can't clash; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.llm.common import Hidden, appended, arrow_map, as_bytes
from vernal.llm.graph import components
from vernal.sources.scratch import written

BITS = 2
#: Fingerprints at one anchor above which the finest code takes over.
HOT = 2048
_SHINGLES = 1 << 17


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 majority votes over XXH64 (seed 42) of the lower-cased text's word shingles, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        w = [b" ".join(w)]
    else:
        w = list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(w), _SHINGLES):
        part = w[at : at + _SHINGLES]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), dtype="<u8", count=len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(w), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """docs with a long column fp."""

    def make():
        return lambda b: [np.array([fingerprint(t, words) for t in as_bytes(b.column(b.schema.get_field_index(text)))], dtype=np.uint64).view(np.int64)]

    return appended(docs, "fp long", make)


def _leaders(n: int, poly: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a cyclic code: the syndrome of each bit, and the error pattern of least weight for each syndrome."""
    degree = poly.bit_length() - 1
    one = []
    for i in range(n):
        x = 1 << i
        while x.bit_length() > degree:
            x ^= poly << (x.bit_length() - 1 - degree)
        one.append(x)
    table = {0: 0}
    for _ in range(weight):
        for s, e in list(table.items()):
            for i in range(n):
                table.setdefault(s ^ one[i], e | 1 << i)
    assert len(table) == 1 << degree, "the code is not perfect"
    return np.array(one, dtype=np.uint64), np.array([table[s] for s in range(1 << degree)], dtype=np.uint64)


#: Perfect codes by length, generator polynomial and radius.
_BLOCKS = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1), (3, 0b111, 1))


class Anchors:
    """The product code: homes of words, and homes of all words within one bit."""

    def __init__(self) -> None:
        self.blocks, at = [], 0
        for n, poly, radius in _BLOCKS:
            self.blocks.append((at, n, *_leaders(n, poly, radius)))
            at += n
        assert at == 64

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into fp, anchor): each fingerprint's anchors, no repeats."""
        home, moved = np.zeros_like(fp), []
        for at, n, one, leaders in self.blocks:
            word = (fp >> np.uint64(at)) & np.uint64((1 << n) - 1)
            syndrome = np.zeros_like(word)
            for i in range(n):
                syndrome ^= ((word >> np.uint64(i)) & np.uint64(1)) * one[i]
            own = word ^ leaders[syndrome]
            home |= own << np.uint64(at)
            flips = np.uint64(1) << np.arange(n, dtype=np.uint64)
            other = (word[:, None] ^ flips) ^ leaders[syndrome[:, None] ^ one]
            moved.append((other ^ own[:, None]) << np.uint64(at))
        all_homes = np.sort(np.hstack([home[:, None], *[home[:, None] ^ m for m in moved]]), axis=1)
        first = np.ones(all_homes.shape, dtype=bool)
        first[:, 1:] = all_homes[:, 1:] != all_homes[:, :-1]
        return np.nonzero(first)[0], all_homes[first]


def _replicas(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Anchors()
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                i, anchor = code.near(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part[i].view(np.int64))], names=["anchor", "fp"])

    return arrow_map(fps.select("fp"), run, "anchor long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) over the links a-b, for nodes that aren't the least."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for end in (i, j):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _compare(anchor: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by anchor: links between fingerprints of one anchor, as a spanning forest."""
    left, right, at, lag = [], [], np.arange(len(fp) - 1), 1
    while len(at):
        at = at[at + lag < len(fp)]
        at = at[anchor[at] == anchor[at + lag]]
        x = fp[at] ^ fp[at + lag]
        near = (np.bitwise_count(x) <= bits) & (x != 0)
        left.append(fp[at[near]])
        right.append(fp[at[near] + lag])
        lag += 1
        if sum(map(len, left)) > 2_000_000:
            a, b = _forest(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
    return _forest(np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _links(replicas: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def give(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _compare(anchor, fp.view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(x[0]) for x in held) >= 500_000:
                anchor, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                yield give(anchor[:cut], fp[:cut])
                held = [(anchor[cut:], fp[cut:])]
        if held:
            yield give(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return arrow_map(replicas.repartition("anchor").sortWithinPartitions("anchor"), run, "a long, b long")


def _hot_links(hot: DataFrame) -> DataFrame:
    """By the finest code: distance 2 or less means a shared word at most one bit from both."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    points = hot.select("fp").distinct().select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    low = points.groupBy("point").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    return points.join(low, "point").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def linked(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp) of distinct fingerprints to links (a, b) at 2 or fewer differing bits: not all pairs, but every
    component of the full link graph is connected by them."""
    replicas = written(_replicas(fps), "anchors")
    crowded = replicas.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    crowded = written(crowded, "crowded")
    if crowded.isEmpty():
        return _links(replicas, BITS)
    ordinary = replicas.join(crowded, "anchor", "left_anti")
    return _links(ordinary, BITS).unionByName(_hot_links(replicas.join(crowded, "anchor", "left_semi")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, hot: int = HOT) -> DataFrame:
    """(doc_id, h: text hash, fp, root: least fingerprint of the group, component_id), a row for each row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    prints = written(fingerprints(rows, "text", words).select("doc_id", "h", "fp"), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = components(linked(least.select("fp"), hot))
    classed = least.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classed = written(classed, "classes")
    ids = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    of = classed.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp").select("doc_id", "h", "fp", "root", "component_id")


def representatives(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of found (doc_id, h, root): the one of least doc_id (null last), then least text hash; one of identical rows."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("f"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    first = first.select(name(F.col("f.doc_id")).alias("__id"), F.col("f.h").alias("__h"))
    copies = found.groupBy(name(F.col("doc_id")).alias("__id"), F.col("h").alias("__h")).agg(F.count("*").alias("__n"))
    first = written(first.join(copies, ["__id", "__h"]), "representatives")
    hide = Hidden(docs)
    rows = hide.df.withColumn("__id", name(F.col(hide.name(doc_id)))).withColumn("__h", F.xxhash64(F.coalesce(F.col(hide.name(text)).cast("string"), F.lit(""))))
    kept = rows.join(first, ["__id", "__h"])
    once = kept.where("__n = 1").select(*hide.df.columns)
    many = kept.where("__n > 1").dropDuplicates(["__id", "__h"]).select(*hide.df.columns)
    return hide.shown(once.unionByName(many))


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
