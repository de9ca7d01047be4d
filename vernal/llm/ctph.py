"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over 7 bytes cuts a text wherever the hash is -1 modulo the block size 3*2^k; each piece gives
one of 64 letters. k is the largest whose signature has 32 pieces or more, at most 64 letters (the last takes
all that is left), found from the text's length downwards. A fingerprint is "block:letters:letters", the
second signature at twice the block size, so that texts of up to twice the length stay comparable. Likeness
is 1 - d / (length + length) with d the edit distance (insert, delete) of signatures at the same block size;
0 where no block size is common or no RUN letters in a row are.

Defined cases: a null text counts as empty; the empty text's fingerprint is "3::"; equal fingerprints have
likeness 1. Texts are hashed whole, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernal.llm.common import arrow_map, as_bytes, ranged, whole_text

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODE = np.frombuffer(LETTERS.encode(), dtype=np.uint8)
WINDOW, MOST, LEAST, RUN = 7, 64, 32, 4
PIECE = 1 << 20
#: Bytes of text in a range of documents that one task orders.
RANGE_BYTES = 8 << 20


def _rolled(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes after their 6 bytes of context: sums of mixed rolling hashes (exclusive ends at each place),
    and the places (index, level) where the hash cuts."""
    x = buf.astype(np.uint32)
    n = len(x) - WINDOW + 1
    h1, h2, h3 = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(WINDOW):
        part = x[WINDOW - 1 - k : WINDOW - 1 - k + n]
        h1 += part
        h2 += h1  # the sum of h1 so far weighs older bytes less
        h3 ^= part << np.uint32(5 * k)
    r = h1 + h2 + h3
    mixed = r * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    q = r + np.uint32(1)
    at = np.flatnonzero(q % np.uint32(3) == 0)
    low = q[at] // np.uint32(3)
    low &= -low
    level = np.where(low, np.bitwise_count(low - np.uint32(1)), 31)
    return mixed, at, level


def _signature(cuts: np.ndarray, sums: np.ndarray, total: int) -> str:
    """Letters of the pieces that end at the cuts (sums: prefix sums there), the rest as the last piece."""
    ends = sums[: MOST - 1]
    ends = np.append(ends, np.uint64(total)) if len(cuts) > MOST - 1 or not len(cuts) or cuts[-1] else ends
    piece = np.diff(ends, prepend=np.uint64(0))
    piece = (piece * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58)
    return _CODE[piece.astype(np.int64)].tobytes().decode()


def _made(n: int, at: np.ndarray, level: np.ndarray, sums: np.ndarray, total: int) -> str:
    if not n:
        return "3::"
    k = max(0, (max(n - 1, 0) // (3 * MOST)).bit_length())
    while k and int((level >= k).sum()) < LEAST:
        k -= 1
    out = []
    for j in (k, k + 1):
        m = level >= j
        # 0 marks a cut at the very end: nothing is left after it
        out.append(_signature(n - 1 - at[m], sums[m], total))
    return f"{3 << k}:{out[0]}:{out[1]}"


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of texts, small ones together, long ones in pieces."""
    out: list[str] = [""] * len(texts)
    group: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            out[i] = _long(t)
            continue
        group.append(i)
        held += len(t)
        if held > PIECE:
            _group(texts, group, out)
            group, held = [], 0
    _group(texts, group, out)
    return out


def _group(texts: list[bytes], group: list[int], out: list[str]) -> None:
    if not group:
        return
    pad = b"\0" * (WINDOW - 1)
    mixed, at, level = _rolled(np.frombuffer(pad + pad.join(texts[i] for i in group), dtype=np.uint8))
    total = np.cumsum(mixed)  # modulo 2^64
    begin = 0
    for i in group:
        n = len(texts[i])
        lo, hi = np.searchsorted(at, (begin, begin + n))
        base = total[begin - 1] if begin else np.uint64(0)
        whole = (int(total[begin + n - 1]) - int(base)) & (2**64 - 1) if n else 0
        out[i] = _made(n, at[lo:hi] - begin, level[lo:hi], total[at[lo:hi]] - base, whole)
        begin += n + WINDOW - 1


def _long(t: bytes) -> str:
    ats, levels, sums, base = [], [], [], np.uint64(0)
    for begin in range(0, len(t), PIECE):
        head = t[max(0, begin - WINDOW + 1) : begin]
        buf = b"\0" * (WINDOW - 1 - len(head)) + head + t[begin : begin + PIECE]
        mixed, at, level = _rolled(np.frombuffer(buf, dtype=np.uint8))
        total = np.cumsum(mixed) + base
        base = total[-1]
        ats.append(at + begin)
        levels.append(level)
        sums.append(total[at])
    return _made(len(t), np.concatenate(ats), np.concatenate(levels), np.concatenate(sums), int(base))


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or not ({a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}):
        return 0.0
    # edit distance by the longest common subsequence, bits in parallel
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    common = len(a) - v.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1, at compatible block sizes (equal, or one twice the other)."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    p, q = int(bx), int(by)
    if p == q:
        return max(_alike(x1, y1), _alike(x2, y2)) if x1 and y1 else 0.0
    if p == 2 * q:
        return _alike(x1, y2) if x1 and y2 else 0.0
    if q == 2 * p:
        return _alike(x2, y1) if x2 and y1 else 0.0
    return 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, text) to rows in ranges (pid) that hold, after their own documents in descending doc_id, a
    copy of the document that follows (tail = 1). Ties by text hash, null ids last, the first after the last."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text")).withColumn("h", F.xxhash64("text"))
    d, n = ranged(d, "doc_id", F.octet_length("text"), range_bytes)
    heads = [r.asDict() for r in d.groupBy("pid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), (-F.col("doc_id")).alias("neg"), "h")).alias("f")).select("pid", "f.no", "f.neg", "f.h").collect()]  # a row for each range
    heads.sort(key=lambda r: -r["pid"])
    spark = docs.sparkSession
    rows = [(None if r["no"] else -r["neg"], r["h"], heads[i - 1]["pid"]) for i, r in enumerate(heads)]  # the head goes to the range before it
    small = spark.createDataFrame(rows, "head long, head_h long, to int")
    own = d.select("doc_id", "text", "h", "pid", F.lit(0).alias("tail"))
    tails = d.join(F.broadcast(small), d["doc_id"].eqNullSafe(small["head"]) & (d["h"] == small["head_h"])).select("doc_id", "text", "h", F.col("to").alias("pid"), F.lit(1).alias("tail"))
    return own.unionByName(tails).repartition(n, "pid").sortWithinPartitions("pid", "tail", F.col("doc_id").desc_nulls_last(), "h")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ordered: DataFrame) -> DataFrame:
    """From with_next: each document's fingerprint, that of its edited text, and their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (pid, tail, doc_id, text, fingerprint)
        for b in batches:
            ids, pids, tails = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "pid", "tail"))
            raw = as_bytes(b.column(b.schema.get_field_index("text")))
            prints = fingerprints(raw)
            rows = [*([last] if last else []), *zip(pids, tails, ids, (t.decode("utf-8", "replace") for t in raw), prints, strict=True)]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[1]]
            last = rows[-1]
            texts = [edited(x[3], y[3]).encode() for x, y in pairs]
            found = fingerprints(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([x[4] for x, _ in pairs], pa.string()),
                    pa.array(found, pa.string()),
                    pa.array([likeness(x[4], e) for (x, _), e in zip(pairs, found, strict=True)], pa.float64()),
                    pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return arrow_map(ordered.select("pid", "tail", "doc_id", "text"), run, _OUT)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
