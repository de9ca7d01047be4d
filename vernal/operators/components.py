"""8-connected components of pixel relations.

Pixels are labelled tile by tile (a task holds one tile of one site and subset), then labels of tiles are
merged over their shared borders: only border pixels and links between labels take part, in rounds of star
contraction that are written to the shared folder. A site larger than a tile costs a few rounds, never a
single task. The label of a component is its least pixel number, row * 2^31 + col.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernal.sources.scratch import written

TILE = 1024


def label_pixels(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Least pixel number of each pixel's component: runs of rows joined by union-find."""
    order = np.lexsort((col, row))
    r, c = row[order].astype(np.int64), col[order].astype(np.int64)
    start = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)] if len(r) else np.zeros(0, bool)
    begin = np.flatnonzero(start)
    end = np.r_[begin[1:], len(r)] - 1
    rr, c0, c1 = r[begin], c[begin], c[end]
    parent = list(range(len(begin)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    j = 0
    for i in range(len(begin)):
        while j < i and (rr[j] < rr[i] - 1 or (rr[j] == rr[i] - 1 and c1[j] < c0[i] - 1)):
            j += 1
        k = j
        while k < i and rr[k] == rr[i] - 1 and c0[k] <= c1[i] + 1:
            a, b = find(k), find(i)
            parent[max(a, b)] = min(a, b)
            k += 1
    first = np.array([begin[find(i)] for i in range(len(begin))], dtype=np.int64)
    number = (r << 31) + c
    out = np.empty(len(r), dtype=np.int64)
    out[order] = number[first[np.cumsum(start) - 1]] if len(r) else number
    return out


def _roots(links: DataFrame, keys: list[str], rounds: int = 50) -> DataFrame:
    """(keys, a, b) to (keys, label, root), star contraction."""
    now = written(links.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "labels")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.join(low, [*keys, "a"]).where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = big.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = big.join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(*keys, "a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "labels")
        got = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())
        if got == mark:
            return now.select(*keys, F.col("a").alias("label"), F.col("b").alias("root"))
        mark = got
    raise RuntimeError("component labels did not settle")


def components(px: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """px (keys, row, col; distinct) with label."""
    t = px.select(*keys, "row", "col", F.floor(F.col("row") / tile).cast("int").alias("__tr"), F.floor(F.col("col") / tile).cast("int").alias("__tc"))
    schema = T.StructType([*t.schema.fields, T.StructField("label", T.LongType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(label=label_pixels(pdf["row"].to_numpy(), pdf["col"].to_numpy()))

    labelled = t.groupBy(*keys, "__tr", "__tc").applyInPandas(one, schema)
    # pixels at the borders of tiles, and their neighbours in another tile
    labelled = written(labelled, "tiles")
    rim = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    edge = labelled.where(rim("row") | rim("col"))
    near = edge.withColumn("dr", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dc", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = near.select(*keys, (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), F.col("label").alias("b"), F.col("__tr").alias("tr"), F.col("__tc").alias("tc"))
    links = edge.join(near, [*keys, "row", "col"]).where("__tr <> tr OR __tc <> tc").select(*keys, F.col("label").alias("a"), "b").distinct()
    links = written(links, "links")
    out = labelled.drop("__tr", "__tc")
    if links.isEmpty():
        return out
    return out.join(_roots(links, keys), [*keys, "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root")
