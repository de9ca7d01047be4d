"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. Native: DataFrame
operations only.

A document's size is its number of words. Sources in code-point order (null last) weigh 5, 2, 1, repeating;
together they get 150 % of all words, each at most twice its own, the excess going to the others by weight
until none is above (water filling, solved in closed form over the table of sources).

Each source's documents are dealt by hash into blocks of about BLOCK_WORDS words (BLOCKS at least), in a random but
fixed order. A target of e
whole passes and a rest takes every block e times, then whole blocks of one more pass up to the rest; the
block in which the rest ends is divided in the same way twice more, and the last document of all is taken
up to the word where the quota is met. So every source meets its rounded target exactly (but for up to n-1
words if n identical rows share the last place), and no window ever holds more than a source's blocks, but for the
table of sources and the root of the tree, which has a row for each drawn block. The number of shards follows the
volume (SHARD_WORDS).

The drawn blocks of all sources are the quotas that the tree divides: at each node, half of the draws go
left, their numbers by source following the multivariate hypergeometric law, until every leaf (an output
shard) has its exact vector. A shard then gets the next so many blocks of each source's permuted list -
disjoint by construction - and its documents are ordered by a hash (the local shuffle).

Defined cases: null or empty texts have size 0, and are in a pass that takes their block, with 0 words; a
null source is a source of its own; a source without words has target 0; identical rows are taken alike;
an empty table gives an empty result. Columns of docs named like an added one come back as name_in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernal.llm.common import Hidden, n_words, whole_text
from vernal.sources.scratch import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Blocks of a source at least (at the levels below the first: always), as bits of the key; words of a block and of a
#: shard, about, where there are more.
BITS, MOST_BITS, BLOCK_WORDS, SHARD_WORDS = 6, 20, 1 << 20, 1 << 24
BLOCKS = 1 << BITS
LEVELS = 3
#: Shards at least and at most.
SHARDS, MOST_SHARDS = 16, 1 << 14
SEED = 20


def _hash(*parts: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to those with sid (1, 2, ... by code point, null last), weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # the table of sources, not of documents
    s = sizes.withColumn("sid", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # the level at which what remains is shared, if all sources before this one are at their cap; the true level is the highest
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    return s.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(every))).select("source", "source_size", "sid", "weight", "target")


def _bucket(level: int) -> Column:
    """A row's block; at the first level of as many as the source has (bits)."""
    if level == 0:
        return F.pmod("key", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))).cast("int")
    return F.shiftright(F.col("key"), MOST_BITS + BITS * (level - 1)).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")


def _place(level: int) -> Column:
    """A block's place in its source's permuted order (ties by number)."""
    return F.struct(_hash(F.lit(level), F.col("sid"), F.col("bucket")), F.col("bucket"))


def sized(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with size and key, the hash that fixes a row's place in its source."""
    h = Hidden(docs)
    return h.shown(h.df, n_words(h.name(text)).alias("size"), _hash(F.col(h.name(doc_id)), whole_text(h.name(text)), F.col(h.name(source))).alias("key"))


def shards_of(words: int) -> int:
    """A power of two of shards for a mix of so many words."""
    return min(max(SHARDS, 1 << max(-(-words // SHARD_WORDS) - 1, 0).bit_length()), MOST_SHARDS)


def plan(slim: DataFrame, shards: int | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str, DataFrame]:
    """From (source, size, key) of all documents: the small tables that say what is taken.

    sources: target, passes and how the rest ends (path of blocks); blocks: shard of each drawn (sid, block,
    pass), and whether the rest takes the block whole; last: words that rows of the last place give."""
    sources = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    quota = F.floor(F.col("target") + 0.5)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.greatest(F.col("source_size"), F.lit(1)) / float(BLOCK_WORDS))), F.lit(BITS)), F.lit(MOST_BITS)).cast("int")
    sources = written(sources.withColumn("rest", quota - F.col("passes") * F.col("source_size")).withColumn("bits", bits), "sources")
    if shards is None:
        shards = shards_of(int(sources.agg(F.sum("target")).first()[0] or 0))
    rows = slim.join(sources, slim["source"].eqNullSafe(sources["source"])).select("sid", "bits", "rest", "size", "key")
    by_source = Window.partitionBy("sid")
    levels: list[DataFrame] = []
    left = rows
    for level in range(LEVELS):
        # words of each block, how many of them lie before it, and whether the rest ends in it
        b = left.groupBy("sid", "rest", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        b = b.withColumn("before", F.sum("words").over(by_source.orderBy(_place(level))) - F.col("words"))
        b = b.withColumn("whole", (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0))
        b = written(b.withColumn("ends", (F.col("before") < F.col("rest")) & ~F.col("whole")), "blocks")
        levels.append(b)
        ends = b.where("ends").select("sid", F.col("bucket").alias("at"), (F.col("rest") - F.col("before")).alias("then"))
        left = left.join(ends, "sid").where(_bucket(level) == F.col("at")).select("sid", "bits", F.col("then").alias("rest"), "size", "key")
    # identical rows stand together
    last = left.groupBy("sid", "rest", "key").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    last = last.withColumn("before", F.sum("words").over(by_source.orderBy("key")) - F.col("words"))
    last = written(last.select("sid", "key", F.floor(F.least(F.col("words"), F.greatest(F.lit(0), F.col("rest") - F.col("before"))) / F.col("n")).alias("last_words")).where("last_words > 0"), "last")
    path = sources
    for level, b in enumerate(levels):
        path = path.join(b.where("ends").select("sid", F.col("bucket").alias(f"end{level}")), "sid", "left")
        if level:  # those of the first level are in the table of blocks
            whole = b.where("whole").groupBy("sid").agg(F.collect_set("bucket").alias(f"whole{level}"))  # BLOCKS at most
            path = path.join(whole, "sid", "left")
    # draws: each block once for each pass; the rest's pass has its whole blocks and the one in which it ends
    first = levels[0].join(sources.select("sid", "passes"), "sid")
    passes = F.col("passes") + F.when(F.col("whole") | F.col("ends"), 1).otherwise(0)
    draws = first.where(passes > 0).select("sid", "bucket", "whole", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass"))
    # a pass is complete for a block only up to its number of passes, so that passes stay in order
    rank = Window.partitionBy("sid").orderBy("pass", _hash(F.lit("draw"), F.col("sid"), F.col("pass"), F.col("bucket")), "bucket")
    draws = draws.withColumn("draw", F.row_number().over(rank))
    leaves = splitting_tree(draws.groupBy("sid").agg(F.count("*").alias("quota")), shards)
    offset = F.sum("quota").over(Window.partitionBy("sid").orderBy("shard"))
    dealt = leaves.withColumn("to", offset).select("sid", "shard", F.explode(F.sequence(F.col("to") - F.col("quota") + 1, F.col("to"))).alias("draw"))
    blocks = draws.join(dealt.withColumn("draw", F.col("draw").cast("int")), ["sid", "draw"])
    blocks = blocks.groupBy("sid", F.col("bucket").alias("block")).agg(F.max("whole").alias("whole0"), F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    return {"sources": path, "blocks": written(blocks, "draws"), "last": last}


def splitting_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(sid, quota) to (sid, shard, quota): a binary tree over the shards. At each node a random half of the
    draws goes left, which makes the left counts multivariate hypergeometric; sums are kept exactly. Draws are
    blocks, so their number depends on sources and BLOCKS, not on documents."""
    depth = max(shards - 1, 0).bit_length()
    if 1 << depth != shards:
        raise ValueError("shards must be a power of two")
    t = quotas.where("quota > 0").select("sid", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("i"), F.lit(0).alias("shard"))
    for level in range(depth):
        node = Window.partitionBy("shard")
        right = F.row_number().over(node.orderBy(_hash(F.lit("tree"), F.lit(level), F.col("sid"), F.col("i")), "sid", "i")) > F.floor((F.count("*").over(node) + F.pmod(F.col("shard"), F.lit(2))) / 2)
        t = t.withColumn("shard", 2 * F.col("shard") + right.cast("int"))
    return t.groupBy("sid", "shard").agg(F.count("*").alias("quota"))


def mix(rows: DataFrame, tables: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """Rows with size and key to rows with source_size, target, taken and copies: array of (pass, shard, words,
    rank), one for each time the document is drawn."""
    h = Hidden(rows)
    own = h.df.withColumns({"size": F.col(h.name("size")), "key": F.col(h.name("key"))})
    out = own.join(tables["sources"], F.col(h.name(source)).eqNullSafe(F.col("source"))).withColumn("block", _bucket(0))
    out = out.join(tables["blocks"], ["sid", "block"], "left").join(tables["last"], ["sid", "key"], "left")
    none = F.array().cast("array<int>")
    within, rest = F.lit(True), F.lit(0).cast("long")
    for level in range(LEVELS):
        held = F.array_contains(F.coalesce(F.col(f"whole{level}"), none), _bucket(level)) if level else F.coalesce("whole0", F.lit(False))
        whole = within & held
        rest = F.when(whole, F.col("size")).otherwise(rest)
        within = within & F.coalesce(_bucket(level) == F.col(f"end{level}"), F.lit(False))
    out = out.withColumn("rest_words", F.when(within, F.coalesce("last_words", F.lit(0).cast("long"))).otherwise(rest))
    words = lambda d: F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("rest_words"))
    copies = F.transform(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int>>")), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), words(d).alias("words"), _hash(F.lit("rank"), F.col("key"), d["pass"]).alias("rank")))
    # an empty document is in the whole passes only
    out = out.withColumn("copies", F.filter(copies, lambda d: (d["words"] > 0) | (d["pass"] < F.col("passes"))))
    out = out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    return h.shown(out, "source_size", "target", "taken", "copies")


def drawn(mixed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The mix itself: a row for each copy with its shard, ordered within shards; a copy that is taken in part keeps its first words."""
    h = Hidden(mixed.select(*columns))
    own = h.name(text)
    c = mixed.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(columns)], F.col("size").alias("words"), F.explode("copies").alias("copy"))
    part = F.array_join(F.slice(F.regexp_extract_all(whole_text(own), F.lit(r"[ \t-\r]*[^ \t-\r]+"), F.lit(0)), F.lit(1), F.greatest(F.lit(1), F.col("copy.words").cast("int"))), "")
    c = c.withColumn(own, F.when(F.col("copy.words") < F.col("words"), part).otherwise(F.col(own)))
    return h.shown(c, F.col("copy.shard").alias("shard"), F.col("copy.rank").alias("rank"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    slim = written(sized(docs).select("doc_id", "source", "size", "key"), "sizes")
    out = mix(slim, plan(slim.select("source", "size", "key")))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_sort(F.transform("copies", lambda d: d["shard"])).alias("shards"))
