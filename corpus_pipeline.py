"""Training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next.

language_id drops what no language can be given to; near_dedup keeps one document of each group of near copies (five-word
shingles, similarity 0.8 or more, found by SimHash);
decontaminate drops documents that hold a benchmark passage; mix draws sources to their target weights
(documents can go, or come twice); tokens writes and rereads token files and returns a digest of them.
Nulls, empty texts, repeated rows and empty tables are handled as the operators' modules say. Columns of documents,
whatever they are called, go through all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vernal.llm import decontaminate, language_id, mixing, similar, simhash, tokens
from vernal.llm.common import Hidden
from vernal.sources.scratch import written

#: Least posterior of the language found.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is found; the labels of the documents themselves are learned from."""
    h = Hidden(docs)
    found = language_id.identify(h.df, language_id.fit(docs), h.name("text"))
    return h.shown(found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.representatives(docs, similar.similar(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    h = Hidden(docs)
    found = decontaminate.contaminated(h.df, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), h.name("text"))
    return h.shown(found.where(F.size("leaks") == 0))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in shards, shuffled within each; n_chars follows a text that is taken in part."""
    h = Hidden(docs)
    source, text = h.name("source"), h.name("text")
    rows = mixing.sized(h.df, source, text, h.name("doc_id"))
    tables = mixing.plan(written(rows.select(F.col(source).alias("source"), "size", "key"), "sizes"))
    out = mixing.drawn(mixing.mix(rows, tables, source), h.df.columns, text)
    if "n_chars" in docs.columns:
        n = h.name("n_chars")
        out = out.withColumn(n, F.length(text).cast(h.df.schema[n].dataType))
    return h.shown(out.repartition("shard").sortWithinPartitions("shard", "rank"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of the token files that are written and read back."""
    return tokens.digest(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", token_files)]

#: SQL can't express any stage; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
