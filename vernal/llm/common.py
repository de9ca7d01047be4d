"""What the training-data operators share: columns out of the way, hold-out remainders, column-appending Arrow
maps and ranges of a key."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spaces as the contracts have them: U+0020 and U+0009 to U+000D (also what bytes.split() splits on).
SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def whole_text(text: Column | str = "text") -> Column:
    """The text, null as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text (null: 0), without Python."""
    t = F.regexp_replace(whole_text(text), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"{SPACE}+"))).cast("long")


class Hidden:
    """A table whose columns have been given names of their own (in_0, in_1, ...), so that an operator's columns can't
    clash with them, whatever they are called (in any case, or twice)."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.df = df.toDF(*[f"in_{i}" for i in range(len(self.names))])

    def name(self, column: str) -> str:
        """The hidden name of a column."""
        own = [i for i, c in enumerate(self.names) if c == column] or [i for i, c in enumerate(self.names) if c.lower() == column.lower()]
        if not own:
            raise ValueError(f"no column {column}: {', '.join(self.names)}")
        return f"in_{own[0]}"

    def shown(self, df: DataFrame, *outputs: str | Column, without: tuple[str, ...] = ()) -> DataFrame:
        """df with the columns under their own names again, but for those (hidden names) in ``without``, and outputs. A column that is
        named like an output is called name_in, with more underscores where that is taken as well."""
        made = {x.lower() for x in df.select(*outputs).columns}
        kept = {i: c for i, c in enumerate(self.names) if f"in_{i}" not in without}
        taken = made | {c.lower() for c in kept.values()}
        for i, c in kept.items():
            if c.lower() in made:
                c += "_in"
                while c.lower() in taken:
                    c += "_"
                taken.add(c.lower())
                kept[i] = c
        return df.select(*[F.col(f"in_{i}").alias(c) for i, c in kept.items()], *outputs)


#: Rows and bytes of an Arrow batch at most, where neither cluster nor session has a value of its own: texts can be long, and
#: a batch is in memory several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", 1_000), "spark.sql.execution.arrow.maxBytesPerBatch": (None, 4 << 20)}


def released() -> None:
    """Gives the system back what Arrow's pool and the C library hold in reserve: workers stay after a task, beside those of
    the next one's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: What a worker keeps from task to task.
_KEPT: dict = {}


def kept(key, make: Callable):
    """What make() gives, kept by this worker for the next tasks, until one begins that keeps nothing or something else."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forgotten() -> None:
    _KEPT.clear()


def arrow_map(df: DataFrame, fn: Callable, schema, keeps: bool = False) -> DataFrame:
    """mapInArrow with small batches, whose workers keep no reserve of memory after a task, nor (unless fn keeps something)
    what others have kept. The batches are a setting of the session, so other Arrow maps of it get them too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forgotten()
        try:
            yield from fn(batches)
        finally:
            released()

    spark = df.sparkSession
    for key, (default, most) in BATCH.items():
        if spark.sparkContext.getConf().get(key) is None and (default is None or spark.conf.get(key) == default):
            spark.conf.set(key, most)
    return df.mapInArrow(run, schema)


def appended(df: DataFrame, columns: str, make: Callable[[], Callable[[pa.RecordBatch], list]], keep: list[str] | None = None) -> DataFrame:
    """df (or its columns ``keep``) with computed columns at the end.

    columns: DDL of the new columns, none of which df has (see Hidden). make: called once in each
    task, returns the function from an Arrow batch to the new columns."""
    spark = df.sparkSession
    new = spark.createDataFrame([], columns).schema
    names = [f.name for f in new.fields]
    old = keep if keep is not None else df.columns
    if clash := {c.lower() for c in old} & {c.lower() for c in names}:
        raise ValueError(f"columns are there already: {', '.join(sorted(clash))}")
    out = type(new)([df.schema[c] for c in old] + list(new.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            got = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in fn(b)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in old], *got], names=[*old, *names])

    return arrow_map(df, run, out)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: Ranges at most: what the driver and the plan hold of them is bounded, ranges grow beyond (their tasks stream and sort
#: with spilling).
MOST_RANGES = 1 << 14


def ranged(df: DataFrame, key: str, size: Column, most: int) -> tuple[DataFrame, int]:
    """df with pid: its range of key (long; null in the lowest), cut where about ``most`` of size lie in each (more
    beyond MOST_RANGES ranges); and the number of ranges. Cuts are quantiles over all rows, so the ranges are the same
    each time."""
    total = df.agg(F.sum(size)).first()[0] or 0
    n = min(total // most + 1, MOST_RANGES)
    cuts = sorted(set(df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or [])) if n > 1 else []
    if not cuts:
        return df.withColumn("pid", F.lit(0)), 1
    bound = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")  # folded to a literal
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])  # binary search
    pid = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & F.coalesce(F.get(bound, p + s - 1) < F.col(key), F.lit(False)), p + s).otherwise(p))
    return df.withColumn("pid", pid), len(cuts) + 1
