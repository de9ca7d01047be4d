"""Secret scan. Native: DataFrame operations only.

Base patterns (assignments, access keys, hex runs) give base spans. The method adds spans of other random
strings: two character Markov models, one of random strings and one of ordinary words, identifiers and numbers,
trained from labelled samples, are compared by the log-likelihood ratio of a token's characters. Every token of
SHORTEST characters or more is scored, and the ratio alone decides: at RATIO a string is a secret if random strings
are 6e-6 as frequent as ordinary tokens; a random character is worth about 2 nats, so that shorter tokens can't
be told.

Spans are whole matches, as code points, end exclusive. Work grows with a text's length times the logarithm of its
number of matches: places are running sums in a few rounds, overlaps are found by binary search.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned alike; an empty table gives no
rows; a ratio of exactly the bound is a secret; texts of any length are scanned whole; columns of the input that are
named like an added one (assign, access, hex, markov) come back as name_in.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernal.llm.common import SPACE, Hidden, whole_text

#: Kinds in the order of the listing: pattern, group that has to be long enough, its least length. Maximal
#: runs make `+` with a least length and a counted repetition the same for the last two.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}+", 0, 20),
    ("hex", r"[0-9a-f]{24,}+", 0, 24),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least characters of a token, and the tokens that the models are asked about.
SHORTEST = 8
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+"
#: Log-likelihood ratio, in nats, from which a token is a secret.
RATIO = 12.0
#: Expected documents of the sample of ordinary words, generated random strings of each form, and generated numbers.
SAMPLE_DOCS, SAMPLE_STRINGS, SAMPLE_NUMBERS = 300, 1_000, 3_000
#: Rounds of a running sum and halvings of a search: a text has fewer than 16^7 matches, each of 8 bytes or more.
_ROUNDS, _HALVINGS = 7, 28


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column) -> Column:
    """Running sums of an array of longs: after each round a place holds the sum of 16 times as many values before it,
    so the steps are n log n and nothing copies more than the array."""
    rest = F.sequence(F.lit(1), F.lit(15))

    def added(far: int):
        none = F.lit(0).cast("long")
        return lambda a: F.when(F.size(a) > far, F.transform(a, lambda x, i: F.aggregate(rest, x, lambda s, j: s + F.when(i >= j * far, F.get(a, i - j * far)).otherwise(none)))).otherwise(a)

    for k in range(_ROUNDS):
        values = _let(values, added(16**k))
    return values


def _overlaps(span: Column, spans: Column) -> Column:
    """Whether a span overlaps one of spans, which are in order and don't overlap: the last that begins before its end decides."""
    at = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(_HALVINGS))]), F.lit(0), lambda p, step: F.when((p <= F.size(spans) - step) & (F.get(spans, p + step - 1)["start"] < span["end"]), p + step).otherwise(p))
    return F.when(F.size(spans) > 0, _let(at, lambda p: (p > 0) & F.coalesce(F.get(spans, p - 1)["end"] > span["start"], F.lit(False)))).otherwise(F.lit(False))


_SPANS = "array<struct<start:long,rank:int,end:long,value:string>>"


def _spans(df: DataFrame, out: str, text: str, pattern: str, rank: int, group: int, least: int) -> DataFrame:
    """df with array column out: (start, rank, end, value) of the matches whose group is long enough."""
    hit = F.col(text).rlike(pattern)
    # what stands between matches and the matches themselves, only of texts that have one
    df = df.withColumn("__gap", F.when(hit, F.split(text, pattern, -1)))
    df = df.withColumn("__all", F.when(F.col("__gap").isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn("__value", F.when(F.col("__gap").isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col("__all"))
    df = df.withColumn("__size", F.transform("__all", lambda m: F.length(m).cast("long")))
    df = df.withColumn("__step", F.zip_with(F.slice("__gap", F.lit(1), F.size("__all")), F.col("__size"), lambda g, m: F.length(g).cast("long") + m))
    df = df.withColumn("__ahead", F.zip_with(_running(F.col("__step")), F.col("__step"), lambda a, n: a - n))
    made = F.transform(F.arrays_zip("__gap", "__ahead", "__size", "__value"), lambda z: F.struct((z["__ahead"] + F.length(z["__gap"])).alias("start"), F.lit(rank).alias("rank"), (z["__ahead"] + F.length(z["__gap"]) + z["__size"]).alias("end"), z["__value"].alias("value")))
    kept = F.filter(made, lambda s: s["value"].isNotNull() & (F.length(s["value"]) >= least))
    df = df.withColumn(out, F.when(F.col("__gap").isNotNull(), kept).otherwise(F.array()).cast(_SPANS))
    return df.drop("__gap", "__all", "__value", "__size", "__step", "__ahead")


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (none of whose columns is called like a kind) with text (null: empty) and an array column of spans for each base kind."""
    df = docs.withColumn(text, whole_text(text))
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        df = _spans(df, kind, text, pattern, rank, group, least)
    return df


def samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled samples (sample, random, n: how often): words of about SAMPLE_DOCS documents as they stand, and in
    capitals, joined by signs and with numbers as in identifiers; numbers, dates and codes; and generated random strings
    in base64, hex and base36. All are fixed by hashes."""
    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / max(n, 1))))
    word = picked.select(F.explode(F.split(whole_text(text), f"{SPACE}+")).alias("w")).where("w RLIKE '^[A-Za-z]+$'").groupBy("w").agg(F.count("*").alias("n"))
    low, up = F.lower("w"), F.upper("w")
    code = F.pmod(F.xxhash64("w"), F.lit(10_000)).cast("string")
    forms = F.array("w", up, F.concat_ws("_", low, low), F.concat_ws("_", up, up), F.concat(low, F.initcap("w")), F.concat_ws("-", low, low), F.concat_ws("/", low, low), F.concat(low, code), F.concat_ws("-", low, code))
    word = word.select(F.explode(forms).alias("sample"), F.lit(False).alias("random"), "n")
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("number"), F.col("id").cast("string")), 256)
    digits = F.lpad(F.conv(F.substring(digest, 1, 14), 16, 10), 17, "0")
    part = lambda at, n: F.substring(digits, at, n)
    forms = F.array(F.expr("substring(digits, 1, cast(4 + id % 12 as int))"), F.concat_ws("-", F.lit("20"), part(4, 2), part(7, 2)), F.concat(F.lit("19"), part(2, 2), F.lit("-"), part(4, 2), F.lit("-"), part(6, 2)), F.concat_ws("-", part(3, 3), part(6, 3), part(9, 4)))
    number = spark.range(SAMPLE_NUMBERS).withColumn("digits", digits).select(F.explode(forms).alias("sample"), F.lit(False).alias("random"), F.lit(1).cast("long").alias("n"))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    forms = F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.conv(F.substring(digest, 1, 15), 16, 36), F.translate(F.base64(F.unhex(digest)), "+/=", "-_"))
    random = spark.range(SAMPLE_STRINGS).select(F.explode(forms).alias("sample"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))
    return word.unionByName(number).unionByName(random)


def _symbols(token: Column) -> Column:
    """Places of a token's characters in ALPHABET, from 1; 0 for any other."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log ratios of the two models, one for each pair of characters (0: any other character or the
    beginning), from (sample, random) and, where it is there, n: how often a sample counts."""
    n = F.col("n") if "n" in labelled.columns else F.lit(1)
    c = labelled.select("random", n.cast("long").alias("n"), _symbols(F.col("sample")).alias("s"))
    pair = c.select("random", "n", F.explode(F.zip_with(F.concat(F.array(F.lit(0)), F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0)))), "s", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).where("p.b IS NOT NULL")
    size = len(ALPHABET) + 1
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pair.groupBy("random", "p.a", "p.b").agg(F.sum("n").alias("n")).collect()}  # 2 * 69^2 at most
    total: dict[tuple, float] = {}
    for (random, a, _), n in counts.items():
        total[random, a] = total.get((random, a), 0.0) + n
    p = lambda random, a, b: math.log((counts.get((random, a, b), 0) + smoothing) / (total.get((random, a), 0.0) + smoothing * size))
    return [float(f"{p(True, a, b) - p(False, a, b):.6g}") for a in range(size) for b in range(size)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token's characters, summed from the first on."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to a literal
    size = len(ALPHABET) + 1
    begun = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(_symbols(token), begun, lambda a, c: F.struct((a["sum"] + F.get(table, a["last"] * size + c)).alias("sum"), c.alias("last")), lambda a: a["sum"])


def scan(docs: DataFrame, ratios: list[float], text: str = "text", least: float = RATIO) -> DataFrame:
    """docs with assign, access, hex and markov: arrays of (start, rank, end, value)."""
    h = Hidden(docs)
    own = h.name(text)
    df = base_spans(h.df, own)
    # places are only looked for in texts that have a random token
    odd = F.exists(F.regexp_extract_all(own, F.lit(TOKEN), F.lit(0)), lambda t: log_ratio(t, ratios) >= least)
    df = _spans(df.withColumn("__text", F.when(odd, F.col(own)).otherwise(F.lit(""))), "__token", "__text", TOKEN, len(KINDS), 0, SHORTEST)
    free = lambda s: ~reduce(or_, [_overlaps(s, F.col(k)) for k, *_ in KINDS])
    df = df.withColumn("markov", F.filter("__token", lambda s: (log_ratio(s["value"], ratios) >= least) & free(s)))
    return h.shown(df, *[k for k, *_ in KINDS], "markov")


def listing(*kinds: str) -> Column:
    """kind:start:end of the spans of these columns, by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("markov"))
    spans = F.array_sort(F.concat(*[F.col(k) for k in kinds]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(samples(docs)))
    kinds = [k for k, *_ in KINDS]
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(listing(*kinds), 256).alias("base_sha256"), listing(*kinds, "markov").alias("spans"), F.size("markov").cast("long").alias("n_markov"))
