"""Token ids in binary files, by the adaptive context-mixing range coder.

Texts are encoded with a public tokenizer, an end id closes each document, and documents go, in ascending
doc_id order, to shards by range of doc_id. A file is a Parquet container in the shared folder (so that any
store and Spark's commit protocol serve, also when executors are lost): a row is a unit of consecutive
documents with shard, unit, doc_ids, lengths and blocks (see rangecoder). Reading decodes all blocks and
checks each checksum.

The tokenizer splits a text into words that it encodes one by one, so a worker keeps the ids of words that it has
seen and finds them by the words' bytes, see known (Latin-1 texts without special tokens; others go through the library
as a whole).

Defined cases: a null or empty text gives the end id alone; documents with equal ids stand in text-hash
order, null ids first; repeated rows are written each; an empty table gives no files and no rows; columns but doc_id and
text are not read, so none can clash; a text of any length stays one document in one unit.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vernal.llm import rangecoder
from vernal.llm.common import arrow_map, kept, ranged, whole_text
from vernal.llm.known import Words
from vernal.sources.scratch import written

END = 2
#: Bytes of text in a shard, and ids in a unit, about.
SHARD_BYTES, UNIT_IDS = 4 << 20, 1 << 18
#: Units that are decoded at a time.
READ_UNITS = 8
#: Ids that a task holds before it codes them; words that a worker remembers; bytes of text that are cut at a time.
HELD_IDS, KNOWN, PART_BYTES = 1 << 21, 600_000, 2 << 20

_OTHER = "[^\t\n\r -~\xa1-\xff]|<\\|"
#: Kinds of Latin-1 characters: spaces, letters, numbers, other signs.
_SPACES, _SPACE, _LETTER, _NUMBER, _SIGN = b"\t\n\r ", *range(4)
_KIND = bytes(_SPACE if c in _SPACES else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _SIGN) for c in range(256))
_KINDS = np.frombuffer(_KIND, np.uint8)


def words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Latin-1 texts (no nulls) in lower case, place and size of each word in them, and how many each text has. Spaces end a
    word, and so does a change between letters, numbers and other signs; each number is a word, and so are 's 't 're 've
    'm 'll 'd where no other sign stands before them."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset :][: len(texts) + 1]
    raw = (texts.buffers()[2] or pa.py_buffer(b""))[int(bounds[0]) : int(bounds[-1])].to_pybytes()
    bounds = bounds - bounds[0]
    raw, kind = raw.lower(), np.frombuffer(raw.translate(_KIND), np.uint8)  # lower() of bytes: A to Z only
    low, own = np.frombuffer(raw, np.uint8), None
    if not raw.isascii():  # two bytes: C2 or C3, and one more
        first = np.flatnonzero(low >= 0xC0)
        own, code = first + 1, ((low[first] & 3) << 6) | (low[first + 1] & 63)
        kind, low = kind.copy(), low.copy()
        kind[first] = kind[own] = _KINDS.take(code)
        low[own[(code >= 0xC0) & (code <= 0xDE) & (code != 0xD7)]] += 32
        raw = low.tobytes()
    start = kind == _NUMBER
    start[1:] |= kind[1:] != kind[:-1]
    if own is not None:
        start[own] = False
    start[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    mark = np.flatnonzero(low == 39)
    mark = mark[start[mark]]
    if len(mark):
        end = bounds[np.searchsorted(bounds, mark, side="right")]
        one, two = (np.where(mark + k < end, low.take(mark + k, mode="clip"), 0).astype(np.int32) for k in (1, 2))
        wide = np.where(np.isin(one, list(b"stmd")), 2, np.where(np.isin((one << 8) | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]), 3, 0))
        mark, end, wide = (x[wide > 0] for x in (mark, end, wide))
        start[mark + 1] = False
        after = (mark + wide)[mark + wide < end]
        start[after] |= kind[after] == _LETTER
    at = np.flatnonzero(start)
    size = np.diff(at, append=len(low))
    word = np.flatnonzero(kind.take(at) != _SPACE)
    at = at.take(word)
    return raw, at, size.take(word), np.diff(np.searchsorted(at, bounds))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte: printable ones stand for themselves, the others
    follow from U+0100 on. The space stays, as the cut between words."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return dict(zip(own, map(chr, own), strict=True)) | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*own}))} | {32: " "}


_BYTES = _byte_letters()


class Tokens:
    """A tokenizer with a memory of words. by_word: its normalizer lower-cases, its pre-tokenizer cuts texts into letters,
    single digits and signs as words() does and takes words as bytes, and a word's last id has an end of word. Other
    tokenizers, and texts outside Latin-1, go through the library as a whole."""

    def __init__(self, definition: str, by_word: bool) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads would hold memory of their own
        self.tokenizer, self.by_word = Tokenizer.from_str(definition), by_word
        if by_word:
            self.words_only = Tokenizer(self.tokenizer.model)
            self.words_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            suffix = self.tokenizer.model.end_of_word_suffix
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
            self.kind = np.uint16 if len(self.last) <= 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        """Ids of the k-th word are flat[start[k] : start[k] + size[k]]; used: parts of texts that had it."""
        self.index = Words()
        self.flat, self.end = np.zeros(1 << 16, self.kind if self.by_word else np.uint32), 0
        self.start, self.size, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _add(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Ids of the last words of the index."""
        at, n = len(self.index) - len(size), len(size)
        while at + n > len(self.size):
            self.start, self.size, self.used = (np.r_[x, np.zeros_like(x)] for x in (self.start, self.size, self.used))
        while self.end + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.end : self.end + len(ids)] = ids
        self.size[at : at + n] = size
        self.start[at : at + n] = self.end + np.cumsum(size) - size
        self.end += len(ids)

    def _ids(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words k in a row, and how many each has."""
        n = self.size[k]
        ends = np.cumsum(n, dtype=np.int64)
        return self.flat[np.repeat(self.start[k] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n

    def _forget(self) -> None:
        """Keeps the words that came in more than one part, unless those are too many as well."""
        keep = np.flatnonzero(self.used > 1)
        keep = keep[: len(keep) if len(keep) <= KNOWN // 2 else 0]
        (ids, n), index = self._ids(keep), self.index.only(keep)
        self._reset()
        self.index = index
        self._add(ids, n)

    def _learn(self, raw: bytes, at: np.ndarray, size: np.ndarray) -> None:
        """Ids of new words, the last of the index, encoded by the library's model in texts of a hundred."""
        stop = np.cumsum(size + 1)  # a space after each
        cut = np.frombuffer(raw + b" ", np.uint8).take(np.repeat(at - (stop - size - 1), size + 1) + np.arange(stop[-1]))
        cut[stop - 1] = 32
        cut = cut.tobytes()
        letters, bounds = cut.decode("latin-1").translate(_BYTES), [0, *stop[99:-1:100].tolist(), int(stop[-1])]
        coded = self.words_only.encode_batch_fast([letters[a : b - 1] for a, b in pairwise(bounds)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(size) or ends[-1] != len(ids):  # not cut as expected: one by one
            each = [x.ids for x in self.tokenizer.encode_batch(cut.decode().split(" ")[:-1], add_special_tokens=False)]
            ids, ends = np.array([i for x in each for i in x], dtype=np.uint32), np.cumsum([len(x) for x in each])
        self._add(ids, np.diff(ends, prepend=0))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts (no nulls) with the end id."""
        out: list[np.ndarray | None] = [None] * len(texts)
        other = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        for i in np.flatnonzero(other):
            out[i] = np.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32), np.uint32(END))
        plain = np.flatnonzero(~other)
        if len(plain):
            held = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[plain]) // PART_BYTES
            for part in np.split(plain, np.flatnonzero(np.diff(held)) + 1):
                for i, x in zip(part, self._encode(texts.take(pa.array(part))), strict=True):
                    out[i] = x
        return out

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.index) > KNOWN:
            self._forget()
        raw, at, size, each = words(texts)
        if not len(at):
            return [np.full(1, END, self.kind) for _ in range(len(texts))]
        number, new = self.index.numbers(raw, at, size)
        if len(new):
            self._learn(raw, at[new], size[new])
        self.used[number] += 1
        ids, n = self._ids(number)
        bounds = np.r_[0, np.cumsum(n, dtype=np.int64)][np.r_[0, np.cumsum(each)]]
        return [np.append(ids[a:b], ids.dtype.type(END)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def remembered(definition: str, by_word: bool) -> Tokens:
    """One tokenizer in a worker, so that words learned in a task serve the next ones."""
    return kept(("tokens", hash(definition), by_word), lambda: Tokens(definition, by_word))


#: Rows after which the Parquet writer looks whether a page is full: a row can be hundreds of kilobytes, and a page of a
#: hundred (Spark's least) stands in memory several times, also as a buffer of the codec.
_PAGES = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4}
_FILE = "shard int, unit long, doc_ids array<long>, lengths array<long>, blocks array<binary>"


def encode(docs: DataFrame, definition: str, by_word: bool, bits: int = 16) -> DataFrame:
    """(doc_id, text) to rows of the file format."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text")).withColumn("h", F.xxhash64("text"))
    d, n = ranged(d, "doc_id", F.octet_length("text"), SHARD_BYTES)
    d = d.repartition(max(1, -(-n // 4)), "pid").sortWithinPartitions("pid", F.col("doc_id").asc_nulls_first(), "h")
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = remembered(shared.value, by_word)
        units: list[tuple[int, int, list, list]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal units, held
            done, units, held = units, [], 0
            cut = []
            for u in done:
                ids = np.concatenate(u[3])
                cut.append([ids[i : i + rangecoder.BLOCK_IDS] for i in range(0, len(ids), rangecoder.BLOCK_IDS)])
            coded = iter(rangecoder.encode([b for c in cut for b in c], bits))
            blocks = [[next(coded) for _ in c] for c in cut]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([u[0] for u in done], pa.int32()),
                    pa.array([u[1] for u in done], pa.int64()),
                    pa.array([u[2] for u in done], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in u[3]] for u in done], pa.list_(pa.int64())),
                    pa.array(blocks, pa.list_(pa.binary())),
                ],
                names=["shard", "unit", "doc_ids", "lengths", "blocks"],
            )

        pid_now, unit_now, size = None, 0, 0
        for b in batches:
            pids, ids = (b.column(i).to_pylist() for i in range(2))
            for pid, doc_id, x in zip(pids, ids, tokens.encode(b.column(2)), strict=True):
                if pid != pid_now or size and size + len(x) > UNIT_IDS:  # a unit is one block, unless a text is longer
                    if held >= HELD_IDS or len(units) >= HELD_IDS // UNIT_IDS:
                        yield flush()
                    unit_now = unit_now + 1 if pid == pid_now else 0
                    pid_now, size = pid, 0
                    units.append((pid, unit_now, [], []))
                units[-1][2].append(doc_id)
                units[-1][3].append(x)
                size += len(x)
                held += len(x)
        if units:
            yield flush()

    return arrow_map(d.select("pid", "doc_id", "text"), run, _FILE, keeps=True)


def read(files: DataFrame) -> DataFrame:
    """Decoded documents: (shard, unit, place, doc_id, before: ids before it in its unit, ids: little-endian u32)."""

    names = ["shard", "unit", "doc_ids", "lengths", "blocks"]

    def decoded(units: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = iter(rangecoder.decode([x for *_, blocks in units for x in blocks]))
        for shard, unit, doc_ids, lengths, blocks in units:
            whole = np.concatenate([next(found) for _ in blocks]).astype("<u4")
            ends = np.cumsum(lengths)
            if int(ends[-1]) != len(whole):
                raise ValueError("a unit's lengths don't match its ids")
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * n, pa.int32()),
                    pa.array([unit] * n, pa.int64()),
                    pa.array(np.arange(n, dtype=np.int64)),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(np.r_[0, ends[:-1]].astype(np.int64)),
                    pa.array([x.tobytes() for x in np.split(whole, ends[:-1])], pa.binary()),
                ],
                names=["shard", "unit", "place", "doc_id", "before", "ids"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: list[tuple] = []
        for b in batches:
            for at in range(b.num_rows):  # bounded memory, full lockstep groups
                units.append(tuple(b.column(b.schema.get_field_index(c))[at].as_py() for c in names))
                if len(units) == READ_UNITS:
                    yield from decoded(units)
                    units.clear()
        if units:
            yield from decoded(units)

    return arrow_map(files.select(*names), run, "shard int, unit long, place long, doc_id long, before long, ids binary")


def starts(files: DataFrame) -> DataFrame:
    """(shard, unit, first): ids of all units before, from the files' lengths. Sums by shard first, so that the one
    window over everything has a row for each shard."""
    units = files.select("shard", "unit", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shard = units.groupBy("shard").agg(F.sum("n").alias("n"))
    shard = shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inner = units.withColumn("inner", F.sum("n").over(Window.partitionBy("shard").orderBy("unit")) - F.col("n"))
    return inner.join(shard, "shard").select("shard", "unit", (F.col("base") + F.col("inner")).alias("first"))


def definition(name: str = "word_bpe_49k.json", path: str | None = None) -> str:
    """The tokenizer's file, read on the driver; a broadcast takes it to the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the files, reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    files = written(encode(docs, definition(path=path), by_word=True), "tokens", **_PAGES)
    found = read(files).select("shard", "unit", "doc_id", "before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return found.join(starts(files), ["shard", "unit"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)

