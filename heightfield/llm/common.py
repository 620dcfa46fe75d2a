"""Shared parts: reading the tables, bounded Arrow batches, reliable intermediate tables, text as numpy arrays.

Texts are handled as UTF-8 bytes of an Arrow column, a few megabytes at a time, so that a task holds a
bounded block whatever the partition size; one text is never cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heightfield.plans.iterate import scratch_dir

# Rows a Python task is handed at once; texts are grouped again by bytes inside the task.
BATCH_ROWS = 1024
# Bytes of text that a task treats together (one longer text is treated alone).
BLOCK_BYTES = 2 << 20

# Fixed value: white space of the word contracts, [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold the Arrow batches of the session to ``rows`` rows: ten thousand long texts would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    folder = scratch_dir(df.sparkSession).rstrip("/")  # spark.checkpoint.dir, or in local mode one of our own
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """The same, bucketed by a key: joins on it read the table in place and exchange only their other side."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{scratch_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def crc_mod(column: str, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def text_of(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts and the offsets of each (null: empty)."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    buffers = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a block holds about ``size`` bytes of text, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_of(batch, column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Join small batches up to about ``size`` bytes of text, cutting larger ones."""
    held, total = [], 0
    for b in blocks(batches, size, column):
        n = int(text_of(b, column)[1][-1])
        if held and total + n > size:
            yield one(held)
            held, total = [], 0
        held.append(b)
        total += n
    if held:
        yield one(held)


def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of several batches as one batch."""
    if len(held) == 1:
        return held[0]
    t = pa.Table.from_batches(held).combine_chunks()
    return t.to_batches()[0]


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as long as the longest block so far."""

    base = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            n = 1 << int(n - 1).bit_length()
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
                                  for b in (self.base, inverse))
        return self.up, self.down


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, by differences of one running polynomial."""
    up, down = _POWERS.upto(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-space bytes inside a text, and the number of words before each text."""
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z: hashes, starts, ends, and where each text's words begin."""
    data = LOWER[data]
    starts, ends, at = word_spans(data, off)
    return spans_hash(data, starts, ends), starts, ends, at


_LETTERS: dict = {}


def letter_codes() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower-case code point (itself where that is not one letter)."""
    if not _LETTERS:
        n = 0x110000
        chars = [chr(c) for c in range(n)]
        letter = np.fromiter((c.isalpha() for c in chars), bool, n)
        lower = np.arange(n, dtype=np.uint32)
        for c in np.flatnonzero(letter):
            low = chars[c].lower()
            if len(low) == 1:
                lower[c] = ord(low)
        _LETTERS["letter"], _LETTERS["lower"] = letter, lower
    return _LETTERS["letter"], _LETTERS["lower"]


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and the offsets of each text in them."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, lead[off]


def extend(docs: DataFrame, work, fields: str, keep: list[str], need: tuple[str, ...] = ("text",)) -> DataFrame:
    """Add columns made from the text: ``work(batch)`` gets a bounded block and returns the arrays of ``fields`` in order.

    ``keep`` names the columns handed on; where one has the name of a new column, the new one stands.
    """
    spark = docs.sparkSession
    bounded(spark)
    new = fields.split(", ")  # "name type, name type", no blank inside a type
    names = [f.split()[0] for f in new]
    keep = [c for c in keep if c.lower() not in {n.lower() for n in names}]
    carried = list(dict.fromkeys([*keep, *need]))
    source = docs.select(*[F.col(f"`{c}`") for c in carried])
    kinds = dict(source.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *new])

    def run(batches):
        for block in blocks(batches):
            made = work(block)
            yield pa.RecordBatch.from_arrays([*(block.column(carried.index(c)) for c in keep), *made], names=[*keep, *names])

    return source.mapInArrow(run, schema)
