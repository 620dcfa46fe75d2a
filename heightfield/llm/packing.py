"""Best-fit packing of tokenised documents, with certified bin counts.

Documents are tokenised by a public tokenizer and only those longer than a sequence are cut.  Pieces are dealt into partitions of bounded
size; each runs best-fit decreasing and compares its number of sequences with lower bounds from dual-feasible functions.
A partition that meets its bound is proved optimal and done.  The others hand the contents of their loosest sequences
to a common pool, which is dealt out anew and packed again, as long as this saves sequences.

Defined results: null and empty text are one end token; repeated rows are packed each; an empty table gives no rows; a null doc_id
is carried along.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.llm import common as C

CAPACITY, END = 4096, 1
# Bytes of text tokenised together, words remembered per worker, and pieces packed by one task on average.
TOGETHER, REMEMBERED, PIECES = 4 << 20, 400_000, 32_768
# Rounds of exchange at most; fewer when a round saves nothing.
ROUNDS = 4

# White space at which a text may be divided before tokenising: the tokenizer drops it and no token spans it.
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0D]] = True
# Marks at the end of a word that the tokenizer takes apart from a letter or digit before them.
_MARK, _ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,!?;:"]] = True
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# Words of letters given to the tokenizer as one text.
_LINE = 256


def parts_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that are tokenised apart, and where each text's begin: words, and marks at their ends."""
    starts, ends, at = C.word_spans(data, off, _GAP)
    if not len(starts):
        return starts, ends, at
    body = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[ends - 1]  # the last byte that is no mark
    cut = (body >= starts) & (body < ends - 1) & _ALNUM[data[np.maximum(body, 0)]]
    place = np.flatnonzero(cut)
    new_ends = np.insert(ends, place, body[place] + 1)
    new_starts = np.insert(starts, place + 1, body[place] + 1)
    return new_starts, new_ends, np.searchsorted(new_starts, off)

PLACED = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


class Vocabulary:
    """Token ids of words by hash: those met before are looked up, only new words go to the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.last = np.zeros(max(words.values()) + 1, bool)  # ids that end a word
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.names = np.zeros(0, np.uint64)
        self.begin, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin among them and how many it has.

        Words of letters only are one unit of the tokenizer each; many of them go in one call, parted by blanks, and their
        ids are told apart by the ids that end a word.
        """
        letters = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        alone = np.flatnonzero(~letters).tolist()
        lines = np.array_split(np.flatnonzero(letters), -(-int(letters.sum()) // _LINE)) if letters.any() else []
        begin, sizes, pool, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in line]) for line in lines], add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            stop = np.flatnonzero(self.last[ids]) + 1
            if len(stop) != len(line) or stop[-1] != len(ids):  # a letter that lower case takes apart
                alone.extend(line.tolist())
                continue
            sizes[line] = np.diff(stop, prepend=0)
            begin[line] = total + stop - sizes[line]
            pool.append(ids)
            total += len(ids)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)]
        if rest:
            sizes[alone] = list(map(len, rest))
            begin[alone] = total + np.cumsum(sizes[alone]) - sizes[alone]
            pool.append(np.fromiter(chain.from_iterable(rest), np.int32))
        return (np.concatenate(pool) if pool else np.zeros(0, np.int32)), begin, sizes

    def ids(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text followed by the end id, and the offsets of the texts."""
        starts, ends, at = parts_of(data, off)
        names, first, which = np.unique(C.spans_hash(data, starts, ends), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.names, names)
        known = slot < len(self.names)
        known[known] = self.names[slot[known]] == names[known]
        fresh = np.flatnonzero(~known)
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())]
        flat, at_flat, sizes = self.encoded(texts)
        # one pool for this block: remembered ids, fresh ids, the end id
        size, begin = np.zeros(len(names) + 1, np.int64), np.zeros(len(names) + 1, np.int64)
        old = slot[known]
        size[:-1][known], begin[:-1][known] = self.begin[old + 1] - self.begin[old], self.begin[old]
        size[:-1][fresh], begin[:-1][fresh] = sizes, len(self.pool) + at_flat
        size[-1], begin[-1] = 1, len(self.pool) + len(flat)
        pool = np.concatenate([self.pool, flat, np.array([end], np.int32)])
        which = np.insert(which, at[1:], len(names))  # the end of each text
        count = size[which]
        before = np.concatenate([[0], np.cumsum(count)])
        out = pool[np.repeat(begin[which] - before[:-1], count) + np.arange(before[-1])]
        self.remember(names[fresh], at_flat, sizes, flat)
        return out, before[at + np.arange(len(at))]

    def remember(self, names: np.ndarray, at_flat: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        if not len(names) or len(self.names) + len(names) > REMEMBERED:
            return
        every = np.concatenate([self.names, names])
        order = np.argsort(every)
        size = np.concatenate([np.diff(self.begin), sizes])
        begin = np.concatenate([self.begin[:-1], len(self.pool) + at_flat])[order]
        pool, size = np.concatenate([self.pool, flat]), size[order]
        self.names, self.begin = every[order], np.concatenate([[0], np.cumsum(size)])
        self.pool = pool[np.repeat(begin - self.begin[:-1], size) + np.arange(self.begin[-1])]


_VOCABULARIES: dict[str, Vocabulary] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of its ids as little-endian unsigned 32-bit numbers)."""
    C.bounded(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        if path not in _VOCABULARIES:
            _VOCABULARIES[path] = Vocabulary(path)
        for block in C.gathered(batches, TOGETHER):
            ids, at = _VOCABULARIES[path].ids(*C.text_of(block), end)
            n = np.diff(at)
            parts = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(capacity, n[owner] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            lo = (at[owner] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + length * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PLACED.format(id=kind))


def best_fit(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and the fill of each bin."""
    order = np.argsort(-length, kind="stable")
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room they have
    open_rooms, made = 0, 0  # one bit for each room that some bin has
    for k, n in zip(order.tolist(), length[order].tolist()):
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b, made = capacity, made, made + 1
        bins[k], offset[k] = b, capacity - r
        if r > n:
            room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins, offset, np.bincount(bins, length, made).astype(np.int64)


def lower_bound(length: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of dual-feasible functions (thresholds up to half a bin, and roundings to k + 1 parts)."""
    if not len(length):
        return 0
    count = np.bincount(length, minlength=capacity + 1).astype(np.int64)
    many = np.concatenate([[0], np.cumsum(count)])  # pieces shorter than x at index x
    total = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    t = np.arange(capacity // 2 + 1)  # pieces over capacity - t take a bin, pieces under t none, the others their length
    large = many[-1] - many[capacity - t + 1]
    between = total[capacity - t + 1] - total[t]
    best = int((large + -(-between // capacity)).max())
    x = np.arange(capacity + 1)
    for k in range(1, 65):
        whole = (k + 1) * x % capacity == 0
        rounded = np.where(whole, k * x, (k + 1) * x // capacity * capacity)  # k * capacity times the function
        best = max(best, -(-int((count * rounded).sum()) // (k * capacity)))
    return best


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        length = group.column("length").to_numpy()
        bins, offset, fill = best_fit(length, capacity)
        certified = len(fill) <= lower_bound(length, capacity)
        # the loosest sequences go to the exchange: all but those whose room together is a small part of one sequence
        slack = capacity - fill
        order = np.argsort(slack, kind="stable")
        loose = np.ones(len(fill), bool)
        loose[order[np.cumsum(slack[order]) <= capacity // 8]] = False
        give = loose[bins] if not certified else np.zeros(len(bins), bool)
        out = group
        for name, values in (("bin", bins), ("offset", offset), ("give", give)):
            out = out.append_column(name, pa.array(values))
        return out

    return run


def _packed(held: DataFrame, capacity: int) -> DataFrame:
    """Deal rows (with a column u that tells them apart) into partitions of bounded size and pack each."""
    n = held.count()
    parts = -(-n // PIECES)
    columns = [c for c in held.columns if c not in ("part", "bin", "offset", "give")]
    dealt = held.select(*columns, F.pmod(F.xxhash64("u", F.lit(n)), F.lit(max(parts, 1))).alias("part"))
    schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", bin bigint, offset bigint, give boolean"
    return C.stored(dealt.groupBy("part").applyInArrow(_pack(capacity), schema), "packed")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (a stored table with a length) into sequences: adds sequence_id and offset."""
    held = _packed(cut.withColumn("u", F.monotonically_increasing_id()), capacity)
    done: list[DataFrame] = []
    for k in range(ROUNDS + 1):
        name = (F.lit(k).cast("long") * (1 << 58) + F.col("part") * (1 << 24) + F.col("bin")).alias("sequence_id")  # part and round name the run that made the bin
        pool = held.filter("give")
        was = pool.select("part", "bin").distinct().count()
        again = _packed(pool, capacity) if was > 1 and k < ROUNDS else None
        if again is None or again.select("part", "bin").distinct().count() >= was:
            done.append(held.select(*cut.columns, name, "offset"))
            break
        done.append(held.filter("NOT give").select(*cut.columns, name, "offset"))
        held = again
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document in its place."""
    return pack(C.stored(pieces(docs, path, capacity, end), "pieces"), capacity)
