"""Spelling variants: words of a corpus within one edit of a much commoner word.

The vocabulary stands in blocks: two words one edit apart share the first or the last half of their letters, so a word belongs to a
few blocks and meets no other words.  A block is a bit-sliced position index: for each position and letter a bitset of the block's words
that have the letter there.  A query word is read letter by letter; word-parallel recurrences hold the words matched without error and, shifted by
-1, 0 and +1 places, those matched with one error, for 64 words at a time and for all queries of a batch at once.  Blocks with more than
BLOCK words are split by the halves of what they do not share, until they fit.

Defined results: null text has no words; an occurrence in a row without doc_id is never altered; repeated rows count each; empty tables give no
rows; of near words of equal count the first in code-point order is the form; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.llm import common as C

# Shortest word, least occurrences, how much commoner a form is, and which occurrences lose a letter.
LEAST_LETTERS, LEAST_COUNT, TIMES, ALTERED = 6, 5, 5, 199
# Words of a block; entries of the index that a task builds at once.
BLOCK, ENTRIES = 8192, 1 << 23
# Bytes from which a run is summed by itself and not beside others.
LONG_RUN = 128


# --- vocabulary --------------------------------------------------------------------------------------------------------

def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)  # the reflected polynomial of crc32
    return c


_CRC = _crc_table()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every maximal run of A-Z, a-z and U+00C0 to U+00FF (in UTF-8 the byte C3 and one more)."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of every run, continued from the checksum of what stands before it."""
    state = seed ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    at = np.flatnonzero(size <= LONG_RUN)
    j = 0
    while len(at):
        state[at] = _CRC[(state[at] ^ data[starts[at] + j]) & 0xFF] ^ (state[at] >> 8)
        j += 1
        at = at[size[at] > j]
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > LONG_RUN):
        out[k] = zlib.crc32(data[starts[k]:ends[k]].tobytes(), int(seed[k]))
    return out


def _count(batch: pa.RecordBatch):
    """Words of a block of texts and how often each occurs, altered occurrences under their altered spelling."""
    data, off = C.text_of(batch)
    data = C.LOWER[data]
    starts, ends, doc = letter_runs(data, off)
    leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
    points = ends - starts - (leads[ends] - leads[starts])
    fits = points >= LEAST_LETTERS
    starts, ends, doc, points = starts[fits], ends[fits], doc[fits], points[fits]
    ids = batch.column("doc_id").to_pylist()
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    named = np.array([i is not None for i in ids], bool)
    h = _sums(data, starts, ends, seeds[doc])
    hit = (h % ALTERED == 0) & named[doc]
    text = data.tobytes()
    counts: dict[str, int] = {}
    for k in np.flatnonzero(hit):
        if points[k] > LEAST_LETTERS:
            run = text[starts[k]:ends[k]].decode()
            cut = int(h[k]) % len(run)
            word = run[:cut] + run[cut + 1:]
            counts[word] = counts.get(word, 0) + 1
    s, e = starts[~hit], ends[~hit]
    _, first, n = np.unique(C.spans_hash(data, s, e), return_index=True, return_counts=True)
    words = [text[a:b].decode() for a, b in zip(s[first], e[first], strict=True)]
    return pa.array(words + list(counts), pa.string()), pa.array(n.tolist() + list(counts.values()), pa.int64())


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with at least LEAST_COUNT occurrences."""
    C.bounded(docs.sparkSession)

    def run(batches):
        for block in C.gathered(batches, 4 * C.BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays(list(_count(block)), names=["word", "n"])

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# --- blocks ------------------------------------------------------------------------------------------------------------

def _halves(path, m, rest):
    """The two blocks of a word among words of which the shorter has ``m`` letters left: those of its first and last half."""
    h = F.floor(m / 2).cast("int")
    size = F.length(rest)
    return F.array(*[F.struct(F.concat(path, F.lit(side)).alias("path"), F.concat(F.lit(side), m.cast("string"), F.lit(":"), key).alias("key"),
                              (m - h).alias("m"), left.alias("rest"))
                     for side, key, left in (("p", F.substring(rest, F.lit(1), h), F.substring(rest, h + 1, size)),
                                             ("s", F.substring(rest, size - h + 1, h), F.substring(rest, F.lit(1), size - h)))])


def blocked(vocab: DataFrame) -> DataFrame:
    """word, n, and the block (key), with how it was reached (path) and the shorter length of its pairs (shorter).

    A word meets those of its own length and one more or one fewer; where a block is larger than BLOCK, its words meet in the
    halves of what they do not share instead.
    """
    size = F.length("word")
    rows = vocab.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= LEAST_LETTERS)).alias("m"))
    rows = rows.select("word", "n", F.col("m").alias("shorter"), F.explode(_halves(F.lit(""), F.col("m"), F.col("word"))).alias("b"))
    rows = C.stored(rows.select("word", "n", "shorter", "b.path", "b.key", "b.m", "b.rest"), "variant-blocks")
    done = None
    while True:
        large = C.stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("m").alias("m")).filter((F.col("c") > BLOCK) & (F.col("m") > 1)).select("key"), "variant-large")
        if not large.limit(1).count():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        split = rows.join(large, "key", "left_semi").withColumn("b", F.explode(_halves(F.col("path"), F.col("m"), F.col("rest"))))
        rows = C.stored(split.select("word", "n", "shorter", "b.path", F.concat("key", F.lit("|"), "b.key").alias("key"), "b.m", "b.rest"), "variant-blocks")


# --- the index ---------------------------------------------------------------------------------------------------------

def _first_meeting(x: str, y: str, path: str, m: int) -> bool:
    """Whether two words of a block meet in no block that comes before it."""
    for side in path:
        h = m // 2
        if side == "s":
            if x[:h] == y[:h]:
                return False
            x, y = x[:-h], y[:-h]
        else:
            x, y = x[h:], y[h:]
        m -= h
    return True


class Index:
    """Bit-sliced positions of the words of some blocks; each block begins at a word of 64 bits of its own."""

    def __init__(self, words: list[str], blocks: list[tuple[int, int]]):
        self.words = words
        n = len(words)
        self.size = np.array([len(w) for w in words])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(letters, return_inverse=True)
        self.slot, self.first, self.width = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        for lo, hi in blocks:
            wide = -(-(hi - lo) // 64)
            self.slot[lo:hi] = at * 64 + np.arange(hi - lo)
            self.first[lo:hi], self.width[lo:hi] = at, wide
            at += wide
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.codes = codes.astype(np.int64)
        long = int(self.size.max())
        # bits[place, letter, w]: the words with the letter at the place; one place before the first and two after the last hold none
        self.bits = np.zeros((long + 3, len(self.alphabet), at), np.uint64)
        word = np.repeat(np.arange(n), self.size)
        place = np.arange(len(codes)) - np.repeat(self.at[:-1], self.size) + 1
        bit = np.uint64(1) << (self.slot % 64).astype(np.uint64)
        np.add.at(self.bits, (place, self.codes, self.slot[word] // 64), bit[word])
        self.of_size = np.zeros((long + 3, at), np.uint64)
        np.add.at(self.of_size, (self.size, self.slot // 64), bit)
        self.word_at = np.full(at * 64, -1, np.int64)
        self.word_at[self.slot] = np.arange(n)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) one edit apart, for queries (numbers of words) of one length and one block width."""
        m, wide = int(self.size[queries[0]]), int(self.width[queries[0]])
        w = self.first[queries][:, None] + np.arange(wide)[None, :]
        exact = np.zeros(w.shape, np.uint64)
        for k in range(len(self.of_size)):
            exact |= self.of_size[k][w]
        same = np.zeros(w.shape, np.uint64)
        fewer, more = same.copy(), same.copy()
        for i in range(m):
            letter = self.codes[self.at[queries] + i][:, None]
            before, here, after = (self.bits[i + d, letter, w] for d in (0, 1, 2))
            same = (same & here) | (exact & ~here)
            fewer = (fewer & before) | exact
            more = (more | exact) & after
            exact &= here
        of = self.of_size
        found = (same & of[m][w]) | (fewer & of[m - 1][w]) | ((more | exact) & of[m + 1][w])
        q, x = np.nonzero(found)
        bits = np.unpackbits(found[q, x].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, b = np.nonzero(bits)
        return queries[q[r]], self.word_at[w[q[r], x[r]] * 64 + b]


def _batches(keys: np.ndarray, sizes: np.ndarray):
    """Blocks of at least two words, several together while their index stays small: lists of (start, end)."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
    held, wide, long = [], 0, 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if b - a < 2:
            continue
        w, size = -(-(b - a) // 64), int(sizes[a:b].max())
        if held and (wide + w) * max(long, size) * 64 > ENTRIES:
            yield held
            held, wide, long = [], 0, 0
        held.append((a, b))
        wide, long = wide + w, max(long, size)
    if held:
        yield held


def _search(table: pa.Table):
    """Near words of all words of whole blocks: (word, n_near, form_n, form), the commonest near word of each beside their number."""
    word, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    path, shorter = table.column("path").to_pylist(), table.column("shorter").to_numpy()
    keys = table.column("key").to_numpy(zero_copy_only=False)
    size = np.array([len(w) for w in word])
    best: dict[int, list] = {}
    for blocks in _batches(keys, size):
        rows = np.concatenate([np.arange(a, b) for a, b in blocks])
        ends = np.cumsum([b - a for a, b in blocks])
        index = Index([word[r] for r in rows], list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)))
        for kind in np.unique(np.stack([index.size, index.width], 1), axis=0):
            queries = np.flatnonzero((index.size == kind[0]) & (index.width == kind[1]))
            step = max(1, (1 << 18) // int(kind[1]))
            for lo in range(0, len(queries), step):
                for q, w in zip(*index.near(queries[lo:lo + step]), strict=True):
                    a, b = int(rows[q]), int(rows[w])
                    if min(size[a], size[b]) != shorter[a] or not _first_meeting(word[a], word[b], path[a], int(shorter[a])):
                        continue
                    held = best.setdefault(a, [0, 0, ""])
                    held[0] += 1
                    if n[b] > held[1] or (n[b] == held[1] and word[b] < held[2]):
                        held[1:] = [int(n[b]), word[b]]
    return pa.RecordBatch.from_arrays([pa.array([word[a] for a in best], pa.string()), *(pa.array([v[k] for v in best.values()], kind) for k, kind in
                                                                                          ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))],
                                      names=["word", "n_near", "form_n", "form"])


def _whole_blocks(batches):
    """Rows in the order of their blocks, cut only between blocks, some 32,768 rows at a time."""
    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows >= 32_768:
            whole = pa.Table.from_batches([*held, b])
            keys = whole.column("key").to_numpy()
            change = np.flatnonzero(keys[1:] != keys[:-1])
            to = int(change[-1]) + 1 if len(change) else 0
            if to:
                yield whole.slice(0, to).combine_chunks()
                held, rows = whole.slice(to).to_batches(), whole.num_rows - to
                continue
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of every word with a near word: how many, and the commonest of them."""
    rows = blocked(vocab)
    dealt = rows.select("word", "n", "path", "shorter", "key").repartition("key").sortWithinPartitions("shorter", "key")

    def run(batches):
        for table in _whole_blocks(batches):
            yield _search(table)

    found = dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    vocab = C.stored(vocabulary(docs), "variant-words")
    near = near_words(vocab)
    far = F.col("form_n") >= TIMES * F.col("n")
    known = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("form")).alias("form"),
                                                    F.when(far, F.col("form_n")).alias("form_n"))
    known = C.stored(known, "variant-forms")
    links = known.filter("form is not null").select("word", F.col("form").alias("root"))
    # every step multiplies the count, so a chain has at most log(n) steps; each round doubles what a link spans
    most = vocab.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most / LEAST_COUNT, 1)) / math.log(TIMES)))
    for _ in range(math.ceil(math.log2(steps))):
        then = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = C.stored(links.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    return known.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
