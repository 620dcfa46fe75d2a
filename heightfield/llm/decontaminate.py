"""Documents that hold a benchmark item, also with words added, dropped or changed.

Words (letters and digits, lower case) are the symbols.  The random walk of Chakraborty, Goldenberg and Koucky maps edit distance to Hamming
distance: a window is read from its start, each step writes the current word and moves on or stays by a random bit of that word.
Repetitions with fresh bits each sample two places of the walk as a bucket key; a window of a document that shares
a bucket with an item of its size is a candidate, and the edit distance to the whole item decides.

Windows stand at every word, up to the last of a text, and have the size of the items' size class (sizes a quarter apart; an item takes the
largest class within it); where the text ends first, so does the window.  Windows with too few words, or pairs of neighbouring words, that
occur in any item are passed over without loss: each edit spoils one word and two pairs, so they are further from every item than
the limit.  Repetitions go on until items edited at random, as much as the limit allows, in running text and at the end of a
text, are found with the wanted recall; no number of them is a cap.

Edits that stand close together, as where the first words of an item are gone, put a walk out of step for good.  An exact completion finds those:
an item that may have k edits is cut into k + 1 pieces, one of which every text within the limit holds word by word.
Windows and pieces with too few words of the item around them are further away than the limit.

Defined results: null, empty and wordless texts and items match nothing; items under eight words must match word by word, since an edit
in so few words leaves common phrases; a document that holds an item several times is reported with the closest place (the first of
equals); repeated rows are reported each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heightfield.llm import common as C

# Edits per word that still count as the item, for items of at least SHORT words.
RATE, SHORT = 0.25, 8
# Sampled places of one repetition, the share of the walk they lie in by turns, and the recall to reach on edited copies.
SAMPLED, REACH, RECALL, COPIES, LEAST = 2, (0.35, 0.6, 0.85), 0.999, 256, 6
# Items looked for in one pass over the documents, and words (or candidates) searched together.
ITEMS, TOGETHER = 8192, 1_000_000

_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text and where each text's begin."""
    data = C.LOWER[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1  # capitals of two bytes
    data[upper] += 0x20
    starts, ends, at = C.word_spans(data, off, _BREAK)
    return C.spans_hash(data, starts, ends), at


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words."""
    count = max(len(x) - n + 1, 0)
    key = np.full(count, np.uint64(n), np.uint64)
    for k in range(n):
        key = C.mix(key * np.uint64(0x9FB21C651E98DF25) + x[k:k + count])
    return key


def pairs(x: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return C.mix(x[:-1] * np.uint64(0x9FB21C651E98DF25) + x[1:])


def walk(x: np.ndarray, start: np.ndarray, stop: np.ndarray, salt: int, places: np.ndarray) -> np.ndarray:
    """Bucket keys: the words that the walk from each start writes at the sampled places (nothing beyond its stop)."""
    pos = start.copy()
    key = np.full(len(start), np.uint64(salt), np.uint64)
    sampled = set(places.tolist())
    for step in range(int(places[-1]) + 1):
        word = np.where(pos < stop, x[np.minimum(pos, len(x) - 1)], np.uint64(0))
        if step in sampled:
            key = C.mix(key * np.uint64(0x9FB21C651E98DF25) + word)
        odd = np.uint64((salt * (2 * step + 1) | 1) & 0xFFFFFFFFFFFFFFFF)
        pos += ((word * odd) >> np.uint64(63)).astype(np.int64)
    return key


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start up to its stop, and which start each belongs to."""
    n = stop - start
    who = np.repeat(np.arange(len(n)), n)
    return np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + start[who], who


def limit(n: int) -> int:
    return int(RATE * n) if n >= SHORT else 0


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and any stretch of the text, and the end of the first such stretch."""
    col = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, w in enumerate(item):
        step = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        step = np.concatenate([[k + 1], step])
        row = np.minimum.accumulate(step - col) + col
    end = int(np.argmin(row))
    return int(row[end]), end


class Index:
    """Buckets of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        data = [t.encode("utf-8", "surrogatepass") for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        self.words, self.at = word_hashes(np.frombuffer(b"".join(data), np.uint8), off) if items else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.ids = [i for i, _ in items]
        self.size = np.diff(self.at)
        self.most = np.array([limit(n) for n in self.size.tolist()], np.int64)
        self.member = np.zeros(1 << 22, bool)
        self.member[self.own(self.words, np.repeat(np.arange(len(self.size)), self.size))] = True
        self.seen, self.beside = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        self.seen[self.words >> np.uint64(44)] = True
        self.beside[pairs(self.words) >> np.uint64(44)] = True
        ladder = [1]
        while self.size.size and ladder[-1] < self.size.max():
            ladder.append(max(ladder[-1] + 1, int(ladder[-1] * 1.25)))
        rung = np.searchsorted(ladder, self.size, side="right") - 1
        self.classes = []
        for c in np.unique(rung[self.size > 0]).tolist():
            mine, width = np.flatnonzero(rung == c), ladder[c]
            buckets = []
            for salt, places in self.repetitions(mine, width):
                key = walk(self.words, self.at[mine], self.at[mine] + width, salt, places)
                order = np.argsort(key, kind="stable")
                buckets.append((salt, places, key[order], mine[order]))
            self.classes.append((width, int(self.most[mine].max()), buckets))
        full = np.flatnonzero(self.size)
        part, which = ranges(np.zeros(len(full), np.int64), self.most[full] + 1)
        owner = full[which]
        first = part * self.size[owner] // (self.most[owner] + 1)
        length = (part + 1) * self.size[owner] // (self.most[owner] + 1) - first
        self.pieces = []
        for n in np.unique(length).tolist():
            mine = length == n
            key = grams(self.words, n)[self.at[owner[mine]] + first[mine]]
            order = np.argsort(key, kind="stable")
            held = np.zeros(1 << 20, bool)
            held[key >> np.uint64(44)] = True
            self.pieces.append((n, held, key[order], owner[mine][order], first[mine][order]))

    def repetitions(self, mine: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
        """Salts and places: as many as edited copies of the items need for the recall."""
        rng = np.random.default_rng(width)
        chosen = mine[rng.integers(0, len(mine), COPIES)]
        flat, begin, end = [], [], []
        for k, i in enumerate(chosen.tolist()):
            w = self.words[self.at[i]:self.at[i] + width].tolist()
            for _ in range(int(self.most[i])):
                p, kind = int(rng.integers(0, max(len(w), 1))), int(rng.integers(0, 3))
                w[p:p + (kind > 0)] = [int(rng.integers(1, 1 << 62))] if kind < 2 else []
            more = rng.integers(1, 1 << 62, width).tolist() if k % 2 else []  # every other copy ends its text
            begin.append(len(flat))
            end.append(len(flat) + min(width, len(w) + len(more)))
            flat += w + more
        flat, begin, end = np.array(flat + [0], np.uint64), np.array(begin), np.array(end)
        out, missed = [], np.ones(COPIES, bool)
        while len(out) < LEAST or missed.mean() > 1 - RECALL:
            salt = int(rng.integers(1, 1 << 62))
            upto = max(int(2 * width * REACH[len(out) % len(REACH)]), SAMPLED)
            bounds = np.linspace(0, upto, SAMPLED + 1).astype(int)  # one place in each part
            places = np.array([int(rng.integers(a, b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            out.append((salt, places))
            missed &= walk(flat, begin, end, salt, places) != walk(self.words, self.at[chosen], self.at[chosen] + width, salt, places)
        return out

    @staticmethod
    def own(words: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Place of a word of an item among the members."""
        return C.mix(words + item.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(42)

    def candidates(self, x: np.ndarray, at: np.ndarray):
        """Texts, items and stretches (from, to) around each window that shares a bucket with an item and has enough of its words."""
        known = np.concatenate([[0], np.cumsum(self.seen[x >> np.uint64(44)])])
        beside = np.concatenate([[0], np.cumsum(self.beside[pairs(x) >> np.uint64(44)]), [0]])
        last = np.repeat(at[1:], np.diff(at))  # end of the text that holds each word
        for width, slack, buckets in self.classes:
            start = np.arange(len(x))
            stop = np.minimum(start + width, last)
            # within the limit, all but ``slack`` words and all but twice as many neighbouring pairs occur in the item
            start = start[known[stop] - known[start] >= width - slack]
            stop = stop[start]
            held = beside[stop - 1] - beside[start] >= width - 1 - 2 * slack
            start, stop = start[held], stop[held]
            if not len(start):
                continue
            met, new, waiting = np.zeros(0, np.int64), [], 0  # an item and a window in one number
            for salt, places, keys, owners in buckets:
                key = walk(x, start, stop, salt, places)
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                hits = np.flatnonzero(hi > lo)
                upto = np.concatenate([[0], np.cumsum((hi - lo)[hits])])
                for a in range(0, int(upto[-1]), TOGETHER):
                    hit = np.arange(a, min(a + TOGETHER, int(upto[-1])))
                    who = np.searchsorted(upto, hit, side="right") - 1
                    pair = owners[hit - upto[who] + lo[hits[who]]] << 40 | start[hits[who]]
                    new.append(pair)
                    waiting += len(pair)
                    if waiting > TOGETHER:  # most repetitions meet the same pairs
                        met, new, waiting = np.unique(np.concatenate([met, *new])), [], 0
            met = np.unique(np.concatenate([met, *new]))
            for a in range(0, len(met), TOGETHER):
                item, here = met[a:a + TOGETHER] >> 40, met[a:a + TOGETHER] & ((1 << 40) - 1)
                text = np.searchsorted(at, here, side="right") - 1
                begin = np.maximum(at[text], here - self.most[item])
                end = np.minimum(at[text + 1], here + self.size[item] + self.most[item])
                enough = self.enough(x, item, begin, end)
                yield np.stack([text[enough], item[enough], begin[enough], end[enough]])

    def completion(self, x: np.ndarray, at: np.ndarray):
        """The same around each place of a piece of an item: what the walks can miss, where edits stand close together."""
        last = np.repeat(at[1:], np.diff(at))  # end of the text that holds each word
        for n, held, keys, owners, firsts in self.pieces:
            key = grams(x, n)
            place = np.flatnonzero(held[key >> np.uint64(44)])
            place = place[place + n <= last[place]]
            lo, hi = np.searchsorted(keys, key[place], "left"), np.searchsorted(keys, key[place], "right")
            place, lo, hi = place[hi > lo], lo[hi > lo], hi[hi > lo]
            upto = np.concatenate([[0], np.cumsum(hi - lo)])
            for a in range(0, int(upto[-1]), TOGETHER):
                hit = np.arange(a, min(a + TOGETHER, int(upto[-1])))
                who = np.searchsorted(upto, hit, side="right") - 1
                piece = hit - upto[who] + lo[who]
                item, start = owners[piece], place[who] - firsts[piece]
                text = np.searchsorted(at, place[who], side="right") - 1
                order = np.lexsort((start, item, text))
                text, item, start = text[order], item[order], start[order]
                new = np.ones(len(text), bool)
                new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(start) != 0)
                text, item, start = text[new], item[new], start[new]
                begin = np.maximum(at[text], start - self.most[item])
                stop = np.minimum(at[text + 1], start + self.size[item] + self.most[item])
                enough = self.enough(x, item, begin, stop)
                yield np.stack([text[enough], item[enough], begin[enough], stop[enough]])

    def enough(self, x: np.ndarray, item: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether a stretch has as many words of the item as the limit asks for."""
        out = np.zeros(len(item), bool)
        group = (np.cumsum(stop - begin) - (stop - begin)) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(item)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            at, who = ranges(begin[a:b], stop[a:b])
            count = np.bincount(who[self.member[self.own(x[at], item[a:b][who])]], minlength=b - a)
            out[a:b] = count >= self.size[item[a:b]] - self.most[item[a:b]]
        return out

    def search(self, x: np.ndarray, at: np.ndarray, complete: bool = True) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item): (distance, first word, words) of the closest place, for all pairs within the limit."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        spots = [*self.candidates(x, at), *(self.completion(x, at) if complete else ())]
        if not spots:
            return found
        spots = np.unique(np.concatenate(spots, axis=1), axis=1)
        spots = spots[:, np.lexsort((spots[2], spots[1], spots[0]))]
        # stretches of one text and item that touch are looked at once
        joined: list[list[int]] = []
        for t, i, lo, hi in spots.T.tolist():
            if joined and joined[-1][:2] == [t, i] and lo <= joined[-1][3]:
                joined[-1][3] = max(joined[-1][3], hi)
            else:
                joined.append([t, i, lo, hi])
        for t, i, lo, hi in joined:
            item, most = self.words[self.at[i]:self.at[i + 1]], int(self.most[i])
            if np.count_nonzero(np.isin(item, x[lo:hi])) < len(item) - most:  # more words are missing than edits allowed
                continue
            d, end = distance(item, x[lo:hi])
            if d > most:
                continue
            _, back = distance(item[::-1], x[lo:lo + end][::-1])
            begin = lo + end - back
            now = (d, begin - int(at[t]), back)
            if (t, i) not in found or now < found[t, i]:
                found[t, i] = now
        return found


_INDEXES: dict[str, Index] = {}


def index(items: list[tuple[int, str]]) -> Index:
    key = hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items)
    return _INDEXES[key]


def item_blocks(benchmark: DataFrame):
    """The items, ITEMS or so at a time, on the driver: a stated query set in blocks of bounded size."""
    items = benchmark.filter(F.col("item_id").isNotNull() & (F.length(F.trim("text")) > 0)).select("item_id", "text")
    blocks = -(-items.count() // ITEMS)
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance (edits in words), first_word, n_words, item_words of every document and item it holds."""
    C.bounded(docs.sparkSession)
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, first_word int, n_words int, item_words int"
    out = None
    for items in item_blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(_reporter(items, to_arrow_type(benchmark.schema["item_id"].dataType)), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _many(batches):
    """Blocks of rows with about TOGETHER words, their words, and where each text's begin."""
    held, size = [], 0
    for block in C.blocks(batches):
        x, at = word_hashes(*C.text_of(block))
        held.append((block, x, at))
        size += len(x)
        if size >= TOGETHER:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    before = np.cumsum([0, *(len(x) for _, x, _ in held)])
    at = np.concatenate([np.zeros(1, np.int64), *(a[1:] + n for (_, _, a), n in zip(held, before))])
    return C.one([b for b, _, _ in held]), np.concatenate([x for _, x, _ in held]), at


def _reporter(items, item_type):
    def run(batches):
        ix = index(items)
        for block, x, at in _many(batches):
            hits = sorted(ix.search(x, at).items())
            rows = pa.array([t for (t, _), _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(rows), pa.array([ix.ids[i] for (_, i), _ in hits], item_type),
                 *(pa.array([v[k] for _, v in hits], pa.int32()) for k in range(3)),
                 pa.array([int(ix.at[i + 1] - ix.at[i]) for (_, i), _ in hits], pa.int32())],
                names=["doc_id", "item_id", "distance", "first_word", "n_words", "item_words"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    C.bounded(docs.sparkSession)
    for items in item_blocks(benchmark):
        def without(batches, items=items):
            ix = index(items)
            for block, x, at in _many(batches):
                stay = np.ones(block.num_rows, bool)
                stay[[t for t, _ in ix.search(x, at)]] = False
                yield block.filter(pa.array(stay))

        docs = docs.mapInArrow(without, docs.schema)
    return docs
