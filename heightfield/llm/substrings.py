"""Passages that repeat word for word: prefix-partitioned suffix trees over words.

Equal texts stand as one, under their smallest doc_id.  Suffixes begin at sampled words: of the prefixes of PREFIX words inside a window the one
of least hash is its anchor, so equal windows have equal anchors at equal places, and every window hangs on one suffix.  Suffixes are
split by their prefixes: a prefix that stands once in the corpus ends there; one with up to HEAVY suffixes is a group; a more frequent
one is made longer, up to the whole window, so that groups stay memory-sized whatever a passage's frequency.  Each group is a
subtree whose leaves carry, as hashes, the paths down to the depth of a window; its internal nodes at that depth are the repeated windows, and
windows that follow each other in a text make up the maximal repeats.  All but a node's first leaf are repeats of earlier text.

What is known inside a task (a prefix or a window it has seen before) is settled there and not sent on to the group.

The position of a window is (doc_id, word).  Defined results: a null text has no words; a null doc_id stands before all others; rows of one doc_id
are equal in rank, so a window is a repeat only if it starts at a smaller id or, within the id, at a smaller word; texts with fewer words than a
window keep all; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.llm import common as C

# Words of a window and of a suffix's first prefix.
WINDOW, PREFIX = 20, 10
# Suffixes from which a prefix is made longer.
HEAVY = 50_000
# Bytes of text a task looks at together; rows of groups it sorts together.
TEXT_BYTES, GROUP_ROWS = 8 << 20, 65_536

_LOW = np.int64(0xFFFFFFFF)
# Bytes of a window's path in a leaf: what the prefix leaves open is told apart by 40 bits more.
_PATH = 5


class Words:
    """Word hashes of a block of texts, its windows and the anchors they hang on."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, self.off = C.text_of(batch)
        self.start, self.end, self.at = C.word_spans(self.data, self.off)
        n = len(self.start)
        h = C.spans_hash(self.data, self.start, self.end)
        up, down = C._POWERS.upto(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=run[1:])
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self._run, self._down = run, down
        first = np.arange(max(0, n - WINDOW + 1))
        first = first[self.doc[first] == self.doc[first + WINDOW - 1]] if n else first
        prefix = self.gram(np.arange(max(0, n - PREFIX + 1)), PREFIX)
        anchor = _least(prefix, WINDOW - PREFIX + 1)[first] if len(first) else first
        # windows of one anchor follow each other
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        self.anchor, self.prefix = anchor[new], prefix[anchor[new]]
        self.first, self.count = first[new], np.diff(np.append(new, len(anchor)))

    def gram(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the ``k`` words from each of the given words."""
        return C.mix((self._run[at + k] - self._run[at]) * self._down[at] + np.uint64(k))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value among each ``width`` neighbours."""
    at, span = np.arange(len(v)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(v[right] < v[left], right, left)
        span += step
    return at


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _name(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The 96 bits that name a text: 64, and 32 in the upper half of a long."""
    return batch.column("k1").to_numpy(), batch.column("k2").to_numpy().astype(np.int64) << 32


def _blocks(batches):
    return C.gathered(batches, TEXT_BYTES)


# --- prefixes ----------------------------------------------------------------------------------------------------------

def _prefixes(batches):
    """One row per suffix: its prefix, its text and place.  Of a prefix that a block holds several times the first goes to the prefix's
    partition with their number; the others, known to repeat, go anywhere."""
    for block in _blocks(batches):
        w = Words(block)
        k1, k2 = _name(block)
        doc = w.doc[w.anchor]
        place = k2[doc] | (w.anchor - w.at[doc])
        _, first, inverse, n = np.unique(w.prefix, return_index=True, return_inverse=True, return_counts=True)
        number = np.zeros(len(w.prefix), np.int64)
        number[first] = n
        route = np.where(number > 0, w.prefix, C.mix(k1[doc].view(np.uint64) + place.astype(np.uint64)))
        yield pa.RecordBatch.from_arrays([_longs(route), _longs(w.prefix), _longs(k1[doc]), _longs(place), pa.array(number)], names=["route", "prefix", "k1", "place", "n"])


def _tables(batches, rows: int):
    """Batches joined to about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _repeated(batches):
    """Suffixes whose prefix stands more than once, from a stream sorted by route: a neighbour of one has it too.

    The last row of a table waits for the next one.
    """
    def repeated(t: pa.Table):
        yield from t.select(["prefix", "k1", "place"]).filter(pa.array(t.column("n").to_numpy() != 1)).to_batches()

    wait = None
    for t in _tables(batches, GROUP_ROWS):
        t = t if wait is None else pa.concat_tables([wait, t]).combine_chunks()
        route, n = t.column("route").to_numpy(), t.column("n").to_numpy().copy()
        same = (route[1:] == route[:-1]) & (n[1:] > 0) & (n[:-1] > 0)
        both = np.append(same, False) | np.append(False, same)
        n[both] = np.maximum(n[both], 2)
        t = t.set_column(t.schema.get_field_index("n"), "n", pa.array(n))
        yield from repeated(t.slice(0, len(n) - 1))
        wait = t.slice(len(n) - 1)
    if wait is not None:
        yield from repeated(wait)


def _frequent(batches):
    """Prefixes of at least HEAVY suffixes, from the same stream; they number at most a HEAVY-th of all suffixes."""
    held, total = None, 0
    for t in _tables(batches, GROUP_ROWS):
        n = t.column("n").to_numpy()
        route, n = t.column("route").to_numpy()[n > 0], n[n > 0]
        if not len(n):
            continue
        first = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
        names, sums = route[first], np.add.reduceat(n, first)
        if held is not None and names[0] == held:
            sums[0] += total
        elif total >= HEAVY:
            names, sums = np.append(held, names), np.append(total, sums)
        held, total = names[-1], int(sums[-1])
        frequent = names[:-1][sums[:-1] >= HEAVY]
        if len(frequent):
            yield pa.RecordBatch.from_arrays([pa.array(frequent)], names=["prefix"])
    if total >= HEAVY:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64())], names=["prefix"])


# --- subtrees ----------------------------------------------------------------------------------------------------------

_LEAF = "key long, doc_id long, k1 long, place long, open int, repeats int, paths binary"


def _leaves(batches):
    """Leaves of the subtrees: for each suffix with a repeated prefix the windows that hang on it, as bits of ``open`` (its anchor is the
    window's word of that number) with a path each.  A window the block holds already at a smaller position is a repeat at once.

    A frequent prefix is made longer to the whole window, which makes a key of its own.
    """
    for block in _blocks(batches):
        w = Words(block)
        k1, k2 = _name(block)
        spots = block.column("spots")
        spot = spots.flatten().to_numpy()
        at = np.repeat(w.at[:-1], np.asarray(spots.value_lengths())) + (spot >> 1)
        chosen, heavy = np.zeros(len(w.start) + 1, bool), np.zeros(len(w.start) + 1, bool)
        chosen[at], heavy[at] = True, (spot & 1).astype(bool)
        mine = np.flatnonzero(chosen[w.anchor])
        count = w.count[mine]
        row = np.repeat(np.arange(len(mine)), count)
        first = w.first[mine][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        anchor = w.anchor[mine]
        doc = w.doc[anchor]
        path = w.gram(first, WINDOW)
        ids = block.column("lead")
        rank = _ranks(ids)
        position = rank[doc][row] << 32 | first - w.at[doc][row]
        repeat = _later(path, position)
        bit = np.int64(1) << (anchor[row] - first)
        repeats = np.bincount(row, np.where(repeat, bit, 0), len(mine)).astype(np.int64)
        place = k2[doc] | (anchor - w.at[doc])
        name = k1[doc]
        # settled suffixes go anywhere, frequent prefixes window by window, others as one leaf
        big = heavy[anchor]
        still = np.bincount(row, ~repeat, len(mine)).astype(np.int64)
        single = np.flatnonzero(~repeat & big[row])
        normal = np.flatnonzero(~repeat & ~big[row])
        settled = np.flatnonzero((repeats > 0) & (big | (still == 0)))
        one = np.flatnonzero(~big & (still > 0))
        opens = np.bincount(row[normal], bit[normal], len(mine)).astype(np.int64)
        raw = path.view(np.uint8).reshape(-1, 8)[:, :_PATH]
        nothing = np.zeros(0, np.uint8)
        for key, r, open_, rep, paths, size in (
                (w.prefix[mine][one], one, opens[one], repeats[one], raw[normal], still[one]),
                (C.mix(path[single] ^ w.prefix[mine][row[single]]), row[single], bit[single], np.zeros(len(single), np.int64), raw[single], np.ones(len(single), np.int64)),
                (C.mix(name[settled].view(np.uint64) + place[settled].astype(np.uint64)), settled, np.zeros(len(settled), np.int64), repeats[settled], nothing, np.zeros(len(settled), np.int64))):
            if len(r):
                ends = np.concatenate([[0], np.cumsum(size * _PATH)]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(paths).tobytes())])
                yield pa.RecordBatch.from_arrays([_longs(key), ids.take(pa.array(doc[r])), pa.array(name[r]), pa.array(place[r]), pa.array(open_.astype(np.int32)),
                                                  pa.array(rep.astype(np.int32)), blob], names=["key", "doc_id", "k1", "place", "open", "repeats", "paths"])


def _ranks(ids: pa.Array) -> np.ndarray:
    """Order of the ids among themselves, null first; equal ids have equal ranks."""
    known = np.asarray(ids.is_valid())
    rank = np.zeros(len(ids), np.int64)
    if known.any():
        rank[known] = np.unique(ids.drop_null().to_numpy(), return_inverse=True)[1] + 1
    return rank


def _later(node: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Members of each node that do not stand at its least position."""
    if not len(node):
        return np.zeros(0, bool)
    order = np.argsort(node, kind="stable")
    sorted_ = node[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    least = np.minimum.reduceat(position[order], np.flatnonzero(first))
    out = np.empty(len(node), bool)
    out[order] = position[order] > least[np.cumsum(first) - 1]
    return out


def _subtrees(batches):
    """Repeats among the leaves of whole subtrees, read in the order of key, id and place: (k1, place, repeats).

    A subtree longer than a table goes on in the next with one leaf per node, its first.
    """
    carried = None
    for t in _tables(batches, GROUP_ROWS):
        old = 0 if carried is None else carried.num_rows
        t = t if carried is None else pa.concat_tables([carried, t]).combine_chunks()
        key, open_ = t.column("key").to_numpy(), t.column("open").to_numpy().astype(np.int64)
        bits = (open_[:, None] >> np.arange(WINDOW - PREFIX + 1)[None, ::-1]) & 1  # windows stand in the order of their first words
        row, k = np.nonzero(bits)
        blob = t.column("paths").combine_chunks()
        raw = np.frombuffer(b"".join(blob.to_pylist()), np.uint8).reshape(-1, _PATH)
        path = np.zeros((len(raw), 8), np.uint8)
        path[:, :_PATH] = raw
        number = (WINDOW - PREFIX) - k
        path[:, _PATH] = number
        node = C.mix(path.view(np.uint64)[:, 0] ^ C.mix(key[row].view(np.uint64)))
        rank = _ranks(t.column("doc_id").combine_chunks())
        word = t.column("place").to_numpy() & _LOW
        later = _later(node, rank[row] << 32 | word[row] - number)
        found = np.bincount(row, np.where(later, 1 << number, 0), t.num_rows).astype(np.int64)
        repeats = found | t.column("repeats").to_numpy()
        repeats[:old] = 0
        hit = np.flatnonzero(repeats)
        if len(hit):
            yield pa.RecordBatch.from_arrays([t.column("k1").combine_chunks().take(pa.array(hit)), t.column("place").combine_chunks().take(pa.array(hit)),
                                              pa.array(repeats[hit])], names=["k1", "place", "repeats"])
        # the last subtree may go on: its first leaves stay
        going = np.zeros(t.num_rows, bool)
        going[row[~later]] = True
        carried = t.filter(pa.array(going & (key == key[-1])))


# --- texts -------------------------------------------------------------------------------------------------------------

def _removals(batches):
    """Words of every text, the stretches to remove, and the digest of what is left; for copies of the text the same with all repeated."""
    for block in _blocks(batches):
        w = Words(block)
        n = np.diff(w.at)
        hits = block.column("hits")
        hit = pa.array([], pa.int64()) if hits.null_count == len(hits) else hits.flatten()
        hit = hit.to_numpy()
        size = np.nan_to_num(np.asarray(hits.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        anchor = w.at[doc] + (hit >> 16)
        bits = ((hit & 0xFFFF)[:, None] >> np.arange(WINDOW - PREFIX + 1)[None, :]) & 1
        row, o = np.nonzero(bits)
        cover = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(cover, anchor[row] - o, 1)
        np.add.at(cover, anchor[row] - o + WINDOW, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.bincount(w.doc[gone], minlength=len(n))
        edges = np.flatnonzero(gone & (np.append(False, gone[:-1]) < gone | (w.doc != np.append(-1, w.doc[:-1]))))
        ends = np.flatnonzero(gone & (np.append(gone[1:], False) < gone | (w.doc != np.append(w.doc[1:], -1)))) + 1
        spans = np.stack([edges - w.at[w.doc[edges]], ends - w.at[w.doc[edges]]], 1).ravel().astype(np.int32)
        per = np.concatenate([[0], np.cumsum(2 * np.bincount(w.doc[edges], minlength=len(n)))]).astype(np.int32)
        whole = n >= WINDOW
        yield pa.RecordBatch.from_arrays(
            [block.column("k1"), block.column("k2"), block.column("lead"), pa.array(n), pa.array(removed), pa.ListArray.from_arrays(pa.array(per), pa.array(spans)),
             pa.array(_digests(w, ~gone), pa.string()), pa.array(np.where(whole, n, 0)), pa.array(_digests(w, ~whole[w.doc]), pa.string())],
            names=["k1", "k2", "lead", "n_words", "n_removed", "removed", "kept_sha256", "copy_removed", "copy_sha256"])


def _digests(w: Words, keep: np.ndarray) -> list[str]:
    """SHA-256 of every text's kept words joined by single blanks."""
    data = w.data.copy()
    s, e = w.start[keep], w.end[keep]
    follow = e < w.off[w.doc[keep] + 1]  # a byte of white space follows, which becomes the blank
    data[e[follow]] = 0x20
    mark = np.zeros(len(data) + 1, np.int8)
    mark[s] += 1
    mark[e + follow] -= 1
    stay = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    kept = data[stay].tobytes()
    at = np.concatenate([[0], np.cumsum(stay)])[w.off]
    return [hashlib.sha256(kept[a:b].removesuffix(b" ")).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, removed (begin and end of every stretch, in words) and kept_sha256 of every row."""
    C.bounded(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id"), F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))
    texts = rows.groupBy("k1", "k2").agg(F.min(F.struct("id")).alias("lead"), F.first("text").alias("text")).select("k1", "k2", "lead.id", "text").withColumnRenamed("id", "lead")
    sent = texts.mapInArrow(_prefixes, "route long, prefix long, k1 long, place long, n long").repartition("route").sortWithinPartitions("route")
    frequent = sent.mapInArrow(_frequent, "prefix long").withColumn("heavy", F.lit(1))
    spots = sent.mapInArrow(_repeated, "prefix long, k1 long, place long").join(F.broadcast(frequent), "prefix", "left")
    k2 = F.shiftright("place", 32).cast("int").alias("k2")
    word = F.col("place").bitwiseAND(F.lit(int(_LOW)))
    spot = (word * 2 + F.coalesce("heavy", F.lit(0))).alias("spot")
    spots = spots.select("k1", k2, spot).groupBy("k1", "k2").agg(F.collect_list("spot").alias("spots"))
    leaves = texts.join(spots, ["k1", "k2"]).select("k1", "k2", "lead", "text", "spots").mapInArrow(_leaves, _LEAF)
    leaves = leaves.repartition("key").sortWithinPartitions("key", "doc_id", word)
    hits = leaves.mapInArrow(_subtrees, "k1 long, place long, repeats long")
    hits = hits.select("k1", k2, (word * 65536 + F.col("repeats")).alias("hit")).groupBy("k1", "k2").agg(F.collect_list("hit").alias("hits"))
    done = texts.join(hits, ["k1", "k2"], "left").select("k1", "k2", "lead", "text", "hits").mapInArrow(
        _removals, "k1 long, k2 int, lead long, n_words long, n_removed long, removed array<int>, kept_sha256 string, copy_removed long, copy_sha256 string")
    own = F.col("id").eqNullSafe(F.col("lead"))
    return rows.select("doc_id", "id", "k1", "k2").join(done, ["k1", "k2"]).select(
        "doc_id", "n_words", F.when(own, F.col("n_removed")).otherwise(F.col("copy_removed")).alias("n_removed"),
        F.when(own, F.col("removed")).when(F.col("copy_removed") > 0, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.array().cast("array<int>")).alias("removed"),
        F.when(own, F.col("kept_sha256")).otherwise(F.col("copy_sha256")).alias("kept_sha256"))
