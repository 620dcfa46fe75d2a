"""Near-duplicate documents by circulant MinHash.

Two permutations give every signature coordinate: one scatters the shingles, the other is read at circular
shifts (Li and Li, 2022).  Bands of the signature give candidates; every link is confirmed on the full shingle sets.

Steps: (1) documents of equal sets form a class, so copies never meet as pairs; (2) in each band bucket all members are compared with the
smallest one; (3) what is linked becomes a component; (4) buckets that still hold several components are compared
in square tiles of bounded size: pairs of different components whose sketches agree are confirmed on full sets there.  A link is thus tried for every pair that shares a bucket and is not connected already.

Defined results: null text, empty text or text without a word has no shingle and is linked with nothing; fewer than
five words give the whole sequence as one shingle; repeated rows (also of one doc_id) are copies; a null doc_id
is handed on with itself alone, never as a representative of others.

The chance to miss a link at a similarity of exactly 0.75 is (1 - 0.75^4)^32 = 5e-6 before indirect links, and less above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.llm import common as C

WORDS, BANDS, ROWS = 5, 32, 4
# Members and shingles of a bucket that one side of a tile holds on average.
TILE, TILE_ITEMS = 1024, 500_000
# Estimated similarity from which a pair of a tile is confirmed on full sets; at 0.75 the estimate lies below with a chance under 1e-5.
LIKELY = 0.58
# Classes that one copy of a class is compared with on full sets.
MEETING = 1024

_K = BANDS * ROWS
_SHIFTS = (np.arange(1, _K + 1, dtype=np.uint64) * np.uint64(0x9E3779B1) % np.uint64(1 << 32)).astype(np.uint32)


def shingles(data: np.ndarray, off: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin."""
    h, _, _, at = C.words(data, off)
    count = np.diff(at)
    made = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    doc = np.repeat(np.arange(len(made)), made)
    first = at[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)
    last = at[doc + 1] - 1
    out = np.zeros(len(doc), np.uint64)
    for k in range(n):
        here = first + k <= last
        word = h[np.minimum(first + k, last)]
        out = np.where(here, C.mix(out * np.uint64(0x9FB21C651E98DF25) + word), out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(made) + 1))


def _permute(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of coordinates per set (all ones for an empty set): minima of one permutation at circular shifts."""
    sig = np.full((len(at) - 1, _K), 0xFFFFFFFF, np.uint32)
    scattered = (C.mix(sets ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    full = np.flatnonzero(np.diff(at))
    step = 1 << 15  # elements that stay in the processor's cache
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(at[full + 1], at[full[i]] + step, side="right")))
        lo, hi = at[full[i]], at[full[j - 1] + 1]
        heads = at[full[i:j]] - lo
        x = scattered[lo:hi]
        for k in range(_K):
            sig[full[i:j], k] = np.minimum.reduceat(_permute(x + _SHIFTS[k]), heads)
        i = j
    return sig


def _fingerprint(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """64-bit name of each set: a sum over its members, so the order of the shingles does not matter."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(sets * np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
    return pa.array(C.mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))


def _sketch(batch: pa.RecordBatch):
    data, off = C.text_of(batch)
    sets, at = shingles(data, off)
    n = np.diff(at)
    sig = signatures(sets, at)
    bands = np.zeros((len(n), BANDS), np.uint64)
    for r in range(ROWS):
        bands = C.mix(bands * np.uint64(0x9FB21C651E98DF25) + sig[:, r::ROWS].astype(np.uint64) + np.uint64(1))
    bands = C.mix(bands + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
    sketch = C.mix(sig.astype(np.uint64)).astype(np.uint8)  # one byte per coordinate
    return [pa.array(n.astype(np.int64)), _fingerprint(sets, at),
            pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64))),
            pa.array([row.tobytes() for row in sketch], pa.binary())]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the class f of equal sets, bands and sketch of every document."""
    return C.extend(docs, _sketch, "n_shingles bigint, f bigint, bands array<bigint>, sketch binary", ["doc_id"])


def classes_of(drawn: DataFrame) -> DataFrame:
    """One row per class of equal sets: f, its smallest doc_id, bands and sketch (equal in all members)."""
    named = drawn.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    return named.groupBy("f").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
                                       F.first("sketch").alias("sketch"))


def _star(rows: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket beside the smallest of its bucket: (a, b, close) with a > b, each pair once; sets whose sizes alone
    rule a link out are not close."""
    head = rows.groupBy("band").agg(F.min(F.struct("f", "n_shingles")).alias("h"), F.max("f").alias("top")).filter("top > h.f").select("band", "h")
    size, other = F.col("n_shingles"), F.col("h.n_shingles")
    close = F.least(size, other) * 100 >= percent * F.greatest(size, other)
    return rows.join(head, "band").filter("f > h.f").select(F.col("f").alias("a"), F.col("h.f").alias("b"), close.alias("close")).distinct()


def _contents(batch: pa.RecordBatch):
    sets, at = shingles(*C.text_of(batch))
    items = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
    return [_fingerprint(sets, at), items]


def _sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(f, items): the full shingle sets of the classes in ``wanted``, made again from the text of one member."""
    ids = classes.select("f", "doc_id").join(wanted.distinct(), "f", "left_semi").select(F.col("f").alias("class"), "doc_id")
    texts = docs.filter(F.col("text").isNotNull()).join(ids, "doc_id")
    made = C.extend(texts, _contents, "f bigint, items array<bigint>", ["class"])
    return made.filter("f = class").select("f", "items").dropDuplicates(["f"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with 100 * intersection >= percent * union, decided on the full sets.

    A class compared with more than MEETING others is dealt out in as many copies as that takes.
    """
    copies = F.ceil(F.col("n") / MEETING).cast("int")
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", copies.alias("copies"))
    salt = F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")
    left = pairs.select("a", "b").join(many, "b").select("a", "b", salt.alias("salt")).join(sets.select(F.col("f").alias("a"), F.col("items").alias("x")), "a")
    right = sets.join(many.withColumnRenamed("b", "f"), "f").select(F.col("f").alias("b"), F.col("items").alias("y"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    nx, ny = F.size("x"), F.size("y")
    return (left.join(right, ["b", "salt"])
            .select("a", "b", (nx + ny).alias("n"), F.size(F.array_intersect("x", "y")).alias("m"))
            .filter(F.col("m") * 100 >= percent * (F.col("n") - F.col("m"))).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): (f, comp), comp the smallest member, for every f on an edge.

    Each round takes the smallest label around every node, then follows labels once; both are aggregates with map-side
    minima over rows that are dealt out by node, so a node with very many links is never gathered.
    """
    both = C.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = C.stored(both.groupBy(F.col("a").alias("f")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("f")).groupBy(F.col("a").alias("f")).agg(F.min("comp").alias("near"))
        low = label.join(near, "f").select("f", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = low.join(label.select(F.col("f").alias("k"), F.col("comp").alias("next")), F.col("comp") == F.col("k"), "left")
        now = C.stored(jump.select("f", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "labels")
        label = now.select("f", "comp")
        if now.filter("was <> comp").limit(1).count() == 0:
            return label


def _tile_links(percent: int):
    """Links of one tile between different components, on full sets; at most one fewer than it holds components.

    Side 0 meets side 1; in a tile of a part with itself every row has side 2.  A pair is left to the first bucket both share.
    """
    def links(tile: pa.Table) -> pa.Table:
        f, comp, side = (tile.column(c).to_numpy().copy() for c in ("f", "comp", "side"))
        sketch = np.frombuffer(b"".join(tile.column("sketch").to_pylist()), np.uint8).reshape(len(f), _K)
        bands = tile.column("bands").combine_chunks().flatten().to_numpy().reshape(len(f), BANDS)
        here = tile.column("band")[0].as_py()
        items = tile.column("items").combine_chunks()
        size = np.asarray(items.value_lengths())
        begin = np.concatenate([[0], np.cumsum(size)])
        names, flat = np.unique(items.flatten().to_numpy(), return_inverse=True)
        has = np.zeros(len(names), bool)
        earlier = np.argmax(bands == here, axis=1)
        right = np.flatnonzero(side != 0)
        found = []
        for i in np.flatnonzero(side != 1):
            other = right[comp[right] != comp[i]]
            if side[i] == 2:
                other = other[f[other] > f[i]]
            other = other[np.count_nonzero(sketch[other] == sketch[i], axis=1) >= LIKELY * _K]
            other = other[(np.minimum(size[other], size[i]) * 100 >= percent * np.maximum(size[other], size[i]))]
            other = other[~(bands[other, :earlier[i]] == bands[i, :earlier[i]]).any(axis=1)]
            if not len(other):
                continue
            mine = flat[begin[i]:begin[i + 1]]
            has[mine] = True
            for j in other:
                if comp[j] == comp[i]:
                    continue
                m = int(np.count_nonzero(has[flat[begin[j]:begin[j + 1]]]))
                if m * 100 >= percent * (size[i] + size[j] - m):
                    found.append((max(f[i], f[j]), min(f[i], f[j])))
                    comp[comp == comp[j]] = comp[i]
            has[mine] = False
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _rest(rows: DataFrame, comp: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside buckets that hold several, apart from those with the bucket's smallest member."""
    labelled = rows.join(comp, "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    heads = labelled.groupBy("band").agg(F.min("f").alias("head"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    # the smallest member has met all others, so two components must be left without it
    left = labelled.join(heads.select("band", "head"), "band").filter("f <> head").select("band", "f", "comp", "n_shingles")
    still = left.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"),
                                     F.sum("n_shingles").alias("items")).filter("lo < hi")
    parts = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("items") / TILE_ITEMS)).cast("int")
    left = C.stored(left.join(still.select("band", parts.alias("parts")), "band"), "mixed")
    sets = sets.join(left.select("f").distinct(), "f", "left_semi").join(classes.select("f", "sketch", "bands"), "f")
    p, q = F.col("p"), F.col("q")
    dealt = left.withColumn("p", F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = dealt.select("band", F.least(p, q).alias("i"), F.greatest(p, q).alias("j"), "f", "comp",
                         F.when(p == q, 2).when(p < q, 0).otherwise(1).alias("side"))
    return tiles.join(sets, "f").groupBy("band", "i", "j").applyInArrow(_tile_links(percent), "a bigint, b bigint").distinct()


def duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    docs = docs.select("doc_id", "text")
    drawn = C.stored(sketches(docs), "sketches")
    classes = C.stored(classes_of(drawn), "classes")
    rows = classes.select("f", "n_shingles", F.explode("bands").alias("band"))
    pairs = C.stored(_star(rows, percent), "pairs")
    # every member of a bucket of several is in a pair, so these sets serve the tiles as well
    sets = C.stored_by(_sets(pairs.select(F.explode(F.array("a", "b")).alias("f")), docs, classes), "f", "sets")
    edges = C.stored(_confirm(pairs.filter("close"), sets, percent), "edges")
    comp = components(edges)
    more = C.stored(_rest(rows, comp, classes, sets, percent), "edges")
    if more.limit(1).count():
        comp = components(edges.unionByName(more))
    grown = classes.select("f", "doc_id").join(comp, "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    least = grown.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = grown.join(least, "comp").select("f", "component_id")
    # the class side has one row per class; a class with very many rows is split by the adaptive join
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    linked = drawn.filter(has).select("doc_id", "n_shingles", "f").join(named, "f").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(drawn.filter(~has).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def kept(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Documents that stay: the smallest doc_id of every component, once, and every row without shingles or id."""
    found = duplicates(docs, percent)
    stay = found.filter("doc_id = component_id").select("doc_id").distinct()
    one = docs.filter(F.col("doc_id").isNotNull()).join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))
