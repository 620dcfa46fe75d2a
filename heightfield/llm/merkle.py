"""Merkle manifest of a data set: a postorder append log per source, proofs addressed by closed-form positions.

The leaves of a source, in the order of their ids, form a tree in which every run of FANOUT nodes of one level has one
parent.  Aligned builders each take FANOUT^HEIGHT leaves and write their nodes in completion order, so that a node stands right
after its subtree.  Where a node stands follows from the sizes of the subtrees before it (``position``), so no index is
kept: a proof reads its siblings at computed places of the log.  Builders whose roots remain are leaves of the next tier, until one
node is left; the roots of the sources are the leaves of one last tree.

Ranks come from a range exchange by (source, id) and a summary of one row per partition, so that neither a hot source nor a
repeated id gathers in one task; a builder is a group of bounded size.

Defined results: null columns are hashed as ``-``; a null source is a source of its own, before all others; a null id stands before all
ids of its source and is never tampered with; rows of one id are ordered by their leaf; an empty table gives no rows; columns other than the five
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.llm import common as C
from heightfield.plans.iterate import cut

# Nodes hashed into one parent; the share of ids whose text the check tampers with.
FANOUT, TAMPERED = 16, 5
# Levels a builder closes by itself; it holds at most FANOUT ** HEIGHT leaves.
HEIGHT = 3
# Leaves of a range partition on average.
PART_ROWS = 400_000

_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list) -> F.Column:
    """Digest of a row: every value with its length before it, ``-`` for null."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the leaf of the tampered row where the check tampers (else null), digests as bytes."""
    given = [F.col(c) for c in _COLUMNS]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.unhex(leaf_digest(given)).alias("leaf"),
                       F.when(chosen, F.unhex(leaf_digest([*given[:-1], lower]))).alias("tampered"))


# --- ranks -------------------------------------------------------------------------------------------------------------

def _summary(batches):
    """One row per partition: rows, sources, the first and the last source and how many rows each has here."""
    part = n = runs = first = last = first_n = last_n = most = None
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column("part")[0].as_py()
        col = b.column("source")
        for source, count in _runs(col):
            if n is None:
                n, runs, first, first_n, last, last_n, most = 0, 1, source, 0, source, 0, 0
            elif source != last:
                runs, last, last_n = runs + 1, source, 0
            n += count
            last_n += count
            most = max(most, last_n)
            if runs == 1:
                first_n += count
    if n is not None:
        row = {"part": part, "n": n, "runs": runs, "first": first, "last": last, "first_n": first_n, "last_n": last_n, "most": most}
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.string() if k in ("first", "last") else pa.int64()) for k, v in row.items()})


def _runs(col: pa.Array):
    """(value, length) of the runs of equal values."""
    codes = col.dictionary_encode(null_encoding="encode")
    at = np.concatenate([[0], np.flatnonzero(np.diff(codes.indices.to_numpy(zero_copy_only=False))) + 1, [len(col)]])
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield col[int(lo)].as_py(), int(hi - lo)


def _known(summaries: list) -> tuple[dict, int, int]:
    """For every partition: rank of its first source, rows of that source before the partition, sizes of its first and last source;
    then the largest size and the number of sources."""
    total: dict = {}
    for r in summaries:
        total[r["first"]] = total.get(r["first"], 0) + r["first_n"]
        if r["runs"] > 1:
            total[r["last"]] = total.get(r["last"], 0) + r["last_n"]
    out, rank, previous, before = {}, -1, (), 0
    for r in summaries:
        same = previous == (r["first"],)
        rank = rank if same else rank + 1
        start = before if same else 0
        out[r["part"]] = (rank, start, total[r["first"]], total[r["last"]])
        before = start + r["first_n"] if r["runs"] == 1 else r["last_n"]
        rank += r["runs"] - 1
        previous = (r["last"],)
    return out, max([*total.values(), *(r["most"] for r in summaries)], default=0), rank + 1


def _rank(batches, known):
    """Add tree (rank of the source), i (place in the source) and size (rows of the source)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held).combine_chunks()
    rank, start, first_size, last_size = known[whole.column("part")[0].as_py()]
    lengths = np.array([n for _, n in _runs(whole.column("source").combine_chunks())])
    tree = np.repeat(np.arange(len(lengths)) + rank, lengths)
    i = np.arange(whole.num_rows) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    i[:lengths[0]] += start
    size = lengths.copy()
    size[-1] = last_size
    size[0] = first_size
    keep = whole.select(["doc_id", "leaf", "tampered"])
    for name, v in (("tree", tree), ("i", i), ("size", np.repeat(size, lengths))):
        keep = keep.append_column(name, pa.array(v.astype(np.int64)))
    yield from keep.to_batches(max_chunksize=65_536)


def ranked(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Every leaf with its source's rank (tree), its place there (i) and the source's size; beside them the largest size and the number of sources.

    The driver sees one row per range partition.  Whole-row copies are kept apart by their place in the input.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["doc_id"]
    parts = max(1, rows.select("doc_id").count() // PART_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ("source", "doc_id", "leaf", "copy")
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_ = cut(dealt.drop("copy").withColumn("part", F.spark_partition_id().cast("long")))
    found = sorted_.select("part", "source").mapInArrow(_summary, "part long, n long, runs long, first string, last string, first_n long, last_n long, most long")
    known, size, trees = _known(sorted(found.collect(), key=lambda r: r["part"]))
    rows = sorted_.mapInArrow(partial(_rank, known=known), f"doc_id {kind}, leaf binary, tampered binary, tree long, i long, size long")
    return rows, size, trees


# --- the log -----------------------------------------------------------------------------------------------------------

def position(level: int, i: int, n: int, height: int) -> int:
    """Place in the postorder log, from 0, of node ``i`` of ``level`` in a tree of ``n`` leaves and ``height`` levels above them.

    Before a node stand all nodes that end no later than its own last leaf: below it those up to that leaf, on its own level those
    to its left, above it those that ended before its first leaf.
    """
    end = min((i + 1) * FANOUT ** level, n)
    below = sum(-(-end // FANOUT ** m) for m in range(level))
    return below + i + sum(i // FANOUT ** (m - level) for m in range(level + 1, height + 1))


def heights(n: int) -> int:
    """Levels above the leaves until one node remains."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def build(leaf: list[str], levels: int) -> list[str]:
    """The nodes over the given leaves, closed for ``levels`` levels, in completion order."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        node = digest("".join(open_[level]))
        open_[level] = []
        log.append(node)
        open_[level + 1].append(node)

    for h in leaf:
        log.append(h)
        open_[0].append(h)
        level = 0
        while level < levels and len(open_[level]) == FANOUT:
            close(level)
            level += 1
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


def _levels(size: int) -> int:
    """Levels a builder of a tree of ``size`` leaves closes."""
    return min(HEIGHT, heights(size))


def _builder(key, group):
    """One aligned builder: its nodes in completion order with their places in the builder's part of the log."""
    tree, block = (k.as_py() for k in key)
    i, leaf = group.column("i").to_numpy(), group.column("leaf").to_pylist()
    size = group.column("size")[0].as_py()
    log = build([leaf[k].hex() for k in np.argsort(i, kind="stable")], _levels(size))
    n = len(log)
    return pa.table({"tree": pa.array([tree] * n, pa.int64()), "block": pa.array([block] * n, pa.int64()), "size": pa.array([size] * n, pa.int64()),
                     "leaves": pa.array([len(leaf)] * n, pa.int32()), "pos": pa.array(range(n), pa.int32()),
                     "node": pa.array([bytes.fromhex(h) for h in log], pa.binary())})


def _tier(rows: DataFrame) -> DataFrame:
    """The log of one tier over rows (tree, i, size, leaf): (tree, block, size, leaves, pos, node)."""
    blocks = rows.select("tree", "i", "size", "leaf", _block().alias("block"))
    return C.stored(blocks.groupBy("tree", "block").applyInArrow(_builder, "tree long, block long, size long, leaves int, pos int, node binary"), "merkle-log")


def _block() -> F.Column:
    return F.floor(F.col("i") / FANOUT ** HEIGHT).cast("long")


def _roots(log: DataFrame) -> DataFrame:
    """The last node of every builder as a leaf of the next tier: (tree, i, size, leaf)."""
    top = log.groupBy("tree", "block", "size").agg(F.max_by("node", "pos").alias("leaf"))
    return top.select("tree", F.col("block").alias("i"), F.ceil(F.col("size") / FANOUT ** HEIGHT).cast("long").alias("size"), "leaf")


def _tiers(rows: DataFrame, size: int) -> list[DataFrame]:
    """The logs from the leaves up, until every tree has one node; ``size`` is the largest tree."""
    logs = [_tier(rows)]
    while size > FANOUT ** HEIGHT:
        size = -(-size // FANOUT ** HEIGHT)
        logs.append(_tier(_roots(logs[-1]).filter("size > 1")))
    return logs


# --- proofs ------------------------------------------------------------------------------------------------------------

_PATH = "left array<string>, right array<string>, subroot string, root string"


class _Part:
    """A builder's part of the log beside the path above it, as read back."""

    def __init__(self, table: pa.Table):
        rows = table.select(["pos", "node", "size", "leaves", "left", "right", "subroot", "root"]).to_pylist()
        above = next(r for r in rows if r["pos"] < 0)
        log = [r["node"].hex() for r in sorted((r for r in rows if r["pos"] >= 0), key=lambda r: r["pos"])]
        size, self.leaves = next((r["size"], r["leaves"]) for r in rows if r["pos"] >= 0)
        self.levels = _levels(size)
        # every level of the builder, each node read at its computed place
        self.nodes = [[log[position(level, j, self.leaves, self.levels)] for j in range(-(-self.leaves // FANOUT ** level))] for level in range(self.levels)]
        self.leaf = self.nodes[0] if self.nodes else log
        self.above = list(zip(above["left"], above["right"], strict=True))
        self.subroot = above["subroot"] if above["subroot"] is not None else log[-1]
        self.root = above["root"]

    def path(self, i: int) -> list[tuple[str, str]]:
        """What stands left and right of the path of leaf ``i`` of this builder, level by level up to the root."""
        out = []
        for level in range(self.levels):
            at = i // FANOUT ** level
            lo = at - at % FANOUT
            run = self.nodes[level][lo:lo + FANOUT]
            out.append(("".join(run[:at - lo]), "".join(run[at - lo + 1:])))
        return out + self.above


def _paths(key, group):
    """Paths of all leaves of a builder of an upper tier, each the path above one builder of the tier below."""
    tree, block = (k.as_py() for k in key)
    part = _Part(group)
    paths = [part.path(i) for i in range(part.leaves)]
    n = len(paths)
    strings = pa.list_(pa.string())
    return pa.table({"tree": pa.array([tree] * n, pa.int64()), "i": pa.array(range(block * FANOUT ** HEIGHT, block * FANOUT ** HEIGHT + n), pa.int64()),
                     "left": pa.array([[a for a, _ in p] for p in paths], strings), "right": pa.array([[b for _, b in p] for p in paths], strings),
                     "subroot": pa.array([part.subroot] * n, pa.string()), "root": pa.array([part.root] * n, pa.string())})


def _checks(key, members, group):
    """Leaf, proof and the root folded from the (tampered) leaf for every member of a builder."""
    block = key[1].as_py()
    part = _Part(group)
    proof, folded, leaf = [], [], []
    for i, tampered in zip(members.column("i").to_pylist(), members.column("tampered").to_pylist(), strict=True):
        path = part.path(i - block * FANOUT ** HEIGHT)
        own = part.leaf[i - block * FANOUT ** HEIGHT]
        h = own if tampered is None else tampered.hex()
        for left, right in path:
            h = digest(left + h + right)
        leaf.append(own)
        folded.append(h)
        proof.append(digest("".join(a + b for a, b in path)))
    n = len(leaf)
    text = lambda v: pa.array(v, pa.string())
    return pa.table({"doc_id": members.column("doc_id"), "leaf": text(leaf), "subroot": text([part.subroot] * n), "root": text([part.root] * n),
                     "proof_sha256": text(proof), "folded_root": text(folded)})


def _beside(log: DataFrame, above: DataFrame) -> DataFrame:
    """The rows of the log together with the paths above its builders (at place -1)."""
    names = [f.split()[0] for f in _PATH.split(", ")]
    bare = log.select("*", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _PATH.split(", ")])
    rows = above.select("tree", "block", F.lit(None).cast("long").alias("size"), F.lit(None).cast("int").alias("leaves"), F.lit(-1).alias("pos"),
                        F.lit(None).cast("binary").alias("node"), *names)
    return bare.unionByName(rows)


def _down(logs: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The path above every builder of the lowest tier; ``ends`` (tree and path) is the path above each tree's last node."""
    above = None
    for k in range(len(logs) - 1, -1, -1):
        last = logs[k].filter(F.col("size") <= FANOUT ** HEIGHT).select("tree").distinct().join(ends, "tree").withColumn("block", F.lit(0).cast("long"))
        above = last if above is None else above.unionByName(last)
        if k:
            made = _beside(logs[k], above).groupBy("tree", "block").applyInArrow(_paths, f"tree long, i long, {_PATH}")
            above = made.withColumnRenamed("i", "block")
    return above


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, its proof read from the log."""
    spark = docs.sparkSession
    rows, size, trees = ranked(leaves(docs))
    kind = dict(rows.dtypes)["doc_id"]
    logs = _tiers(rows, size)
    subroots = None
    for log in logs:
        ended = _roots(log).filter("size = 1").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(trees).cast("long").alias("size"), "leaf")
        subroots = ended if subroots is None else subroots.unionByName(ended)
    tops = _tiers(subroots, trees)
    strings = F.array().cast("array<string>")
    top = spark.range(1).select(F.col("id").alias("tree"), strings.alias("left"), strings.alias("right"), F.lit(None).cast("string").alias("subroot"))
    root = tops[-1].groupBy("tree").agg(F.lower(F.hex(F.max_by("node", "pos"))).alias("root"))
    top = top.join(root, "tree")
    over = _beside(tops[0], _down(tops, top)).groupBy("tree", "block").applyInArrow(_paths, f"tree long, i long, {_PATH}")
    # the subroot of a source is known from its own log
    ends = C.stored(over.select(F.col("i").alias("tree"), "left", "right", F.lit(None).cast("string").alias("subroot"), "root"), "merkle-paths")
    above = _down(logs, ends)
    members = rows.select("tree", _block().alias("block"), "i", "doc_id", "tampered")
    found = (members.groupBy("tree", "block").cogroup(_beside(logs[0], above).groupBy("tree", "block"))
             .applyInArrow(_checks, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
