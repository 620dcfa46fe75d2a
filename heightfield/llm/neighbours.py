"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample and split it at the median of random projections.  Every vector is routed to one leaf of each tree; a query
walks all trees from one priority queue, nearest boundary first, until the leaves it has reached hold enough
vectors.  How many are enough is measured: a bounded sample of queries is compared with every vector, and the reach is what meets
the wanted share of their true neighbours.  Leaves are compared exactly, in double precision, and the best over all leaves stay.

Equal vectors are one candidate that carries its smallest ids, which is all that a list of k neighbours can show of them; equal queries are
searched once.  Leaves are dealt out in parts of bounded size.

Defined results: vectors that are null, zero, hold null or non-finite components, have a null id or not the commonest length take no part;
ties go to the smaller id; fewer candidates than asked for are all returned; a repeated id is one candidate per
distinct vector; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heightfield.llm import common as C

TREES = 12
# Vectors the trees are fitted on at most, and the least of them in a leaf.
SAMPLE, SAMPLE_LEAF = 32_768, 12
# Vectors wanted in a leaf and in a part of a leaf.
LEAF, PART = 192, 4096
# Queries compared with every vector to find how far a search must reach, and the share of their true neighbours it must meet.
PROBES, RECALL = 96, 0.96


class Forest:
    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        small = max(SAMPLE_LEAF, int(LEAF * len(sample) / max(total, 1)))
        self.roots: list[int] = []
        normal, offset, kids = [], [], []  # of inner nodes; children below zero are leaves, ~leaf
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) <= small:
                self.leaves += 1
                return ~(self.leaves - 1)
            for _ in range(5):
                direction = rng.normal(size=sample.shape[1]).astype(np.float32)
                direction /= np.linalg.norm(direction)
                place = sample[rows] @ direction
                cut = float(np.median(place))
                left = place < cut
                if 0 < left.sum() < len(rows):
                    break
            else:
                self.leaves += 1
                return ~(self.leaves - 1)
            me = len(normal)
            normal.append(direction)
            offset.append(cut)
            kids.append([0, 0])
            kids[me] = [grow(rows[left]), grow(rows[~left])]
            return me

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample))))
        dim = sample.shape[1]
        self.normal = np.array(normal, np.float32).reshape(-1, dim)
        self.offset, self.kids = np.array(offset, np.float32), np.array(kids, np.int64).reshape(-1, 2)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(node >= 0)
                if not len(inner):
                    break
                at = node[inner]
                right = np.einsum("ij,ij->i", x[inner], self.normal[at]) >= self.offset[at]
                node[inner] = self.kids[at, right.astype(int)]
            out[:, t] = ~node
        return out

    def search(self, q: np.ndarray, size: np.ndarray, reach: float) -> list[int]:
        """Leaves for one query, nearest boundary first over all trees, until they hold ``reach`` vectors."""
        side = self.normal @ q - self.offset
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        held, out = 0, []
        while queue and held < reach:
            far, node = heapq.heappop(queue)
            while node >= 0:
                s = side[node]
                heapq.heappush(queue, (max(far, abs(float(s))), int(self.kids[node, int(s < 0)])))
                node = int(self.kids[node, int(s >= 0)])
            out.append(~node)
            held += int(size[~node])
        return out


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that take part: (id, v)."""
    v = F.col(column)
    whole = vectors.filter(F.col(key).isNotNull() & v.isNotNull()).filter(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0))
    return whole.select(F.col(key).alias("id"), v.alias("v"))


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], keep: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``keep`` nearest of each query among (query, id, distance), each id once."""
    q, i, d = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1])
    q, i, d = q[new], i[new], d[new]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return [(q[rank < keep], i[rank < keep], d[rank < keep])]


def _compare(keep: int):
    """Compare queries and vectors leaf by leaf; a task hands on only the best of each query over all its leaves."""
    def leaf(group: pa.Table):
        query = group.column("query").to_numpy()
        ids = group.column("ids").combine_chunks()
        point = ids.is_valid().to_numpy(zero_copy_only=False)  # a query carries no ids
        rows, asks = np.flatnonzero(point), np.flatnonzero(~point)
        if not len(rows) or not len(asks):
            return
        x = matrix(group.column("v").combine_chunks()).astype(np.float64)
        size = ids.value_lengths().fill_null(0).to_numpy()
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = ids.flatten().to_numpy()
        for q in asks:
            d = np.sqrt(((x[rows] - x[q]) ** 2).sum(axis=1))
            near = rows
            if len(rows) > keep:
                most = np.partition(d, keep - 1)[keep - 1]
                near, d = rows[d <= most], d[d <= most]
            far = np.repeat(d, size[near])
            who = np.concatenate([flat[begin[k]:begin[k + 1]] for k in near])
            order = np.lexsort((who, far))[:keep]
            yield np.full(len(order), query[q]), who[order], far[order]

    def run(batches):
        found, held, key, many = [], [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            name = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = np.flatnonzero((name[:, 1:] != name[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                now = (int(name[0, a]), int(name[1, a]))
                if now != key and held:
                    for f in leaf(pa.Table.from_batches(held)):
                        found.append(f)
                        many += len(f[0])
                    held = []
                    if many > 400_000:
                        found = _best(found, keep)
                        many = 0
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            found.extend(leaf(pa.Table.from_batches(held)))
        if found:
            q, i, d = _best(found, keep)[0]
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(d)], names=["q", "id", "d"])

    return run


def _exact(points: DataFrame, sample: np.ndarray, keep: int) -> list:
    """(sample row, vector, distance): the ``keep`` vectors nearest to each of a bounded sample, by comparison with all."""
    element = dict(points.dtypes)["v"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0)).astype(np.float64)
            d = np.sqrt(np.maximum((x**2).sum(axis=1) + (sample**2).sum(axis=1)[:, None] - 2 * sample @ x.T, 0))
            near = np.argpartition(d, keep - 1, axis=1)[:, :keep] if len(x) > keep else np.tile(np.arange(len(x)), (len(sample), 1))
            rows = np.repeat(np.arange(len(sample)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), b.column(0).take(pa.array(near.ravel())), pa.array(d[rows, near.ravel()])], names=["s", "v", "d"])

    found = points.select("v").mapInArrow(run, f"s int, v {element}, d double")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("d", "v"))).filter(F.col("n") <= keep).select("s", "v", "d").collect()


def reach_for(points: DataFrame, forest: Forest, size: np.ndarray, sample: np.ndarray, k: int, recall: float = RECALL) -> float:
    """Vectors a search must reach so that it meets this share of the sample's true neighbours."""
    found = _exact(points, sample, k + 1)
    need = []
    for s, q in enumerate(sample):
        order = np.array(forest.search(q.astype(np.float32), size, np.inf))
        held = np.cumsum(size[order])
        at = np.zeros(len(size), np.int64)
        at[order] = np.arange(len(order))
        near = np.array([r["v"] for r in found if r["s"] == s and r["d"] > 1e-6], np.float32)
        if len(near):
            first = at[forest.route(near)].min(axis=1)  # the first tree in which the search meets the neighbour
            need.extend(held[first] - size[order[first]] + 1)
    return float(np.quantile(need, recall)) if need else np.inf


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding",
            recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows of ``vectors``, found among the leaves it reaches."""
    spark = vectors.sparkSession
    C.bounded(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    every = usable(vectors, key, column)
    common = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    dim = common[0]["n"]
    every = every.filter(F.size("v") == dim)
    # equal vectors: the k + 1 smallest ids
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    points = C.stored(first.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "points")
    total = points.count()
    drawn = points.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toArrow()
    forest = Forest(matrix(drawn.column("v").combine_chunks()).astype(np.float32), total)

    def leaves(batches):
        for b in batches:
            if b.num_rows:
                leaf, n = np.unique(forest.route(matrix(b.column(0)).astype(np.float32)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], names=["leaf", "n"])

    size = np.zeros(forest.leaves, np.int64)
    for r in points.select("v").mapInArrow(leaves, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        size[r["leaf"]] = r["n"]  # one row per leaf; the sample bounds their number
    parts = np.maximum(-(-size // PART), 1)

    asked = usable(queries, key, column).filter(F.size("v") == dim)
    ask = C.stored(asked.groupBy("v").agg(F.min("id").alias("q")), "queries")
    tried = ask.orderBy(F.xxhash64("v"), "v").limit(PROBES).select("v").toArrow()
    if not tried.num_rows:
        return spark.createDataFrame([], schema)
    reach = reach_for(points, forest, size, matrix(tried.column("v").combine_chunks()).astype(np.float64), k, recall)
    element = dict(points.dtypes)["v"]
    dealt = f"leaf bigint, part bigint, query bigint, ids array<bigint>, v {element}"

    def rows_of(b, owner, leaf, part, query, ids):
        return pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(part), query, ids, b.column(0).take(pa.array(owner))], names=["leaf", "part", "query", "ids", "v"])

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            leaf = forest.route(matrix(b.column(0)).astype(np.float32))
            owner = np.repeat(np.arange(b.num_rows), leaf.shape[1])
            least = np.array([i[0].as_py() for i in b.column(1)], np.int64).view(np.uint64)
            part = (C.mix(least)[owner] % parts[leaf.ravel()].astype(np.uint64)).astype(np.int64)
            yield rows_of(b, owner, leaf.ravel(), part, pa.array(np.zeros(len(owner), np.int64)), b.column(1).take(pa.array(owner)))

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(0)).astype(np.float32)
            found = [(i, leaf, p) for i in range(len(x)) for leaf in forest.search(x[i], size, reach) for p in range(parts[leaf])]
            owner, leaf, part = np.array(found, np.int64).T
            yield rows_of(b, owner, leaf, part, b.column(1).take(pa.array(owner)), pa.nulls(len(owner), pa.list_(pa.int64())))

    both = points.select("v", "ids").mapInArrow(place, dealt).unionByName(ask.select("v", "q").mapInArrow(probe, dealt))
    leafwise = both.repartition("leaf", "part").sortWithinPartitions("leaf", "part")
    best = leafwise.mapInArrow(_compare(k + 1), "q bigint, id bigint, d double").distinct()
    order = Window.partitionBy("q").orderBy("d", "id")
    lists = best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")
    named = asked.join(ask, "v").select(F.col("id").alias("query_id"), "q").distinct()
    mine = named.join(lists, "q").filter("id <> query_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("d").alias("score"))
