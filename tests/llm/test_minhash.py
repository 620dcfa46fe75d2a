"""Near duplicates against brute force over all pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heightfield.llm import common as C
from heightfield.llm import minhash


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(k):
        while comp[k] != k:
            comp[k] = comp[comp[k]]
            k = comp[k]
        return k

    first = {}
    for i, s in enumerate(sets):
        if s and rows[i][0] is not None:
            for sh in s:
                first.setdefault(sh, []).append(i)
    for i, j in {(a, b) for members in first.values() for k, a in enumerate(members) for b in members[k + 1:]}:
        m = len(sets[i] & sets[j])
        if 100 * m >= percent * (len(sets[i]) + len(sets[j]) - m):
            comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((d is None, d or 0, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))


def answer(docs):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in minhash.duplicates(docs).collect())


def family(seed, copies, edits, words=60):
    """Texts that drift from one another, so that links form chains and borderline pairs."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for p in rng.integers(0, words, edits):
            w[p] = f"e{rng.integers(0, 10**6)}"
        if seed % 2:
            base = w
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile,items", [(1024, 500_000), (7, 600)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, tile, items):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "TILE_ITEMS", items)
    texts = [t for seed in range(12) for t in family(seed, 14, 1 + seed % 3)] + ["a b c"] * 5 + ["A b  c", "a b c d", "x", None, "", " "]
    rows = list(enumerate(texts))
    assert answer(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_given_table(spark):
    docs = C.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert answer(docs) == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(odd, none):
    assert answer(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    stay = minhash.kept(odd)
    assert stay.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in stay.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert minhash.duplicates(none).count() == minhash.kept(none).count() == 0


def test_one_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_every_coordinate_is_a_minimum_of_one_shifted_permutation():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 40, 0, 70_000)]
    at = np.cumsum([0, *map(len, sets)])
    sig = minhash.signatures(np.concatenate(sets), at)
    assert (sig[2] == 0xFFFFFFFF).all()
    for s, row in zip(sets, sig):
        if len(s):
            x = (C.mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
            assert all(minhash._permute(x + minhash._SHIFTS[k]).min() == row[k] for k in (0, 5, 127))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[1000:])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.15


def test_shingles_are_sorted_and_distinct():
    b = pa.RecordBatch.from_arrays([pa.array(["a b c d e a b c d e a b c d e", "", "q r"])], names=["text"])
    s, at = minhash.shingles(*C.text_of(b))
    assert np.diff(at).tolist() == [5, 0, 1] and (np.diff(s[:5].astype(object)) > 0).all()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k + 1, k) for k in range(300)] + [(k, 1000) for k in range(1001, 1200)]
    got = minhash.components(spark.createDataFrame(links, "a long, b long"))
    assert {(r["f"], r["comp"]) for r in got.collect()} == {(k, 0) for k in range(301)} | {(k, 1000) for k in range(1000, 1200)}
    assert got.select("f").distinct().count() == got.count()
    assert minhash.components(got.filter("false").select(F.col("f").alias("a"), F.col("comp").alias("b"))).count() == 0
