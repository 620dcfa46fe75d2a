"""The manifest against trees built plainly in memory."""

import hashlib
import zlib

import pytest

from heightfield.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for nodes in tree[:-1]:
        lo = i - i % 16
        yield "".join(nodes[lo:i]), "".join(nodes[i + 1:lo + 16])
        i //= 16


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: x[0])
    trees = {s: levels([k[2] for k, _ in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, (key, r) in enumerate(by[s]):
            path = [*siblings(trees[s], i), *siblings(top, j)]
            f = key[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                low = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                f = leaf((*r[:4], low))
            for a, b in path:
                f = h(a + f + b)
            out.append((r[0], key[2], trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in path)), f, f == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, merkle.verified(df).collect()), key=str)


def test_every_node_stands_where_the_closed_form_says():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 600, 4096):
        height = merkle.heights(n)
        names = [f"{i:05d}" for i in range(n)]
        log = merkle.build(names, height)
        tree = levels(names)
        assert len(log) == sum(map(len, tree))
        for level, nodes in enumerate(tree):
            for i in {0, len(nodes) // 2, len(nodes) - 1}:
                assert log[merkle.position(level, i, n, height)] == nodes[i]


def test_manifest_with_a_hot_source_ties_nulls_and_repeated_rows(spark):
    rows = [(i, "hot", "en", 3, f"Text {i}") for i in range(4200)] + [(i * 7 % 400, f"s{i % 23}", None, i, "Ab é" * (i % 3)) for i in range(400)]
    rows += [(None, None, None, None, None), (None, "hot", None, 1, ""), (5, None, "de", 2, "X"), (5, "é", "de", 2, "X")] + [(9, "hot", "en", 3, "Text 9")] * 20
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


@pytest.mark.parametrize("builders", [1, 2])
def test_more_tiers_and_more_sources_than_a_builder_holds(spark, monkeypatch, builders):
    monkeypatch.setattr(merkle, "HEIGHT", builders)
    rows = [(i, "hot", "en", i, "T") for i in range(300)] + [(i, f"s{i:03d}", "en", i, "T") for i in range(40)]
    small = spark.createDataFrame(rows, SCHEMA)
    assert got(small) == plain(rows)


def test_odd_rows_and_empty_table(odd, none):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert got(odd) == plain(rows)
    assert merkle.verified(none).collect() == []
    assert got(odd.filter("doc_id = 7")) == plain([r for r in rows if r[0] == 7])
