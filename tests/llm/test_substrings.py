"""Repeated passages against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from heightfield.llm import substrings


def place(i, s=0):
    return i is not None, i or 0, s


def plain(rows, width=20):
    first, texts = {}, []
    for i, text in rows:
        w = re.findall(r"[^ \t\n\x0B\f\r]+", text or "")
        texts.append(w)
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            first[k] = min(first.get(k, place(i, s)), place(i, s))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if place(i, s) > first[tuple(w[s:s + width])]:
                gone[s:s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, substrings.deduplicated(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    word = lambda: draw.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + draw.choice("123")
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 25, 40, 200)]
    rows = []
    for i in range(240):
        text = [word() for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 3)):
            p = list(draw.choice(passages))
            if draw.random() < 0.5:
                p[draw.randrange(len(p))] = word()
            text += p + [word() for _ in range(draw.randint(0, 5))]
        rows.append((draw.choice([None, i, i, i % 7]), draw.choice([" ", "\n", "\t "]).join(text)))
    return rows + rows[:30] + [(1000, "x " * 500), (1001, " ".join(passages[5]) + "\n")]


@pytest.mark.parametrize("heavy, table", [(50_000, 65_536), (3, 65_536), (2, 50)])
def test_same_words_go_as_by_all_windows(spark, rows, monkeypatch, heavy, table):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    monkeypatch.setattr(substrings, "GROUP_ROWS", table)
    monkeypatch.setattr(substrings, "TEXT_BYTES", 20_000)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(docs) == plain(rows)


def test_stretches_are_maximal(spark):
    a = [f"a{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(["x", *a[5:45], "y", *a[:19], "z", *a[30:55]])), (3, " ".join(a))], "doc_id bigint, text string")
    got = {r.doc_id: r.removed for r in substrings.deduplicated(docs).collect()}
    assert got == {1: [], 2: [1, 41, 62, 87], 3: [0, 60]}


def test_odd_rows_and_empty_table(odd, none):
    assert found(odd) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert found(none) == []


def test_a_very_long_text_that_repeats_itself(spark):
    w = [f"w{k % 5003}" for k in range(200_000)]
    rows = [(4, " ".join(w)), (None, " ".join(w[100:400]))]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows)
