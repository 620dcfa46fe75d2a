"""Near words, forms and roots against all single edits of every word."""

import re
import zlib
from collections import Counter

import pytest

from heightfield.llm import variants


def altered(rows):
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{word}".encode())
            if i is not None and h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            yield word


def plain(rows):
    voc = {w: n for w, n in Counter(altered(rows)).items() if len(w) >= 6 and n >= 5}
    letters = sorted({c for w in voc for c in w})
    out, form, near = [], {}, {}
    for w, n in voc.items():
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        near[w] = {x for x in edits if x != w and x in voc}
        first = min(near[w], key=lambda x: (-voc[x], x), default=None)
        if first and voc[first] >= 5 * n:
            form[w] = first
    for w, n in voc.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), voc[form[w]] if w in form else None))
    return sorted(out)


def found(docs):
    return sorted(map(tuple, variants.variants(docs).collect()))


@pytest.fixture(scope="module")
def rows():
    import random
    draw = random.Random(3)
    stems = ["".join(draw.choice("abeiénrst×") for _ in range(draw.randint(5, 12))) for _ in range(40)]
    stems += ["wiederho" + "".join(draw.choice("ab") for _ in range(6)) for _ in range(60)]
    words = []
    for s in stems:
        k = draw.randrange(len(s))
        for w, n in ((s, draw.choice([5, 40, 900])), (s[:k] + "q" + s[k:], draw.choice([5, 30])), (s[:k] + s[k + 1:], 6), (s[:k] + "z" + s[k + 1:], draw.choice([4, 7]))):
            words += [w.upper() if draw.random() < 0.1 else w] * n
    draw.shuffle(words)
    return [(i if i % 9 else None, " ".join(words[i:i + 50]) + ".;") for i in range(0, len(words), 50)]


@pytest.mark.parametrize("block", [8192, 16])
def test_same_forms_and_roots_as_all_single_edits(spark, rows, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = found(docs)
    assert got == plain(rows)
    assert any(r[2] != r[1] for r in got if r[1])  # a chain of forms


def test_checksums_of_long_runs(spark):
    rows = [(3, " ".join(["x" * 5000 + "y"] * 6 + ["x" * 5000] * 40)), (4, "abÿ" * 50 + " " + "Àbcdef " * 7)] + [(i, "Kanten kanten") for i in range(300)]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows)


def test_odd_rows_and_empty_table(odd, none):
    assert found(odd) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert found(none) == []


def test_chains_follow_to_the_last_word(spark):
    text = " ".join(["kanten"] * 5 + ["kantex"] * 30 + ["kantey"] * 5 + ["kantexy"] * 200 + ["kantexyz"] * 1100)
    got = {r[0]: r[2] for r in found(spark.createDataFrame([(None, text)], "doc_id bigint, text string"))}
    assert got["kanten"] == "kantexyz" and got["kantexyz"] == "kantexyz"
