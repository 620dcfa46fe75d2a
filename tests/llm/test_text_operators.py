"""Language identification, toxicity, the language model, decontamination: against brute force, held-out rows and odd cases."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heightfield.llm import common as C
from heightfield.llm import decontaminate, hmm, langid, suite, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


def test_words_and_hashes_follow_the_contract():
    texts = ["Ab c d\x1ce", "", None, "  x\x0b\x0cy ", "ÉA", "ab"]
    h, starts, ends, at = C.words(*C.text_of(batch(texts)))
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    names = {}
    for word, value in zip(itertools.chain(*want), h.tolist()):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_blocks_cut_between_rows_and_keep_all():
    b = batch(["a" * 10, None, "b" * 50, "", "c" * 3])
    parts = list(C.blocks([b.slice(0, 4), b.slice(4)], 20))
    assert [t for p in parts for t in p.column(0).to_pylist()] == b.column(0).to_pylist()
    assert max(sum(len(t or "") for t in p.column(0).to_pylist()) for p in parts) == 50
    assert [t for p in C.gathered([b.slice(k, 1) for k in range(5)], 1000) for t in p.column(0).to_pylist()] == b.column(0).to_pylist()


# language identification ------------------------------------------------------------------------------------------------

def greedy(text, reference):
    """Phrases of the greedy parse by plain search; a symbol that never occurs is a phrase of its own."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in reference:
            j += 1
        n, i = n + 1, j
    return n


def test_parse_counts_are_those_of_a_plain_greedy_parse():
    refs = [("de", "der hund und die katze und der hase"), ("en", "the dog and the cat and the hare")]
    p = langid.Parser(refs)
    texts = ["the dog and der hund", "zzz qq", "a", "", "katze " * 60]
    s, off = p.symbols(*C.code_points(*C.text_of(batch(texts))))
    got = p.counts(s, off)
    for t, row in zip(texts, got):
        clean = re.sub(r"[^a-z]+", " ", t)
        for k, (_, ref) in enumerate(refs):
            assert row[k] == sum(greedy(clean[i:i + langid.SEGMENT], ref) for i in range(0, len(clean), langid.SEGMENT))


def test_languages_of_held_out_rows(spark):
    found = suite.op1_language_id(spark, MIDDLE)
    truth = C.table(spark, MIDDLE, "documents").select("doc_id", "lang")
    right = found.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.96
    assert found.filter("score < 0 or score > 1 or lang_pred is null").count() == 0 and found.count() == truth.count()


@pytest.mark.parametrize("stray", ["ok", "e ta", "ok thanks for the help"])
def test_one_short_row_of_a_language_takes_no_other_texts(spark, stray):
    docs = C.table(spark, MIDDLE, "documents").filter(C.crc_mod("doc_id", 3) == 1)
    refs = langid.references(C.table(spark, MIDDLE, "documents").filter(C.crc_mod("doc_id", 3) != 1))
    found = langid.identify(docs, [*refs, ("xx", stray)], ["doc_id", "lang"])
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.96
    assert langid.accepted(docs, [*refs, ("xx", stray)]).count() == langid.accepted(docs, refs).count()


@pytest.mark.parametrize("size", [256, 1024])
def test_a_language_with_little_labelled_text_is_found_and_kept(spark, size):
    docs = C.table(spark, MIDDLE, "documents").filter(C.crc_mod("doc_id", 3) == 1)
    refs = langid.references(C.table(spark, MIDDLE, "documents").filter(C.crc_mod("doc_id", 3) != 1))
    refs = [(lang, text[:size] if lang == "de" else text) for lang, text in refs]
    found = langid.identify(docs, refs, ["doc_id", "lang"])
    right = dict(found.groupBy(F.col("lang") == "de").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect())
    assert right[True] > 0.96 and right[False] > 0.96
    german = docs.filter("lang = 'de'")
    assert langid.accepted(german, refs).count() == german.count()


def test_language_of_odd_rows(odd, none):
    refs = langid.references(odd)
    found = [tuple(r) for r in langid.identify(odd, refs, ["doc_id", "source", "score"]).select("doc_id", "lang_pred", "score", "source").collect()]
    assert len(found) == odd.count()
    assert {d for d, lang, *_ in found if lang == "und"} == {2, 3, 4, 5}
    assert all(s == 0.0 for _, lang, s, _ in found if lang == "und")
    assert {lang for d, lang, *_ in found if d in (1, 9)} == {"en"}
    assert langid.identify(none, refs, none.columns).count() == 0
    assert {r[0] for r in langid.identify(odd, langid.references(none), ["doc_id"]).select("lang_pred").collect()} == {"und"}


def test_references_are_bounded_and_ignore_rows_without_language(odd):
    refs = dict(langid.references(odd, rows=2, window=16))
    assert set(refs) == {"de", "en", "fr"} and all(len(t) <= 2 * 17 for t in refs.values())


# toxicity ---------------------------------------------------------------------------------------------------------------

def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(3)
    counts = np.zeros(toxicity.SIZE**toxicity.ORDER)
    counts[rng.integers(0, len(counts), 4000)] = rng.integers(1, 5, 4000)
    shared = np.full(toxicity.SIZE, 1 / toxicity.SIZE)
    p = toxicity.kneser_ney(counts, shared)
    assert p.min() > 0 and np.allclose(p.sum(axis=-1), 1.0)


def test_grams_start_anew_with_each_text():
    s, off = np.array([0, 3, 4, 0, 5, 0, 7]), np.array([0, 3, 5, 7])
    n = toxicity.SIZE
    assert toxicity.grams(s, off, 3).tolist() == [0, 3, 3 * n + 4, 0, 5, 0, 7]


def test_toxic_texts_are_found_on_held_out_rows(spark):
    rows = []
    for k in range(400):
        words = [f"{a}{b}" for a, b in zip("lo mi na ru te".split() * 6, np.random.default_rng(k).choice("ban kel sor tim".split(), 30))]
        if k % 4 == 0:
            words[k % 25] = ("grimwort", "snarlak")[k % 8 == 0]
        rows.append((k, " ".join(words), k % 4 == 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    labels = docs.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    model = toxicity.learn(docs, labels.filter(C.crc_mod("doc_id", 4) != 2))
    got = toxicity.scored(docs, model, ["doc_id", "toxic"]).filter(C.crc_mod("doc_id", 4) == 2).collect()
    assert len(got) > 50 and all((r["score"] >= 0.3) == r["toxic"] for r in got)


def test_toxicity_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 0), (1, 0), (6, 1), (7, 1), (8, 0), (9, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(odd, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(odd, model, odd.columns).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert got[2] == got[3] == got[4] == got[5] == pytest.approx(0.5)
    assert toxicity.scored(none, model, none.columns).count() == 0
    alone = toxicity.learn(odd, labels.filter("toxic = 1"))
    assert {r["score"] for r in toxicity.scored(odd, alone, ["doc_id"]).collect()} == {1.0}
    assert {r["score"] for r in toxicity.scored(odd, toxicity.learn(none, labels.filter("false")), ["doc_id"]).collect()} == {0.0}


# language model ---------------------------------------------------------------------------------------------------------

def test_forward_and_expectations_are_sums_over_all_paths():
    rng = np.random.default_rng(1)
    s, m = 3, 4
    first, move = rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s)
    emit = rng.dirichlet(np.ones(m), s).T
    seqs = [[0, 1, 3, 2], [2], [1, 1, 0]]
    flat, at = np.concatenate(seqs), np.cumsum([0, *map(len, seqs)])
    lanes = hmm.Lanes(flat, at[:-1], np.diff(at))
    starts, moves, emitted, likely = np.zeros(s), np.zeros((s, s)), np.zeros((m, s)), []
    for q in seqs:
        paths = list(itertools.product(range(s), repeat=len(q)))
        p = np.array([first[z[0]] * math.prod(move[a, b] for a, b in zip(z, z[1:])) * math.prod(emit[x, k] for x, k in zip(q, z)) for z in paths])
        likely.append(math.log(p.sum()))
        for z, w in zip(paths, p / p.sum()):
            starts[z[0]] += w
            for a, b in zip(z, z[1:]):
                moves[a, b] += w
            for x, k in zip(q, z):
                emitted[x, k] += w
    assert np.allclose(hmm.forward(lanes, first, move, emit), likely)
    for got, want in zip(hmm.expectations(lanes, first, move, emit), (starts, moves, emitted)):
        assert np.allclose(got, want)


def base_scores(rows):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None] for k, (_, t) in enumerate(rows)}
    count = Counter(w for k, (d, _) in enumerate(rows) if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for w in words[k])
    n, v = sum(count.values()), len(count)
    return n, [(d, len(words[k]), sum(count[w] > 0 for w in words[k]), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[k])) for k, (d, _) in enumerate(rows)]


def run_hmm(docs):
    learned = docs.filter(C.crc_mod("doc_id", 7) != 2)
    vocab = hmm.vocabulary(learned)
    lexicon = hmm.Lexicon(vocab)
    return lexicon, hmm.scored(docs, vocab, lexicon, hmm.train(learned, lexicon), ["doc_id"]).collect()


@pytest.mark.parametrize("known", [hmm.KNOWN, 40])
def test_language_model_beats_the_base_and_counts_exactly(spark, monkeypatch, known):
    monkeypatch.setattr(hmm, "KNOWN", known)  # with few known words the counts come by the join
    monkeypatch.setattr(hmm, "WORDS", min(hmm.WORDS, known // 2))
    docs = C.table(spark, SMALL, "documents").select("doc_id", "text")
    lexicon, got = run_hmm(docs)
    total, want = base_scores([tuple(r) for r in docs.collect()])
    assert lexicon.total == total
    seen = {r["doc_id"]: r for r in got}
    for d, n, k, b in want:
        assert (seen[d]["n_tokens"], seen[d]["n_known"]) == (n, k) and seen[d]["base_score"] == pytest.approx(b)
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_of_odd_rows(odd, none):
    lexicon, got = run_hmm(odd)
    _, want = base_scores([(r["doc_id"], r["text"]) for r in odd.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for r, w in zip(sorted((tuple(x) for x in got), key=key), sorted(want, key=key)):
        assert r[:3] == w[:3] and r[3] == pytest.approx(w[3]) and r[4] < 0
    assert run_hmm(none)[1] == []
    empty = odd.filter("doc_id is null")
    assert [(r["base_score"], r["n_known"]) for r in run_hmm(empty)[1]] == [(0.0, 0)]


# decontamination --------------------------------------------------------------------------------------------------------

def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        before, row[0] = row[:], i
        for j, v in enumerate(text, 1):
            row[j] = min(before[j - 1] + (w != v), before[j] + 1, row[j - 1] + 1)
    return min(row)


def test_distance_is_the_best_over_all_stretches():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 15)).astype(np.uint64)
        assert decontaminate.distance(a, b)[0] == edit_distance(a.tolist(), b.tolist())


def test_edited_items_are_found_and_nothing_else(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(vocab, 12 + 3 * k))) for k in range(12)]
    docs, want = [], set()
    for d in range(150):
        words, item = rng.choice(vocab, 60 + d).tolist(), int(rng.integers(0, 12))
        if d % 3:
            w = items[item][1].split()
            for _ in range(int((0, 0.08, 0.15)[d % 3] * len(w))):
                p, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
                w[p:p + (kind > 0)] = ["zz"] if kind < 2 else []
            at = int(rng.integers(0, len(words)))
            words[at:at] = [x.upper() + "," for x in w]
            want.add((d, item))
        docs.append((d, " ".join(words)))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs <= want and len(pairs) >= 0.98 * len(want)
    text, item = dict(docs), dict(items)
    for r in got:
        words = [w.strip(",").lower() for w in text[r["doc_id"]].split()]
        assert r["distance"] == edit_distance(item[r["item_id"]].split(), words)
        assert edit_distance(item[r["item_id"]].split(), words[r["first_word"]:r["first_word"] + r["n_words"]]) == r["distance"]


def searched(items, docs):
    x, at = decontaminate.word_hashes(*C.text_of(batch([" ".join(d) for d in docs])))
    return decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)]).search(x, at)


def test_items_with_words_dropped_are_found_alone_and_at_the_end_of_a_text():
    rng = np.random.default_rng(4)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate((8, 10, 12, 15, 18, 20, 22, 27, 33, 41, 51, 63))]
    docs, want = [], {}
    for k, w in enumerate(items):
        for n in range(1, len(w) // 4 + 1):
            for rest in (w[:-n], w[n:], [w[j] for j in sorted(rng.permutation(len(w))[n:])]):
                for before in ([], ["other", "words", "first"]):
                    want[len(docs), k] = n
                    docs.append(before + rest)
    assert {p: d for p, (d, _, _) in searched(items, docs).items()} == want


def test_recall_does_not_depend_on_the_length_of_the_item():
    rng = np.random.default_rng(8)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate((8, 20, 50, 100, 200, 400))]
    docs, want = [], set()
    for k, item in enumerate(items):
        for _ in range(20):
            w = list(item)
            for _ in range(len(w) // 4):
                p, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
                w[p:p + (kind > 0)] = ["zz"] if kind < 2 else []
            want.add((len(docs), k))
            docs.append([f"before{j}" for j in range(len(docs) % 3 * 10)] + w + ["after"] * 60)
    found = searched(items, docs)
    assert set(found) == want
    assert all(found[t, k][0] == edit_distance(items[k], docs[t]) for t, k in want if k < 4)


@pytest.mark.parametrize("rate, least", [(0.15, 0.99), (0.25, 0.98)])
def test_recall_of_the_walks_alone_by_length_and_at_the_end_of_a_text(rate, least):
    rng = np.random.default_rng(9)
    for n in (8, 12, 20, 50, 100, 200, 400):
        items = [[f"i{k}w{j}" for j in range(n)] for k in range(3)]
        docs, want = [], set()
        for d in range(100):
            w = list(items[d % 3])
            for _ in range(int(rate * n)):
                p, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
                w[p:p + (kind > 0)] = [f"z{rng.integers(1 << 30)}"] if kind < 2 else []
            want.add((d, d % 3))
            docs.append([f"b{j}" for j in range(d % 7)] + w + (["after"] * 90 if d % 2 else []))
        x, at = decontaminate.word_hashes(*C.text_of(batch([" ".join(d) for d in docs])))
        index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
        found = set(index.search(x, at, complete=False))
        assert found <= want and len(found) >= least * len(want), (n, len(found))
        assert set(index.search(x, at)) == want


def test_pairs_found_are_those_of_brute_force():
    rng = np.random.default_rng(6)
    items = [[f"w{v}" for v in rng.integers(0, 6, n)] for n in range(1, 25)]
    docs = [[f"w{v}" for v in rng.integers(0, 7, n)] for n in rng.integers(0, 40, 120)]
    want = {(t, i): d for t, doc in enumerate(docs) for i, w in enumerate(items) if (d := edit_distance(w, doc)) <= decontaminate.limit(len(w))}
    assert {p: d for p, (d, _, _) in searched(items, docs).items()} == want


def test_decontamination_of_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the LAZY dog"), (2, None), (3, ""), (4, "x"), (5, "!!"), (None, "hund"), (6, "haus " * 3)],
                                  "item_id int, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(odd, bench).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (7, 4, 0), (9, 1, 0)]
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and clean.schema == odd.schema
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 2, 3, 4, 5, 6, 8]
    assert decontaminate.leaks(none, bench).count() == decontaminate.leaks(odd, bench.filter("false")).count() == 0
    assert decontaminate.clean(odd, bench.filter("false")).count() == odd.count()


def test_items_in_several_blocks(odd, spark, monkeypatch):
    bench = spark.createDataFrame([(k, "quick brown fox jumps over the lazy dog") for k in range(9)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    assert decontaminate.leaks(odd, bench).groupBy("item_id").count().filter("count = 3").count() == 9
    assert {1, 9}.isdisjoint(r["doc_id"] for r in decontaminate.clean(odd, bench).collect())
