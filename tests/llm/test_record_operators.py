"""Packing, sharding, spans and neighbours: exact round trips, brute force and odd cases."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heightfield.llm import common as C
from heightfield.llm import neighbours, packing, pii, secrets, sharding, suite

SMALL = "/root/testdata/sf0.001"


# packing ----------------------------------------------------------------------------------------------------------------

def least_bins(sizes, capacity):
    """The optimum by search over set partitions."""
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                place(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1:])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=8))
def test_bounds_enclose_the_optimum(sizes):
    length = np.array(sizes, np.int64)
    bins, offset, fill = packing.best_fit(length, 24)
    assert packing.lower_bound(length, 24) <= least_bins(sizes, 24) <= len(fill)
    assert fill.max(initial=0) <= 24
    for b in range(len(fill)):
        mine = sorted((o, n) for k, o, n in zip(bins, offset, length) if k == b)
        assert [o for o, _ in mine] == list(itertools.accumulate([0, *(n for _, n in mine[:-1])]))


def check_packing(found, rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(suite.tokenizer_path())
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(np.array(ids[k:k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5])
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(want, key=key)
    held = {}
    for r in found:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)


def test_packing_of_the_given_table(spark, monkeypatch):
    docs = C.table(spark, SMALL, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = suite.op3_best_fit_packing(spark, SMALL).collect()
    total = sum(r["length"] for r in found)
    one = check_packing(found, rows, packing.CAPACITY)
    assert one <= -(-total // packing.CAPACITY) + 1
    monkeypatch.setattr(packing, "PIECES", 20)  # many partitions, which then exchange
    many = check_packing(packing.packed(docs, suite.tokenizer_path()).collect(), rows, packing.CAPACITY)
    apart = packing._packed(C.stored(packing.pieces(docs, suite.tokenizer_path()), "t").withColumn("u", F.monotonically_increasing_id()), packing.CAPACITY)
    assert many <= apart.select("part", "bin").distinct().count()


def test_packing_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_packing(packing.packed(odd, suite.tokenizer_path()).collect(), rows, packing.CAPACITY)
    check_packing(packing.packed(odd, suite.tokenizer_path(), capacity=7).collect(), rows, 7)
    assert packing.packed(none, suite.tokenizer_path()).count() == 0


def test_token_ids_are_those_of_whole_texts(spark):
    texts = ["<|endoftext|>x <|startoftext|>", "can't I'LL 12a3 áb e ́", "a b c\x0bd\x0ce\x1cf", "한글 하 ΣΣ Σ", "\t \n", "İx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    check_packing(packing.packed(docs, suite.tokenizer_path()).collect(), list(enumerate(texts)), packing.CAPACITY)


# sharding ---------------------------------------------------------------------------------------------------------------

def test_shards_are_even_and_gapless(spark):
    docs = C.table(spark, "/root/testdata/sf0.01", "documents")
    got = suite.op6_virtual_slots(spark, "/root/testdata/sf0.01").toPandas()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    assert all((r.size_, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in got.rename(columns={"size": "size_"}).itertuples())
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 40 and total.max() - total.min() < 0.01 * total.mean()
    assert got.groupby("vslot")["shard"].nunique().max() == 1 and len(got) == len(text)


def test_rebalancing_edits_only_what_it_must():
    rng = np.random.default_rng(0)
    weight = rng.integers(0, 1000, 256).tolist()
    first = sharding.dealt_in_turn(256, 8)
    second = sharding.rebalance(first, weight, 8)
    total = np.bincount(second, weight, 8)
    assert total.max() - total.min() <= sharding.CLOSE * total.mean() + 1 and sum(a != b for a, b in zip(first, second)) < 80
    assert sharding.rebalance(second, weight, 8) == second or np.ptp(np.bincount(sharding.rebalance(second, weight, 8), weight, 8)) <= np.ptp(total)
    assert sharding.rebalance(first, [0] * 256, 8) == first
    heavy = sharding.rebalance(first, [10**6] + [1] * 255, 8)
    assert set(heavy) == set(range(8))


def test_sharding_of_odd_rows(odd, none):
    got = sharding.sharded(odd, shards=3, slots=16).collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r["doc_id"] == 2} == {16}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.sharded(none).count() == 0


def test_map_has_one_row_per_version_and_slot(spark):
    rows = sharding.map_table(spark, [[0, 1, 0], [0, 1, 1]]).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0), (1, 1, 1), (1, 2, 0), (2, 0, 0), (2, 1, 1), (2, 2, 1)]


# spans ------------------------------------------------------------------------------------------------------------------

def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m.group().split("."))) <= 255]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def plain_secrets(t):
    assign = re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A)
    out = [("assign", *m.span()) for m in assign if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


PIECES = ["a@b.c", "@", "x.y", ".", "1.2.3.4", "256", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111111111111111", " ", "-", "+", "9", "12", "é", "token", "=", ": ",
          "'", "AKIA" + "B" * 16, "AKIA", "a1b2c3d4" * 3, "secret", "API_key", "abcdef", "Kſ", "\n", "x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert sorted(((k, a, b) for a, b, k in pii.base(text)), key=lambda s: (s[1], pii.KINDS.index(s[0]))) == plain_pii(text)
    assert sorted(((k, a, b) for a, b, k, _, _ in secrets.base(text)), key=lambda s: (s[1], secrets.KINDS.index(s[0]))) == plain_secrets(text)


@pytest.mark.parametrize("name,plain", [("op8_personal_data", plain_pii), ("op10_secrets", plain_secrets)])
def test_span_queries_on_the_given_table(spark, name, plain):
    text = {r["doc_id"]: r["text"] or "" for r in C.table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    got = suite.QUERIES[name](spark, SMALL).collect()
    assert len(got) == len(text)
    for r in got:
        base = [f"{k}:{a}:{b}" for k, a, b in plain(text[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(every) and len(every) == len(set(every))
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)


@pytest.mark.parametrize("module", [pii, secrets])
def test_spans_of_odd_rows(odd, none, module):
    got = module.find(odd, module.learn(odd), odd.columns).collect()
    assert len(got) == odd.count() and all(r["spans"] == "" for r in got)
    assert module.find(none, module.learn(none), ["doc_id"]).count() == 0


def test_labelers_add_what_the_patterns_miss(spark):
    rng = np.random.default_rng(5)

    def card():
        body = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return body + next(c for c in "0123456789" if pii.luhn(body + c))

    rows = [(k, f"pay by card {card()} today, order {rng.integers(10**11, 10**12)} sent") for k in range(300)]
    rows += [(1000 + k, f"two cards {card()} {card()} here") for k in range(20)]  # the base pattern joins the two
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs, pii.learn(docs), ["doc_id"]).collect()}
    assert all(got[1000 + k]["spans"] == "card:10:26,card:27:43" and got[1000 + k]["n_card"] == 0 for k in range(20))
    assert sum(got[k]["spans"].count("card") for k in range(300)) <= 350  # an order number may pass for a card


def test_expectation_maximisation_finds_the_reliable_labelers():
    rng = np.random.default_rng(9)
    truth = rng.random(5000) < 0.4
    vote = lambda right: np.where(rng.random(5000) < right, truth, ~truth) * 2 - 1
    votes = np.stack([vote(0.95), vote(0.9), vote(0.55), vote(0.85)], axis=1)
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    chance = pii.Reliability(patterns, n.astype(float)).chance
    belief = np.array([chance[tuple(v)] for v in votes.tolist()])
    assert ((belief > 0.5) == truth).mean() > 0.95


def test_formats_find_bare_credentials(spark):
    rng = np.random.default_rng(6)
    code = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows = [(k, f"some words password={code(18)} and more words 20{rng.integers(10**10, 10**11)}0") for k in range(200)]
    rows += [(1000 + k, f"by itself {code(18)} here") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    formats = secrets.learn(docs)
    got = {r["doc_id"]: r["spans"] for r in secrets.find(docs, formats, ["doc_id"]).collect()}
    assert sum(got[1000 + k] == "assign:10:28" for k in range(20)) >= 18
    assert all(got[k].count("assign") == 1 and "," not in got[k] for k in range(200))
    masked = {r["doc_id"]: r["text"] for r in secrets.redacted(docs, formats).collect()}
    assert masked[0].startswith("some words password=[SECRET] and more") and sum(masked[1000 + k] == "by itself [SECRET] here" for k in range(20)) >= 18


def test_merged_states_keep_the_language():
    a = secrets.Automaton([(0,) * n + (1,) for n in range(1, 40)] * 20)
    assert len(a.edge) < 12
    assert a.log_likelihood((0, 0, 0, 1)) > a.log_likelihood((1, 1, 0, 0))


def test_redaction_keeps_other_columns(odd):
    out = secrets.redacted(odd, secrets.learn(odd))
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))


# neighbours -------------------------------------------------------------------------------------------------------------

def exact(rows, queries, k):
    out = {}
    for q, x in queries:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, v in rows if i != q)
        out[q] = d[:k]
    return out


def test_recall_and_exact_scores(spark):
    v = C.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in v.collect()]
    want = exact(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = suite.op9_projection_forest(spark, "/root/testdata/sf0.1").collect()
    place = dict(rows)
    hit = sum((r["score"], r["vec_id"]) <= (want[r["query_id"]][-1][0] + 1e-9, r["vec_id"]) for r in got)
    assert hit >= 0.9 * sum(map(len, want.values())) and len(got) == sum(map(len, want.values()))
    for r in got:
        assert r["score"] == pytest.approx(float(np.sqrt(((place[r["query_id"]] - place[r["vec_id"]]) ** 2).sum())), abs=1e-12)
    for q in want:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        assert [r["rank"] for r in mine] == list(range(1, 11))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(k % 7), 1.0]) for k in range(100)] + [(200, None), (300, [nan, 1.0]), (400, [0.0, 0.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (700, [1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = v.withColumn("q", F.lit(1)).withColumn("leaf", F.lit(2))
    good = rows[:100]
    got = neighbours.nearest(v, v.filter("vec_id % 10 = 0")).collect()
    want = exact(good, [r for r in good if r[0] % 10 == 0], 10)
    found = {q: [(r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] for q in want}
    assert found == want
    few = neighbours.nearest(v.filter("vec_id < 4"), v.filter("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 3)]
    assert neighbours.nearest(v.filter("false"), v.filter("false")).count() == 0
    assert neighbours.nearest(v, v.filter("vec_id = 400")).count() == 0
    assert neighbours.nearest(v.filter("vec_id = 0"), v.filter("vec_id = 0")).count() == 0


def test_taken_stretches_answer_as_all_spans_would():
    from heightfield.llm import spans as S
    rng = np.random.default_rng(1)
    for _ in range(300):
        given = [(int(a), int(a + rng.integers(1, 9)), "k") for a in rng.integers(0, 60, rng.integers(0, 8))]
        taken, held = S.Taken(given), list(given)
        for a in rng.integers(0, 70, 20).tolist():
            b = a + int(rng.integers(1, 7))
            free = all(b <= x or y <= a for x, y, _ in held)
            assert taken.free(a, b) == free
            if free:
                taken.add(a, b)
                held.append((a, b, "k"))


def test_a_long_text_full_of_values_takes_time_in_proportion():
    import time

    from heightfield.llm import pii, secrets

    def seconds(work, text):
        start = time.process_time()
        work(text)
        return time.process_time() - start

    n = 2000
    text = " ".join(f"user{k}@mail{k % 7}.example token={k:08d}abcdef{k % 97} 10.0.{k % 250}.{k % 199} x" for k in range(n))
    own = secrets.base(text)
    taken = secrets.S.Taken(own)
    small = seconds(lambda t: [taken.free(a, b) for a, b in secrets.candidates(t)], text)
    big = text * 8
    taken = secrets.S.Taken(secrets.base(big))
    assert seconds(lambda t: [taken.free(a, b) for a, b in secrets.candidates(t)], big) < 40 * max(small, 0.005)
    assert len(pii.base(big)) >= 8 * n
