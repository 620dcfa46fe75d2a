"""A hidden Markov language model over words.

Latent states emit symbols: the commonest words each by itself, the end of a text, and for all other words the class of their spelling; inside a class
a word has its share of the corpus counts, in all states alike.  Baum-Welch expectations are computed text by text and summed
over all partitions; the scaled forward recursion then gives the exact probability of a whole text.

Word counts cover the whole training part and stay in Spark: only the ``KNOWN`` commonest words travel to the tasks, the counts of
the others are joined.  In training, texts are followed in stretches of ``STRETCH`` tokens; in scoring they are never cut.
The states start from a bounded sample, whose size is a parameter, and are then trained on everything.

Defined results: null, empty and wordless texts are one end token; words unseen in training share one place per class; without training
text every score is 0; repeated rows count and are scored each; a null id is never held out nor learned from.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.llm import common as C

STATES, PASSES = 8, 2
# Steps of an octave in which counts are told apart when the commonest words are chosen.
LEVELS = 12
# Commonest words that are symbols of their own, commonest words whose counts the tasks hold, and classes of spelling.
WORDS, KNOWN, CLASSES = 16_384, 262_144, 1024
# Rows and rounds of the start, tokens of a training stretch, weight of the corpus counts in each state.
START_ROWS, START_ROUNDS, STRETCH, PRIOR = 300, 12, 1024, 60.0
# Tokens learned from and scored together in a task.
LEARNED, TOGETHER = 300_000, 1_000_000
# The word hash that stands for the end of a text.
END = np.uint64(0x0E4D0E4D0E4D0E4D)


def read(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and classes of spelling of a block, an end after each text, and the offsets of the texts."""
    data, off = C.text_of(block)
    h, starts, ends, at = C.words(data, off)
    low = C.LOWER[data].astype(np.uint64)
    shape = low[starts] | low[ends - 1] << np.uint64(8) | low[np.maximum(ends - 2, starts)] << np.uint64(16) | np.minimum(ends - starts, 12).astype(np.uint64) << np.uint64(24)
    kind = (C.mix(shape) % np.uint64(CLASSES)).astype(np.int64)
    return np.insert(h, at[1:], END), np.insert(kind, at[1:], -1), at + np.arange(len(at))


def _counted(batches):
    """Word counts of about ``TOGETHER`` tokens at a time."""
    held, size = [], 0

    def flush():
        h, first, n = np.unique(np.concatenate([x for x, _ in held]), return_index=True, return_counts=True)
        kind = np.concatenate([k for _, k in held])[first]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind), pa.array(n)], names=["h", "kind", "n"])

    for block in C.blocks(batches):
        h, kind, _ = read(block)
        held.append((h, kind))
        size += len(h)
        if size >= TOGETHER:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def vocabulary(texts: DataFrame) -> DataFrame:
    """(h, kind, n): every word of the texts (and the end), its class and count; a stored table."""
    C.bounded(texts.sparkSession)
    seen = texts.select("text").mapInArrow(_counted, "h bigint, kind bigint, n bigint")
    return C.stored(seen.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")), "vocabulary")


class Lexicon:
    """What tasks hold of the vocabulary, of bounded size."""

    def __init__(self, vocab: DataFrame):
        n = F.col("n")
        self.total, self.distinct = (int(x or 0) for x in vocab.agg(F.sum(n), F.count(n)).first())
        level = F.floor(F.log2("n") * LEVELS)  # counts by steps of a twelfth of an octave: a few hundred rows at any size
        heap = vocab.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
        many = np.cumsum([r["count"] for r in heap])

        def least(room: int) -> int:  # words of this level and above fit the room
            fits = int(np.searchsorted(many, room, side="right"))
            return heap[fits - 1]["level"] if fits else (heap[0]["level"] + 1 if heap else 0)

        common, own = least(KNOWN), least(WORDS)
        end = F.col("h") == int(END.view(np.int64))
        got = vocab.withColumn("level", level).filter((F.col("level") >= common) | end).toArrow()
        h, c = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
        order = np.argsort(h)
        self.hash, self.count = h[order], c[order]
        self.away = (level < common) & ~end  # words whose counts only the table has
        mine = (got.column("level").to_numpy()[order] >= own) & (self.hash != END)
        self.symbol = np.full(len(self.hash), -1, np.int64)
        self.words = int(mine.sum())
        self.symbol[mine] = np.arange(self.words)
        self.symbol[self.hash == END] = self.words
        self.symbols = self.words + 1 + CLASSES
        # words in a class, and what they count
        self.mass = np.ones(CLASSES, np.int64)
        class_count = np.zeros(CLASSES, np.int64)
        for r in vocab.filter((level < own) & ~end).groupBy("kind").agg(F.sum(n).alias("t"), F.count(n).alias("v")).collect():  # one row per class
            self.mass[r["kind"]] += r["t"] + r["v"]
            class_count[r["kind"]] = r["t"]
        self.weight = np.ones(self.symbols)
        self.weight[self.symbol[self.symbol >= 0]] += self.count[self.symbol >= 0]
        self.weight[self.words + 1:] += class_count
        self.weight /= self.weight.sum()

    def carried(self) -> Lexicon:
        """The same without what belongs to the driver's session."""
        out = copy.copy(self)
        out.away = None
        return out

    def look(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each token, and its count (-1 where the tasks do not hold it)."""
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        held = self.hash[at] == h if len(self.hash) else np.zeros(len(h), bool)
        symbol = np.where(held, self.symbol[at], -1) if len(self.hash) else np.full(len(h), -1)
        symbol = np.where(symbol < 0, np.where(kind < 0, self.words, self.words + 1 + kind), symbol)
        return symbol, np.where(held, self.count[at], -1) if len(self.hash) else np.full(len(h), -1)


class Lanes:
    """Sequences side by side, the longest first, so that those still open at a step are a prefix."""

    def __init__(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        longest = int(self.length[0]) if len(length) else 0
        self.live = np.searchsorted(-self.length, -np.arange(longest), side="left")
        self.base = np.concatenate([[0], np.cumsum(self.live)])
        begin = start[self.order]
        self.flat = np.empty(int(self.base[-1]), np.int64)
        for t in range(longest):
            self.flat[self.base[t]:self.base[t + 1]] = symbols[begin[:self.live[t]] + t]


def forward(lanes: Lanes, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each sequence, in the order given; ``emit`` has a row per symbol."""
    total = np.zeros(len(lanes.order))
    a = None
    for t, n in enumerate(lanes.live):
        a = (np.broadcast_to(first, (n, len(first))) if t == 0 else a[:n] @ move) * emit[lanes.flat[lanes.base[t]:lanes.base[t + 1]]]
        scale = a.sum(axis=1)
        a /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.zeros(len(total))
    out[lanes.order] = total
    return out


def expectations(lanes: Lanes, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (symbols by states) of the sequences."""
    s, base, live = len(first), lanes.base, lanes.live
    alpha, scale = np.empty((len(lanes.flat), s)), np.empty(len(lanes.flat))
    for t, n in enumerate(live):
        here = slice(base[t], base[t + 1])
        a = (np.broadcast_to(first, (n, s)) if t == 0 else alpha[base[t - 1]:base[t - 1] + n] @ move) * emit[lanes.flat[here]]
        scale[here] = a.sum(axis=1)
        alpha[here] = a / scale[here][:, None]
    moves = np.zeros((s, s))
    beta = np.ones((int(live[-1]) if len(live) else 0, s))
    for t in range(len(live) - 1, -1, -1):
        here = slice(base[t], base[t + 1])
        own = np.ones((live[t], s))
        if t + 1 < len(live):
            n = live[t + 1]
            after = slice(base[t + 1], base[t + 2])
            ahead = emit[lanes.flat[after]] * beta / scale[after][:, None]
            moves += alpha[base[t]:base[t] + n].T @ ahead
            own[:n] = ahead @ move.T
        beta = own
        alpha[here] *= beta  # the chance of each state, given the whole sequence
    emitted = np.stack([np.bincount(lanes.flat, alpha[:, k], len(emit)) for k in range(s)], axis=1)
    return alpha[:base[1]].sum(axis=0) if len(live) else np.zeros(s), moves * move, emitted


def stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    parts = -(-n // STRETCH)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(at[:-1], parts) + nth * STRETCH
    return start, np.minimum(STRETCH, np.repeat(at[1:], parts) - start)


class Model:
    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.first, self.move, self.emit = first, move, emit

    @staticmethod
    def of(starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray, weight: np.ndarray) -> Model:
        """The most likely parameters for expected counts, with the corpus shares as prior of every state's emissions."""
        first = starts + 1.0
        move = moves + 0.5
        emit = emitted + PRIOR * weight[:, None]
        return Model(first / first.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _start(texts: DataFrame, lexicon: Lexicon) -> Model:
    """States from a bounded sample of rows, drawn by hash."""
    rows = texts.select("text", F.xxhash64("text").alias("k")).filter(F.length("text").between(1, 1 << 16)).orderBy("k").limit(START_ROWS).select("text").toArrow()
    rng = np.random.default_rng(11)
    block = pa.RecordBatch.from_arrays([rows.column("text").combine_chunks()], names=["text"]) if rows.num_rows else None
    noise = np.exp(rng.normal(size=(lexicon.symbols, STATES)))
    emit = lexicon.weight[:, None] * noise
    model = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), emit / emit.sum(axis=0))
    if block is None:
        return model
    h, kind, at = read(block)
    lanes = Lanes(lexicon.look(h, kind)[0], *stretches(at))
    for _ in range(START_ROUNDS):
        model = Model.of(*expectations(lanes, model.first, model.move, model.emit), lexicon.weight)
    return model


def train(texts: DataFrame, lexicon: Lexicon, passes: int = PASSES) -> Model:
    """Baum-Welch: every pass sums expected counts over all texts in Spark."""
    C.bounded(texts.sparkSession)
    lexicon = lexicon.carried()
    model = _start(texts, lexicon)
    names = [f"s{k}" for k in range(STATES)]
    schema = "row int, " + ", ".join(f"{s} double" for s in names)
    for _ in range(passes):
        def expected(batches, model=model):
            sums, held, size = None, [], 0

            def add(sums):
                at = np.concatenate([np.zeros(1, np.int64), *(a[1:] + n for (_, a), n in zip(held, np.cumsum([0, *(len(x) for x, _ in held)])))])
                got = expectations(Lanes(np.concatenate([x for x, _ in held]), *stretches(at)), model.first, model.move, model.emit)
                return got if sums is None else tuple(a + b for a, b in zip(sums, got))

            for block in C.blocks(batches):
                h, kind, at = read(block)
                held.append((lexicon.look(h, kind)[0], at))
                size += len(h)
                if size >= LEARNED:
                    sums, held, size = add(sums), [], 0
            if held:
                sums = add(sums)
            if sums is not None:
                full = np.flatnonzero(sums[2].any(axis=1))
                rows = np.concatenate([full, -1 - np.arange(STATES), [-1 - STATES]]).astype(np.int32)
                values = np.concatenate([sums[2][full], sums[1], sums[0][None]])
                yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(v) for v in values.T)], names=["row", *names])

        got = texts.select("text").mapInArrow(expected, schema).groupBy("row").agg(*[F.sum(s).alias(s) for s in names]).toArrow()  # a row per symbol
        if not got.num_rows:
            return model
        row, values = got.column("row").to_numpy(), np.stack([got.column(s).to_numpy() for s in names], axis=1)
        emitted, moves, starts = np.zeros((lexicon.symbols, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
        emitted[row[row >= 0]] = values[row >= 0]
        for r, v in zip(row[row < 0].tolist(), values[row < 0]):
            if r == -1 - STATES:
                starts = v
            else:
                moves[-1 - r] = v
        model = Model.of(starts, moves, emitted, lexicon.weight)
    return model


def scored(docs: DataFrame, vocab: DataFrame, lexicon: Lexicon, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` plus n_tokens, n_known, base_score and score of every text."""
    spark = docs.sparkSession
    C.bounded(spark)
    keep = [c for c in keep if c not in ("n_tokens", "n_known", "base_score", "score")]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint, known bigint, logs double, score double, rare array<bigint>"])
    carried = list(dict.fromkeys([*keep, "text"]))
    class_log = np.log10(lexicon.mass)
    lexicon, away = lexicon.carried(), lexicon.away

    def finish(held):
        at = np.concatenate([[0], np.cumsum([len(s) for *_, s in held])])
        length = np.concatenate([np.diff(a) for _, a, *_ in held])
        start = np.concatenate([[0], np.cumsum(length)])[:-1]
        total = forward(Lanes(np.concatenate([s for *_, s in held]), start, length), model.first, model.move, model.emit) / np.log(10)
        done = 0
        for batch, a, known, logs, plus, (rare, rare_at), _ in held:
            n = batch.num_rows
            arrays = [*(batch.column(carried.index(c)) for c in keep), pa.array(np.diff(a)), pa.array(known), pa.array(logs), pa.array(total[done:done + n] + plus),
                      pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(rare.view(np.int64)))]
            done += n
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_tokens", "known", "logs", "score", "rare"])

    def run(batches):
        held, size = [], 0
        for block in C.blocks(batches):
            h, kind, at = read(block)
            symbol, count = lexicon.look(h, kind)
            owner = np.repeat(np.arange(block.num_rows), np.diff(at))
            seen = count >= 0
            value = np.log10(np.maximum(count, 0) + 1.0)
            spelled = symbol > lexicon.words  # tokens emitted as a class: the word's share in it
            n = block.num_rows
            plus = np.bincount(owner[spelled], value[spelled] - class_log[kind[spelled]], n)
            away = ~seen & (kind >= 0)
            held.append((block, at, np.bincount(owner[seen], minlength=n), np.bincount(owner, value, n), plus,
                         (h[away], np.concatenate([[0], np.cumsum(np.bincount(owner[away], minlength=n))])), symbol))
            size += len(h)
            if size >= TOGETHER:
                yield from finish(held)
                held, size = [], 0
        if held:
            yield from finish(held)

    first = C.stored(docs.select(*[F.col(f"`{c}`") for c in carried]).mapInArrow(run, schema), "scored").withColumn("at", F.monotonically_increasing_id())
    first = C.stored(first, "scored")
    # counts of the words that the tasks do not hold: joined by word, summed by text
    asked = first.select("at", F.explode("rare").alias("h")).groupBy("at", "h").count()
    told = vocab.filter(away).select("h", "n")
    answer = asked.join(told, "h").groupBy("at").agg(F.sum("count").alias("more"), F.sum(F.col("count") * F.log10(F.col("n") + 1.0)).alias("extra"))
    both = first.drop("rare").join(answer, "at", "left")
    extra, more = F.coalesce("extra", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return both.select(*[F.col(f"`{c}`") for c in keep], "n_tokens", (F.col("known") + more).alias("n_known"),
                       (F.col("logs") + extra - F.col("n_tokens") * float(np.log10(lexicon.total + lexicon.distinct + 1))).alias("base_score"),
                       (F.col("score") + extra).alias("score"))
