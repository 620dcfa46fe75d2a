"""Language identification by cross-parsing entropy.

Per language a bounded reference text is drawn from labelled rows and indexed by a suffix automaton.  A text is
parsed greedily into the longest pieces that occur in the reference; a phrase costs the bits of one reference position and
of its length, a symbol that the reference lacks also those of one symbol of the alphabet.  The cost per symbol estimates the cross
entropy, and the language with the least wins; a reference of few symbols has cheap positions, but short phrases and many lacking symbols.

Text is lower-cased and every run of non-letters becomes one separator.  The parse restarts every ``SEGMENT`` symbols
in all languages alike, so that the segments of a text (all of them) advance side by side.

Defined results: null text or no letter gives ``und`` and score 0; equal rates give the smaller language name; with no
labelled row at all every text is ``und``; null languages and rows of null text teach nothing; repeated rows count each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heightfield.llm import common as C

# Bound of the training sample: rows per language, and symbols of the one window (at a hashed place) each row gives.
ROWS, WINDOW = 160, 256
# Symbols after which the parse restarts.
SEGMENT = 256
# Bits for the length of a phrase.
LENGTH = 2
# Letters told apart; beyond that many, several letters share a symbol (in references and texts alike).
ALPHABET = 400
# A text of at least this many letters whose phrases are shorter than two letters on average is in none of the languages,
# provided that the reference of its language is long enough to tell (in bits of a position).
CERTAIN, LOST, TELLING = 100, 0.5, 12


def references(labelled: DataFrame, rows: int = ROWS, window: int = WINDOW) -> list[tuple[str, str]]:
    """(language, reference text): one window of each of the ``rows`` rows with the smallest hashes, per language."""
    h = F.xxhash64(F.col("text"))
    span = F.greatest(F.length("text") - window, F.lit(0)) + 1
    drawn = labelled.filter(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)).select(
        "lang", h.alias("h"), F.substring(F.col("text"), (F.pmod(h, span) + 1).cast("int"), F.lit(window)).alias("w"))
    order = Window.partitionBy("lang").orderBy("h", "w")
    best = drawn.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= rows)
    found: dict[str, list[str]] = {}
    for r in best.select("lang", "k", "w").orderBy("lang", "k").collect():  # at most rows * window characters per language
        found.setdefault(r["lang"], []).append(r["w"])
    return [(lang, " ".join(parts)) for lang, parts in sorted(found.items())]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols."""
    trans, link, size, last = [{}], [-1], [0], 0
    for c in text.tolist():
        now = len(trans)
        trans.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = now
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return trans


def parse_table(trans: list[dict[int, int]], width: int) -> np.ndarray:
    """Greedy parsing as one table: entry = 4 * (next state * width) + phrases that end at this symbol.

    Symbol width - 1 is the end of a segment; symbols without a transition from the root are phrases of their own.
    """
    states = np.repeat(np.arange(len(trans)), [len(t) for t in trans])
    symbols = np.fromiter((c for t in trans for c in t), np.int64, len(states))
    targets = np.fromiter((v for t in trans for v in t.values()), np.int64, len(states))
    root = np.full(width, 0, np.int64)
    alone = np.ones(width, np.int64)
    for c, v in trans[0].items():
        root[c], alone[c] = v, 0
    root[-1], alone[-1] = 0, 0
    table = np.tile(root * width * 4 + alone + 1, (len(trans), 1))
    table[0] -= 1
    table[states, symbols] = targets * width * 4
    return table.astype(np.int32).ravel()


class Parser:
    """Counts phrases of every text against every reference."""

    def __init__(self, refs: list[tuple[str, str]]):
        letter, lower = C.letter_codes()
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for _, t in refs]
        used = np.unique(np.concatenate([lower[p[letter[p]]] for p in points])) if refs else np.zeros(0, np.uint32)
        # separator 0, letters of the references 1.., any other letter, end of a segment
        fold = min(len(used), ALPHABET)
        self.width = fold + 3
        codes = np.zeros(len(letter), np.uint16)
        at = np.searchsorted(used, lower)
        known = letter & (at < len(used))
        known[known] = used[at[known]] == lower[known]
        codes[letter] = fold + 1
        codes[known] = at[known] % max(fold, 1) + 1
        self.codes = codes
        self.langs = [lang for lang, _ in refs]
        seqs = [self.symbols(p, np.array([0, len(p)]))[0] for p in points]
        self.tables = [parse_table(automaton(s), self.width) for s in seqs]
        self.bits = np.array([np.log2(max(len(s), 2)) for s in seqs])
        self.lacks = np.ones((len(seqs), self.width), bool)
        for j, s in enumerate(seqs):
            self.lacks[j, s] = False

    def symbols(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with one separator for each run of non-letters, and the offsets of each text."""
        s = self.codes[points]
        gap = s == 0
        stay = np.ones(len(s), bool)
        stay[1:] = ~(gap[1:] & gap[:-1])
        heads = off[:-1][off[:-1] < len(s)]
        stay[heads] = ~gap[heads]
        before = np.zeros(len(s) + 1, np.int64)
        np.cumsum(stay, out=before[1:])
        return s[stay], before[off]

    def counts(self, s: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases per text and language."""
        size = np.diff(off)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = off[owner] + nth * SEGMENT
        stop = np.minimum(start + SEGMENT, off[owner + 1])
        out = np.zeros((len(size), len(self.langs)), np.int64)
        if not len(owner):
            return out
        order = np.argsort(start - stop, kind="stable")  # long segments first, so that those still open are a prefix
        owner, start, length = owner[order], start[order], (stop - start)[order]
        longest = int(length[0])
        live = np.searchsorted(-length, -np.arange(longest), side="left")
        lanes = np.full((longest + 1, len(owner)), self.width - 1, np.int32)
        for k in range(longest):
            lanes[k, :live[k]] = s[start[:live[k]] + k]
        for j, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int32)
            found = np.zeros(len(owner), np.int32)
            for k in range(longest + 1):
                n = live[k - 1] if k else len(owner)
                v = table[state[:n] + lanes[k, :n]]
                found[:n] += v & 3
                state[:n] = v >> 2
            out[:, j] = np.bincount(owner, found, len(size)).astype(np.int64)
        return out

    def literals(self, s: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Symbols per text that each language's reference lacks."""
        out = np.zeros((len(off) - 1, len(self.langs)), np.int64)
        for j, lacks in enumerate(self.lacks):
            out[:, j] = np.bincount(np.searchsorted(off, np.flatnonzero(lacks[s]), side="right") - 1, minlength=len(off) - 1)
        return out

    def __call__(self, batch: pa.RecordBatch):
        data, off = C.text_of(batch)
        points, off = C.code_points(data, off)
        s, off = self.symbols(points, off)
        n = np.diff(off)
        letters = np.concatenate([[0], np.cumsum(s != 0)])
        letters = letters[off[1:]] - letters[off[:-1]]
        if not self.langs:
            return self.answer(np.full(len(n), -1), np.zeros(len(n)), np.zeros(len(n)), letters)
        phrases = self.counts(s, off)
        rate = (phrases * (self.bits + LENGTH) + self.literals(s, off) * np.log2(self.width)) / np.maximum(n, 1)[:, None]
        best = np.argmin(rate, axis=1)
        row = np.arange(len(n))
        first = rate[row, best]
        if rate.shape[1] > 1:
            rest = rate.copy()
            rest[row, best] = np.inf
            second = rest.min(axis=1)
        else:
            second = np.maximum(self.bits[0], first)
        score = np.where(first + second > 0, second / np.maximum(first + second, 1e-300), 0.5)
        none = letters == 0
        rate = np.where(none | (self.bits[best] < TELLING), 0.0, phrases[row, best] / np.maximum(n, 1))
        return self.answer(np.where(none, -1, best), np.where(none, 0.0, score), rate, letters)

    def answer(self, best, score, rate, letters):
        names = np.array([*self.langs, "und"], dtype=object)
        return [pa.array(names[best], pa.string()), pa.array(score), pa.array(rate), pa.array(letters)]


_PARSERS: dict[str, Parser] = {}


def parser(refs: list[tuple[str, str]]) -> Parser:
    """The parser of these references, built once per Python worker."""
    key = hashlib.sha256(repr(refs).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(refs)
    return _PARSERS[key]


def identify(docs: DataFrame, refs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """``keep`` plus lang_pred, score (0.5 to 1, the share of the runner-up's rate; 0 for und), phrase_rate (0 where the language has
    too little reference to tell) and n_letters."""
    return C.extend(docs, lambda batch: parser(refs)(batch), "lang_pred string, score double, phrase_rate double, n_letters bigint", keep)


def accepted(docs: DataFrame, refs: list[tuple[str, str]]) -> DataFrame:
    """Documents in one of the languages, with their own columns: a language was found and, for texts and references long enough to tell,
    its reference explains the text."""
    C.bounded(docs.sparkSession)

    def run(batches):
        for block in C.blocks(batches):
            lang, _, rate, letters = (a.to_numpy(zero_copy_only=False) for a in parser(refs)(block))
            yield block.filter(pa.array((lang != "und") & ~((letters >= CERTAIN) & (rate > LOST))))

    return docs.mapInArrow(run, docs.schema)
