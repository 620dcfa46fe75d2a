"""Secrets in texts: fixed patterns, and probabilistic automata inferred from the credentials these label.

The base patterns label credentials.  Per kind, a bounded sample of the labelled values makes a prefix tree over classes of characters; states whose
continuations agree statistically are merged (ALERGIA: Carrasco and Oncina, 1994) into a probabilistic automaton.  Every candidate,
a run of credential characters with a digit, is scored by its likelihood under each format (automaton and length) against
the candidates of the corpus at large; what a format explains as well as its own credentials is a secret of that kind.

Defined results: null and empty texts have no span; without labelled values of a kind there is no format for it; equal likelihoods
give the kind listed first; spans added by a format never overlap a base span or each other; repeated rows are
treated each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heightfield.llm import common as C
from heightfield.llm import spans as S

# The base patterns and the least sizes of what they find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs; shorter ones fail
LEAST = {"assign": 6, "access": 20, "hex": 24}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
# Bounds of the training sample: labelled values per kind, and the longest value used.
SAMPLE, LONGEST = 600, 256
# Confidence of the merge test, and the share of a format's own held-back values that its threshold admits.
ALPHA, ADMITTED = 0.05, 0.99


def base(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the value) of the base patterns, leftmost and non-overlapping per kind."""
    out = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append((m.start(), m.end(), "assign", m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                out.append((m.start(), m.end(), "access", m.start(), m.end()))
    out.extend((m.start(), m.end(), "hex", m.start(), m.end()) for m in HEX.finditer(text))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if any(c in "0123456789" for c in m.group())]


def symbols(value: str) -> tuple[int, ...]:
    """Digit, a-f, g-z, A-F, G-Z, and every other character by itself."""
    return tuple(0 if "0" <= c <= "9" else 1 if "a" <= c <= "f" else 2 if "g" <= c <= "z" else 3 if "A" <= c <= "F" else 4 if "G" <= c <= "Z" else 5 + ord(c) % 251
                 for c in value)


class Automaton:
    """A deterministic probabilistic automaton merged from a prefix tree."""

    def __init__(self, values: list[tuple[int, ...]]):
        self.count, self.stop, self.edge = [0], [0], [{}]  # visits, endings, symbol -> [state, visits]
        for v in values:
            at = 0
            self.count[0] += 1
            for c in v:
                if c not in self.edge[at]:
                    self.edge[at][c] = [len(self.count), 0]
                    self.count.append(0)
                    self.stop.append(0)
                    self.edge.append({})
                self.edge[at][c][1] += 1
                at = self.edge[at][c][0]
                self.count[at] += 1
            self.stop[at] += 1
        self._merge()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        """Hoeffding's bound on two frequencies; two states seen too rarely do not differ."""
        return abs(x / n - y / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            if not n or not m:
                continue
            if self._differ(self.stop[a], n, self.stop[b], m):
                return False
            for c in {*self.edge[a], *self.edge[b]}:
                ea, eb = self.edge[a].get(c), self.edge[b].get(c)
                if self._differ(ea[1] if ea else 0, n, eb[1] if eb else 0, m):
                    return False
                if ea and eb:
                    todo.append((ea[0], eb[0]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the subtree below ``tree`` (a tree still) onto the state ``into``."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.stop[a] += self.stop[b]
            for c, (to, n) in self.edge[b].items():
                if c in self.edge[a]:
                    self.edge[a][c][1] += n
                    todo.append((self.edge[a][c][0], to))
                else:
                    self.edge[a][c] = [to, n]

    def _merge(self) -> None:
        red, blue = [0], [e[0] for e in self.edge[0].values()]
        came = {e[0]: (0, c) for c, e in self.edge[0].items()}
        while blue:
            b = max(blue, key=lambda s: (self.count[s], -s))
            blue.remove(b)
            for r in red:
                if self._compatible(r, b):
                    parent, c = came[b]
                    self.edge[parent][c][0] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            blue, came = [], {}
            for r in red:
                for c, (to, _) in self.edge[r].items():
                    if to not in red and to not in came:
                        came[to] = (r, c)
                        blue.append(to)
        name = {r: k for k, r in enumerate(red)}
        self.edge = [{c: (name[to], n) for c, (to, n) in self.edge[r].items()} for r in red]
        self.count, self.stop = [self.count[r] for r in red], [self.stop[r] for r in red]

    def log_likelihood(self, value: tuple[int, ...]) -> float:
        """Natural logarithm of the symbols' probability (endings apart); symbols never seen in a state get a share of one visit."""
        at, total = 0, 0.0
        for c in value:
            goes = self.count[at] - self.stop[at]
            to = self.edge[at].get(c)
            total += math.log((to[1] if to else 0.01) / (goes + 1.0))
            at = to[0] if to else 0
        return total


class Format:
    """Automaton and lengths of one kind of credential, and the least score its own credentials reach."""

    def __init__(self, values: list[str]):
        seqs = [symbols(v) for v in values]
        fit, back = seqs[::2], seqs[1::2] or seqs
        self.automaton = Automaton(fit)
        self.lengths, self.n = Counter(map(len, seqs)), len(seqs)
        scores = sorted(self.score(s) for s in back)
        self.least = scores[int((1 - ADMITTED) * len(scores))]

    def score(self, s: tuple[int, ...]) -> float:
        """Log-likelihood per symbol."""
        length = math.log((self.lengths.get(len(s), 0) + 1e-3) / (self.n + 1.0))
        return (self.automaton.log_likelihood(s) + length) / max(len(s), 1)


class Formats:
    """The formats of all kinds and the ordinary candidates they are held against."""

    def __init__(self, labelled: list[tuple[str, str]], ordinary: list[str]):
        self.of = {k: Format(v) for k in KINDS if len(v := [x for kind, x in labelled if kind == k]) >= 8}
        self.ordinary = Format(ordinary) if len(ordinary) >= 8 else None

    def kind_of(self, value: str) -> str | None:
        s = symbols(value)
        best = max(((f.score(s), -i, k) for i, (k, f) in enumerate(self.of.items()) if f.score(s) >= f.least), default=None)
        if best is None or self.ordinary and best[0] <= self.ordinary.score(s):
            return None
        return best[2]

    def find(self, text: str) -> tuple[list, list]:
        """Base spans and all spans, each (start, end, kind, value start, value end)."""
        own = base(text)
        added: list = []
        taken = S.Taken(own)
        for a, b in candidates(text):
            if taken.free(a, b) and (kind := self.kind_of(text[a:b])):
                added.append((a, b, kind, a, b))
        return own, own + added


def _evidence(batch: pa.RecordBatch):
    """What a block of texts shows: labelled values by kind, and candidates outside base spans (kind ``-``)."""
    out = []
    for t in S.texts(batch):
        own = base(t)
        found = [(k, t[a:b]) for _, _, k, a, b in own if b - a <= LONGEST]
        taken = S.Taken(own)
        out.append(found + [("-", t[a:b]) for a, b in candidates(t) if b - a <= LONGEST and taken.free(a, b)])
    kind = pa.struct([("kind", pa.string()), ("value", pa.string())])
    return [pa.array([[{"kind": k, "value": v} for k, v in x] for x in out], pa.list_(kind))]


def learn(docs: DataFrame) -> Formats:
    """Infer the formats: all documents are searched, and per kind the distinct values with the smallest hashes are drawn."""
    seen = C.extend(docs.filter(F.col("text").isNotNull()), _evidence, "found array<struct<kind:string,value:string>>", [])
    values = seen.select(F.inline("found")).distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    drawn = values.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE).orderBy("kind", "k").collect()
    return Formats([(r["kind"], r["value"]) for r in drawn if r["kind"] != "-"], [r["value"] for r in drawn if r["kind"] == "-"])


def find(docs: DataFrame, formats: Formats, keep: list[str]) -> DataFrame:
    """``keep`` plus counts of base spans by kind, their digest and all spans."""
    def work(batch):
        found = [formats.find(t) for t in S.texts(batch)]
        return S.summary([([x[:3] for x in own], [x[:3] for x in every]) for own, every in found], KINDS)

    return C.extend(docs, work, S.summary_fields(KINDS), keep)


def redacted(docs: DataFrame, formats: Formats, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every secret value replaced; n_chars, where there is one, counts the new text."""
    def work(batch):
        out = []
        for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
            if t is not None:
                cut = sorted({(a, b) for *_, a, b in formats.find(t)[1]})
                at, parts = 0, []
                for a, b in cut:
                    if b <= at:
                        continue
                    if a >= at:
                        parts += [t[at:a], mask]
                    at = b
                t = "".join([*parts, t[at:]])
            out.append(t)
        return [pa.array(out, pa.string())]

    done = C.extend(docs, work, "text string", docs.columns)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))
    return done.select(*docs.columns)
