"""Personal data in texts: fixed patterns, and a span classifier trained from labelers that vote.

Candidates are looser than the base patterns (other separators, spelled-out signs).  Labelers vote on each candidate: the base pattern, a
check of the value, a gazetteer of its parts, its shape, the words before it and what touches it.  How often each pattern of
votes occurs over all documents is counted in Spark; expectation-maximisation over these counts estimates how reliable each
labeler is and the chance that a candidate with given votes is personal data.  With these chances as soft labels a
logistic span classifier is fitted on features of the candidates, again from counts, and decides which spans join the base ones.

Defined results: null and empty texts have no span; a corpus without candidates adds nothing; equal spans of two kinds go to
the kind listed first; added spans never overlap a base span or each other; repeated rows are treated each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.llm import common as C
from heightfield.llm import spans as S

# The base patterns, leftmost and non-overlapping per kind.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser candidates.
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{0,2}[0-9]){8,15}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9]{1,4}(?:[\x20()./-]{1,3}[0-9]{2,5}){2,5}(?![0-9])"),
}
# Gazetteers: common ends of domain names, and words that announce a kind.
_ENDS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca"}
_CUES = {
    "email": {"email", "mail", "e-mail", "contact", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "from", "addr", "login"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone", "telefon", "telefono", "cell"},
}
_SIGN = re.compile(r"[@0-9]|[\[(]at[\])]")
LABELERS = 6
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base(text: str) -> list[S.Span]:
    """Base spans; work is linear in the text, so an e-mail is read outwards from its sign."""
    out: list[S.Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and _LOCAL.match(text[lo - 1]):
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if any(d in text for d in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return out


def candidates(text: str) -> list[S.Span]:
    if not _SIGN.search(text):
        return []
    return [(*m.span(), k) for k in KINDS for m in _LOOSE[k].finditer(text)]


def votes(text: str, span: S.Span, own: set[S.Span]) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""
    a, b, kind = span
    value, digits = text[a:b], _digits(text[a:b])
    before = re.findall(r"[A-Za-z-]+", text[max(0, a - 40):a].lower())[-3:]
    pattern = 1 if span in own else 0
    if kind == "email":
        end = re.split(r"[^A-Za-z]+", value)[-1].lower()
        check = 1 if re.search(r"\.\w{2,}$", value) else -1
        gazetteer = 1 if end in _ENDS else -1
        shape = 1 if value.count("@") + len(re.findall(r"[\[(]at[\])]", value)) == 1 and " " not in value else -1
    elif kind == "ip":
        parts = [int(p) for p in re.findall(r"[0-9]+", value)]
        check = 1 if all(p <= 255 for p in parts) else -1
        gazetteer = -1 if parts[0] == 0 else 0
        shape = 1 if " " not in value else -1
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
        shape = 1 if len(digits) in (15, 16) else -1
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if value[:1] in "+0(" else -1
        shape = 1 if re.search(r"[0-9]{3}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{4}$", value) else 0
    cue = 1 if set(before) & _CUES[kind] else 0
    around = text[max(0, a - 1):a] + text[b:b + 1]
    touch = -1 if any(c.isalnum() or c in "_=#$%" for c in around) else 0
    return pattern, check, gazetteer, shape, cue, touch


def features(text: str, span: S.Span) -> tuple[int, ...]:
    """Small whole numbers that describe a candidate without its labelers: sizes, separators and neighbours."""
    value = text[span[0]:span[1]]
    digits = _digits(value)
    return (min(len(digits), 20), min(sum(c in " ()/" for c in value), 6), min(value.count("."), 4), min(value.count("-"), 4),
            int("+" in value[:1]), int("@" in value), int(luhn(digits)) if digits else 0, int(text[span[1]:span[1] + 1].isalnum()))


class Reliability:
    """Two-class model of independent labelers with three outcomes, estimated from counts of vote patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60):
        x = (patterns + 1).astype(int)
        good = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1)))  # the majority to begin with
        for _ in range(rounds):
            share = (counts * good).sum() / counts.sum()
            like = np.zeros((2, len(x)))
            for c, weight in enumerate((counts * (1 - good), counts * good)):
                for j in range(x.shape[1]):
                    seen = np.bincount(x[:, j], weight, 3) + 0.5
                    like[c] += np.log(seen / seen.sum())[x[:, j]]
            odds = like[1] - like[0] + np.log(max(share, 1e-6) / max(1 - share, 1e-6))
            good = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        self.chance = {tuple(p): float(g) for p, g in zip(patterns.tolist(), good)}


def logistic(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton steps of a ridge-regularised logistic regression with soft labels; the last coefficient is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (soft - p)) - 1.0 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(hess, grad)
    return w


def _describe(votes_: tuple[int, ...], features_: tuple[int, ...]) -> list[float]:
    return [*map(float, votes_), *map(float, features_), features_[0] ** 2 / 10]


class Classifier:
    """Per kind the weights of the final span classifier."""

    def __init__(self, counted: list[tuple[str, tuple[int, ...], tuple[int, ...], int]]):
        self.weights: dict[str, np.ndarray] = {}
        for kind in KINDS:
            rows = [r for r in counted if r[0] == kind]
            if not rows:
                continue
            n = np.array([r[3] for r in rows], float)
            patterns, which = np.unique(np.array([r[1] for r in rows]), axis=0, return_inverse=True)
            belief = Reliability(patterns, np.bincount(which.ravel(), n)).chance
            soft = np.array([belief[r[1]] for r in rows])
            self.weights[kind] = logistic(np.array([_describe(r[1], r[2]) for r in rows]), soft, n)

    def chance(self, text: str, span: S.Span, own: set[S.Span]) -> float:
        w = self.weights.get(span[2])
        if w is None:
            return 0.0
        x = np.array([*_describe(votes(text, span, own), features(text, span)), 1.0])
        return float(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    def find(self, text: str) -> tuple[list[S.Span], list[S.Span]]:
        own = base(text)
        known, added, taken = set(own), [], S.Taken(own)
        for span in candidates(text):
            if span not in known and taken.free(*span[:2]) and self.chance(text, span, known) >= THRESHOLD:
                added.append(span)
                taken.add(*span[:2])
        return own, own + added


def _ballots(batch: pa.RecordBatch):
    out = []
    for t in S.texts(batch):
        own = set(base(t)) if _SIGN.search(t) else set()
        out.append([{"kind": s[2], "votes": list(votes(t, s, own)), "features": list(features(t, s))} for s in candidates(t)])
    kind = pa.struct([("kind", pa.string()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])
    return [pa.array(out, pa.list_(kind))]


def learn(docs: DataFrame) -> Classifier:
    """Count votes and features of all candidates of all documents; what reaches the driver is bounded by the values these can take."""
    cast = C.extend(docs.filter(F.col("text").isNotNull()), _ballots, "found array<struct<kind:string,votes:array<int>,features:array<int>>>", [])
    counts = cast.select(F.inline("found")).groupBy("kind", "votes", "features").count().orderBy("kind", "votes", "features").collect()
    return Classifier([(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in counts])


def find(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """``keep`` plus counts of base spans by kind, their digest and all spans."""
    def work(batch):
        return S.summary([model.find(t) for t in S.texts(batch)], KINDS)

    return C.extend(docs, work, S.summary_fields(KINDS), keep)
