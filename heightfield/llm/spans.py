"""Spans in texts: the patterns of a kind, and how a document's spans are written down."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa

Span = tuple[int, int, str]  # start, end (code points, end exclusive), kind


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed."""
    return sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def written(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in in_order(spans, kinds))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(written(spans, kinds).encode()).hexdigest()


class Taken:
    """Stretches of a text that are taken, joined where they overlap, so that a question is one binary search."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(s[:2] for s in spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return not at or self.ends[at - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Take a free stretch."""
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def summary(found: list[tuple[list[Span], list[Span]]], kinds: tuple[str, ...]) -> list[pa.Array]:
    """For each document's (base spans, all spans): counts of base spans by kind, digest of the base spans, all spans."""
    counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in kinds]
    return [*counts, pa.array([digest(base, kinds) for base, _ in found], pa.string()), pa.array([written(every, kinds) for _, every in found], pa.string())]


def summary_fields(kinds: tuple[str, ...]) -> str:
    return ", ".join([*(f"n_{k} bigint" for k in kinds), "base_sha256 string", "spans string"])


def texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
