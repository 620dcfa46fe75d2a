"""Packed scan lines: one row (dataset_id, y, z ARRAY<FLOAT>) per line of an image.

Collections whose source delivers whole lines keep them next to the pixels (``ImageSet.lines``); work along X then needs no exchange,
and work along Y moves slices of lines where it would move pixels.  A line is the unit that is never cut; an image with a third of all
rows spreads over its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.functions.expr import floordiv, nan
from heightfield.model import BROADCAST_ROWS, ImageSet
from heightfield.plans.layout import TILE, bound_batches, with_geometry

# Samples of the lines that are worked on together.
BLOCK = 1 << 18


def lines_of(images: ImageSet) -> DataFrame:
    """The lines of a collection: as stored, else packed from the pixels by one exchange; a missing pixel is NaN."""
    if images.lines is not None:
        return images.lines
    key = images.pixels.schema["dataset_id"].dataType.simpleString()
    rows = with_geometry(images).groupBy("dataset_id", "y", "w").agg(F.collect_list("x").alias("x"), F.collect_list(F.coalesce("z", nan().cast("float"))).alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column("w").to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(width)])
            flat = np.full(at[-1], np.nan, np.float32)
            x = b.column("x")
            flat[np.repeat(at[:-1], np.asarray(x.value_lengths())) + x.flatten().to_numpy()] = floats(b.column("z"))
            yield pa.RecordBatch.from_arrays([b.column("dataset_id"), b.column("y"), listed(at, flat)], names=["dataset_id", "y", "z"])

    bound_batches(rows)
    return rows.mapInArrow(run, f"dataset_id {key}, y int, z array<float>")


def unpacked(lines: DataFrame) -> DataFrame:
    """One row per pixel of packed lines."""
    return lines.select("dataset_id", "y", F.posexplode("z").alias("x", "z")).withColumn("z", F.coalesce("z", nan().cast("float")))


def attach_lines(images: ImageSet, lines: DataFrame, table: DataFrame) -> DataFrame:
    """Inner-join one row per image onto its lines: broadcast for a small catalog, else a merge join on (dataset_id, block of lines)."""
    if images.catalog_rows <= BROADCAST_ROWS:
        return lines.join(F.broadcast(table), "dataset_id")
    blocks = images.geometry().select("dataset_id", F.explode(F.sequence(F.lit(0), floordiv(F.col("h") - 1, TILE))).alias("_by"))
    spread = table.join(blocks, "dataset_id").hint("merge")
    return lines.withColumn("_by", floordiv(F.col("y"), TILE)).join(spread, ["dataset_id", "_by"]).drop("_by")


def floats(column: pa.Array) -> np.ndarray:
    """All samples of a column of lines; a NaN may arrive as null."""
    flat = column.flatten()
    return (pc.fill_null(flat, np.nan) if flat.null_count else flat).to_numpy(zero_copy_only=False)


def listed(at: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Lines from their samples and the offsets of each."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))


def blocks(batch: pa.RecordBatch, same: tuple[str, ...] = ("dataset_id",)) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of rows that agree in ``same`` and in width: (first row, lines as one matrix), about BLOCK samples each."""
    if not batch.num_rows:
        return
    width = np.asarray(batch.column("z").value_lengths())
    flat = floats(batch.column("z"))
    at = np.concatenate([[0], np.cumsum(width)])
    new = np.ones(batch.num_rows, bool)
    new[1:] = width[1:] != width[:-1]
    for name in same:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first = np.append(np.flatnonzero(new), batch.num_rows)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        step = max(1, BLOCK // max(1, int(width[lo])))
        for a in range(lo, hi, step):
            z = min(hi, a + step)
            yield a, flat[at[a]:at[z]].reshape(z - a, int(width[lo]))


def mapped(lines: DataFrame, work, out: str = "array<float>", same: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Replace every line by ``work(block, first row as a dict of its other columns)``, blocks of lines at a time; other columns stay."""
    kinds = dict(lines.dtypes)
    names = lines.columns
    schema = ", ".join(f"`{c}` {out if c == 'z' else kinds[c]}" for c in names)
    kind = np.float64 if "double" in out else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, sizes = [np.zeros(0, kind)], []
            for first, block in blocks(b, same):
                done = work(block, {c: b.column(c)[first].as_py() for c in names if c != "z"})
                parts.append(done.astype(kind, copy=False).ravel())
                sizes.append(np.full(len(block), done.shape[1]))
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
            z = listed(at, np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([z if c == "z" else b.column(c) for c in names], names=names)

    bound_batches(lines)
    return lines.mapInArrow(run, schema)
