"""Batch ingest and export of instrument TIFF files holding one 2-D scan each.

A file is at most what the binaryFile source delivers as one row, so files are the unit of
parallelism; decoding emits packed scan lines which are exploded JVM-side.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heightfield.functions.units import KIND_OF_DIMENSION, convert, dimension_of, is_length, scale_of
from heightfield.model import CHANNEL, ImageSet, axis
from heightfield.plans.iterate import scratch_dir
from heightfield.plans.layout import bound_batches
from heightfield.plans.lines import attach_lines, floats, lines_of

# Tag numbers of the format.
TAG_DESCRIPTION = 0x010E
TAG_MAGIC = 0xC500
TAG_DATA = 0xC502
TAG_HEADER = 0xC503
MAGIC = 0x0E031301
HEADER_BYTES = 352
MAX_PIXELS = (2**31 - 4096) // 4
IMAGE_TYPES = {0: "Scan2DMappedImage", 1: "LineProfileImage", 2: "SpectroscopyImage"}
PIXEL_TYPES = {0: "<i2", 1: "<i4", 2: "<f4"}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 7: 1}

# Byte offsets of the header fields read here.
OFFSETS = {
    "image_type": ("<i", 0), "width": ("<i", 100), "height": ("<i", 104),
    "x_size": ("<d", 140), "y_size": ("<d", 148), "x_offset": ("<d", 156), "y_offset": ("<d", 164),
    "gain": ("<d", 220), "z_offset": ("<d", 236), "pixel_type": ("<i", 348),
}
TEXTS = {"source_name": (4, 32), "image_mode": (68, 8), "unit": (244, 8)}

PARSED = ("path string, kind string, message string, dataset_id string, content_hash string, width int, height int, "
          "x_size double, y_size double, x_offset double, y_offset double, gain double, z_offset double, pixel_type int, "
          "source_name string, image_mode string, unit string, x_direction string, y_direction string, "
          "provenance string, lines array<array<float>>")


class BadFile(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def tags(data: bytes) -> dict[int, tuple[int, int, bytes]]:
    """First directory of a TIFF: tag -> (field type, count, value bytes)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadFile("Io", "not a TIFF file")
    start = struct.unpack_from(order + "I", data, 4)[0]
    try:
        count = struct.unpack_from(order + "H", data, start)[0]
        found = {}
        for k in range(count):
            at = start + 2 + 12 * k
            tag, kind, many = struct.unpack_from(order + "HHI", data, at)
            size = FIELD_BYTES.get(kind, 8) * many
            where = at + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 8)[0]
            if where + size > len(data):
                raise BadFile("Io", f"tag {tag:#06x} reaches past the end of the file")
            found[tag] = (kind, many, data[where:where + size])
        return found
    except struct.error as broken:
        raise BadFile("Io", f"broken TIFF directory: {broken}") from broken


def read_header(raw: bytes) -> dict:
    head = {name: struct.unpack_from(fmt, raw, at)[0] for name, (fmt, at) in OFFSETS.items()}
    for name, (at, chars) in TEXTS.items():
        text = raw[at:at + 2 * chars].decode("utf-16-le", "replace")
        head[name] = text.split("\0", 1)[0].strip()
    return head


def read_sidecar(fields: dict) -> dict:
    """Identity, directions and provenance written by the exporter; empty for foreign files."""
    raw = fields.get(TAG_DESCRIPTION, (0, 0, b""))[2].split(b"\0", 1)[0]
    try:
        car = {k.lower(): v for k, v in json.loads(raw.decode("utf-8")).items()}
        if car.get("schema") != 1 or car.get("provenance") is None:
            return {}
        way = {"Forward", "Reverse"}
        return {
            "dataset_id": str(uuid.UUID(car["datasetid"])),
            "x_direction": car.get("xdirection") if car.get("xdirection") in way else "Forward",
            "y_direction": car.get("ydirection") if car.get("ydirection") in way else "Forward",
            "provenance": json.dumps(car["provenance"]),
        }
    except (ValueError, KeyError, AttributeError, TypeError):
        return {}


def decode(data: bytes) -> dict:
    fields = tags(data)
    if TAG_MAGIC not in fields:
        raise BadFile("NotPsiaTiff", "the magic number tag is absent")
    if not fields.get(TAG_HEADER, (0, 0, b""))[1]:
        raise BadFile("Corrupt", "the header tag is missing")
    raw = fields[TAG_HEADER][2]
    if len(raw) < HEADER_BYTES:
        raise BadFile("Corrupt", f"the header is shorter than {HEADER_BYTES} bytes")
    head = read_header(raw)
    if head["image_type"] != 0:
        name = IMAGE_TYPES.get(head["image_type"], f"ImageType={head['image_type']}")
        raise BadFile("UnsupportedImageType", f"image type {name} is not supported")
    w, h = head["width"], head["height"]
    if w <= 0 or h <= 0:
        raise BadFile("Corrupt", f"a scan of {w} by {h} pixels cannot be")
    if not (0 < head["x_size"] < np.inf and 0 < head["y_size"] < np.inf):
        raise BadFile("Corrupt", f"invalid scan size {head['x_size']} x {head['y_size']}")
    if head["pixel_type"] not in PIXEL_TYPES:
        raise BadFile("Corrupt", f"unsupported data type {head['pixel_type']}")
    if not fields.get(TAG_DATA, (0, 0, b""))[1]:
        raise BadFile("Truncated", "the pixel data tag is missing")
    kind = np.dtype(PIXEL_TYPES[head["pixel_type"]])
    payload = fields[TAG_DATA][2]
    if len(payload) < w * h * kind.itemsize:
        raise BadFile("Truncated", f"{len(payload)} payload bytes for {w}x{h} pixels")
    counts = np.frombuffer(payload, kind, w * h).astype(np.float64)
    z = (counts * head["gain"] + head["z_offset"]).astype(np.float32).reshape(h, w)
    side = {"x_direction": "Forward", "y_direction": "Forward", "provenance": None, "dataset_id": None} | read_sidecar(fields)
    return {**head, **side, "lines": list(z)}


def parse_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row per file, decoded or with an error kind; nothing is raised for a bad file."""
    names = [f.strip().split(" ")[0] for f in PARSED.split(", ")]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    bound_batches(files)
    files = files.select("path", "content", F.sha2("content", 256).alias("content_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content, digest in zip(batch["path"], batch["content"], batch["content_hash"]):
                row = dict.fromkeys(names)
                row.update(path=name, content_hash=digest.upper())
                try:
                    got = decode(bytes(content))
                    row.update({k: v for k, v in got.items() if k in row})
                    # a foreign file has no identity of its own: derive one that is stable across task retries
                    row["dataset_id"] = row["dataset_id"] or str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{digest}"))
                except BadFile as bad:
                    row.update(kind=bad.kind, message=str(bad))
                except Exception as other:  # anything unforeseen in a file is that file's read error
                    row.update(kind="Io", message=f"failed to read: {other}")
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, PARSED)


def scan_catalog(parsed: DataFrame) -> DataFrame:
    """Catalog rows of the readable files: axes in micrometres, typed channel, metadata map."""
    c = F.col
    good = parsed.filter("kind is null")
    known = dimension_of(c("unit")).isNotNull()
    pairs = [F.lit(v) for d in KIND_OF_DIMENSION.items() for v in d]
    kind = F.when(known, F.coalesce(F.create_map(*pairs)[dimension_of(c("unit"))], F.lit("Unknown"))).otherwise("Unknown")
    key = F.when(F.trim("source_name") == "", F.lit("channel")).otherwise(c("source_name"))
    ch = F.struct(key.alias("key"), kind.alias("kind"), F.when(known, c("unit")).otherwise("1").alias("unit"),
                  key.alias("display_name")).cast(CHANNEL)
    text = {
        "psia.imageType": F.lit("0"), "psia.width": c("width"), "psia.height": c("height"),
        "psia.xScanSize_um": c("x_size"), "psia.yScanSize_um": c("y_size"), "psia.dataGain": c("gain"),
        "psia.zOffset": c("z_offset"), "psia.dataType": c("pixel_type"), "psia.unitRaw": c("unit"),
        "source.contentHash": c("content_hash"),
    }
    extended = F.create_map(*[v for k, e in text.items() for v in (F.lit(k), e.cast("string"))])
    return good.select(
        "dataset_id", F.lit("ScanImage").alias("kind"),
        axis("X", "um", c("width"), origin=c("x_offset"), step=c("x_size") / c("width"), direction=c("x_direction")).alias("x"),
        axis("Y", "um", c("height"), origin=c("y_offset"), step=c("y_size") / c("height"), direction=c("y_direction")).alias("y"),
        ch.alias("channel"),
        F.struct(F.lit("psia-tiff").alias("format_id"), c("path"), c("content_hash")).alias("source"),
        F.when(F.trim("image_mode") == "", F.lit("unknown")).otherwise(c("image_mode")).alias("instrument_model"),
        F.lit(None).cast("timestamp").alias("acquired_at"), extended.alias("extended"), c("provenance"))


def ingest_errors(parsed: DataFrame) -> DataFrame:
    """Quarantine table: (path, kind, message)."""
    return parsed.filter("kind is not null").select("path", "kind", "message")


def read_scans(spark: SparkSession, path: str, pattern: str | None = None) -> tuple[ImageSet, DataFrame]:
    """All scans under ``path`` and the errors of the files that are not scans.

    Every file is read and decoded once: the parse is written to the shared folder, and all outputs read that table, each
    only its columns.  Of files that carry the same dataset id, the first by path is a scan, the others are errors.
    """
    table = f"{scratch_dir(spark)}/ingest-{uuid.uuid4().hex}"
    parse_files(spark, path, pattern).write.parquet(table)
    parsed = spark.read.parquet(table)
    owner = parsed.filter("kind is null").groupBy("dataset_id").agg(F.min("path").alias("owner"))
    again = F.col("kind").isNull() & (F.col("path") != F.col("owner"))
    parsed = parsed.join(owner, "dataset_id", "left").withColumns({
        "message": F.when(again, F.concat(F.lit("the dataset id is that of "), "owner")).otherwise(F.col("message")),
        "kind": F.when(again, "Duplicate").otherwise(F.col("kind"))}).drop("owner")
    lines = parsed.filter("kind is null").select("dataset_id", F.posexplode("lines").alias("y", "z"))
    pixels = lines.select("dataset_id", "y", F.posexplode("z").alias("x", "z"))
    return ImageSet(scan_catalog(parsed), pixels=pixels, lines=lines), ingest_errors(parsed)


def preamble(row) -> bytes:
    """Bytes of a scan file before its float pixels: directory of four ascending tags, side-car, header."""
    head = bytearray(HEADER_BYTES)
    values = {"image_type": 0, "width": row.w, "height": row.h, "x_size": row.xs * row.w, "y_size": row.ys * row.h,
              "x_offset": row.xo, "y_offset": row.yo, "gain": 1.0, "z_offset": 0.0, "pixel_type": 2}
    for name, v in values.items():
        struct.pack_into(OFFSETS[name][0], head, OFFSETS[name][1], v)
    for name, v in {"source_name": row.key, "image_mode": row.model, "unit": row.unit}.items():
        at, chars = TEXTS[name]
        raw = (v or "").encode("utf-16-le")[:2 * chars - 2]
        head[at:at + len(raw)] = raw
    car = json.dumps({"Schema": 1, "DatasetId": row.file_id, "XDirection": row.xdir, "YDirection": row.ydir,
                      "Provenance": json.loads(row.provenance) if row.provenance else {"ParentId": None, "Steps": []}},
                     separators=(",", ":"), ensure_ascii=False).encode("utf-8") + b"\0"
    car += b"\0" * (len(car) % 2)
    size = 4 * row.w * row.h
    first = 8 + 2 + 4 * 12 + 4
    entries = [(TAG_DESCRIPTION, 2, len(car), first), (TAG_MAGIC, 4, 1, MAGIC),
               (TAG_DATA, 1, size, first + len(car) + HEADER_BYTES), (TAG_HEADER, 1, HEADER_BYTES, first + len(car))]
    directory = struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    for entry in entries:
        directory += struct.pack("<HHII", *entry)
    return directory + struct.pack("<I", 0) + car + bytes(head)


def encode(row, z: np.ndarray) -> bytes:
    """Bytes of one scan file."""
    return preamble(row) + np.ascontiguousarray(z, dtype="<f4").tobytes()


def _facts(images: ImageSet) -> DataFrame:
    """What a file says of each scan, under its file name (file_id), and why it cannot be written (error)."""
    c = F.col
    cols = images.scans.columns
    um = F.lit("um")
    file_id = c("dataset_id").cast("string")
    as_uuid = F.when(file_id.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), file_id).otherwise(
        F.regexp_replace(F.md5(file_id), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return images.scans.select(
        "dataset_id", c("x.count").alias("w"), c("y.count").alias("h"),
        convert(c("x.origin"), c("x.unit"), um)["value"].alias("xo"), convert(c("y.origin"), c("y.unit"), um)["value"].alias("yo"),
        (c("x.step") * scale_of(c("x.unit")) / scale_of(um)).alias("xs"), (c("y.step") * scale_of(c("y.unit")) / scale_of(um)).alias("ys"),
        c("x.direction").alias("xdir"), c("y.direction").alias("ydir"), c("channel.key").alias("key"), c("channel.unit").alias("unit"),
        (c("instrument_model") if "instrument_model" in cols else F.lit("unknown")).alias("model"),
        (c("provenance") if "provenance" in cols else F.lit(None).cast("string")).alias("provenance"), as_uuid.alias("file_id"),
        F.when(~(is_length(c("x.unit")) & is_length(c("y.unit"))), "the scan axes are not lengths")
        .when(c("x.count").cast("long") * c("y.count") > MAX_PIXELS, "the scan exceeds one file").alias("error"))


def _refused(facts: DataFrame) -> DataFrame:
    return facts.filter("error is not null").select("dataset_id", F.concat(F.lit("Unsupported: "), "error").alias("error"))


def export_rows(images: ImageSet) -> DataFrame:
    """(dataset_id, content BINARY, error): one encoded file per scan as a row, or why it cannot be written.

    For files that have to travel as rows; :func:`write_scans` writes files of any size line by line.
    """
    facts = _facts(images)
    lines = lines_of(images).groupBy("dataset_id").agg(F.collect_list("y").alias("y"), F.collect_list("z").alias("z"))
    rows = facts.filter("error is null").drop("error").join(lines, "dataset_id")
    key = images.scans.schema["dataset_id"].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                z = np.full((row.h, row.w), np.nan, dtype=np.float32)
                for y, line in zip(row.y, row.z, strict=True):
                    z[y] = line
                out.append((row.dataset_id, encode(row, z)))
            yield pd.DataFrame(out, columns=["dataset_id", "content"])

    written = rows.mapInPandas(run, f"dataset_id {key.simpleString()}, content binary")
    refused = _refused(facts).select("dataset_id", F.lit(None).cast("binary").alias("content"), "error")
    return written.withColumn("error", F.lit(None).cast("string")).unionByName(refused)


class _OpenFile:
    """A scan file being written line by line under a temporary name."""

    def __init__(self, path: str, row):
        self.store, folder = FileSystem.from_uri(path)
        name = str(row.dataset_id)
        if "/" in name or "\\" in name or name in ("", ".", ".."):
            raise ValueError(f"{name!r} cannot name a file")
        self.store.create_dir(folder, recursive=True)
        self.part, self.final = f"{folder}/.{name}.{uuid.uuid4().hex}", f"{folder}/{name}.tiff"
        self.row, self.next = row, 0
        self.stream = self.store.open_output_stream(self.part)
        self.stream.write(preamble(row))

    def add(self, y: int, line: np.ndarray) -> None:
        self.fill(y)
        self.stream.write(line.astype("<f4").tobytes())
        self.next = y + 1

    def fill(self, upto: int) -> None:
        """Lines that are missing are NaN."""
        for _ in range(self.next, upto):
            self.stream.write(np.full(self.row.w, np.nan, "<f4").tobytes())
        self.next = max(self.next, upto)

    def done(self) -> None:
        self.fill(self.row.h)
        self.stream.close()
        self.store.move(self.part, self.final)

    def dropped(self) -> None:
        self.stream.close()
        self.store.delete_file(self.part)


def stream_files(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[int]:
    """Write lines that arrive by scan and y, each with its scan's facts, into one file per scan; gives the rows of each batch.

    Nothing but the current batch is held: a file grows with its lines and gets its name when it is whole.
    """
    open_: _OpenFile | None = None
    try:
        for batch in batches:
            facts = batch.select([n for n in batch.schema.names if n not in ("y", "z")])
            y, z = batch.column("y").to_pylist(), batch.column("z")
            at = np.concatenate([[0], np.cumsum(np.asarray(z.value_lengths()))])
            flat = floats(z)
            for k, name in enumerate(batch.column("dataset_id").to_pylist()):
                if open_ is None or open_.row.dataset_id != name:
                    if open_ is not None:
                        open_.done()
                    open_ = None
                    open_ = _OpenFile(path, SimpleNamespace(**facts.slice(k, 1).to_pylist()[0]))
                open_.add(y[k], flat[at[k]:at[k + 1]])
            yield batch.num_rows
        if open_ is not None:
            last, open_ = open_, None
            last.done()
    except BaseException:
        if open_ is not None:
            open_.dropped()
        raise


def write_files(rows: DataFrame, path: str) -> int:
    """Write (dataset_id, content) rows as ``<dataset_id>.tiff`` under ``path``; returns the number of files.

    ``path`` is a folder every executor sees, with or without a scheme.  Each file is written under a temporary name
    and moved, so a retried task cannot leave a torn file.  A name that would leave the folder is refused.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch["dataset_id"], batch["content"]):
                if "/" in name or "\\" in name or name in ("", ".", ".."):
                    raise ValueError(f"{name!r} cannot name a file")
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, f"{folder}/{name}.tiff")
            yield pd.DataFrame({"done": [len(batch)]}, dtype="int32")

    named = rows.select(F.col("dataset_id").cast("string").alias("dataset_id"), "content")
    return named.mapInPandas(put, "done int").agg(F.sum("done")).first()[0] or 0


def write_scans(images: ImageSet, path: str) -> DataFrame:
    """Write one file per scan under ``path``; returns the refusals as (dataset_id, error).

    Packed lines meet by scan in the order of their lines and are appended to the file as they arrive, so a task holds one batch of
    lines however large a scan is.  ``path`` is a folder every executor sees; a retried task writes its files anew under
    other temporary names.
    """
    facts = _facts(images)
    good = facts.filter("error is null").drop("error")
    bound_batches(images.scans)
    rows = attach_lines(images, lines_of(images), good)
    named = rows.withColumn("dataset_id", F.col("dataset_id").cast("string")).repartition("dataset_id").sortWithinPartitions("dataset_id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"lines": pa.array([sum(stream_files(batches, path))], pa.int64())})

    named.mapInArrow(run, "lines long").agg(F.sum("lines")).collect()
    return _refused(facts)
