import glob
import math
import struct
import tempfile

import numpy as np
import pytest
from helpers import grids, images
from pyspark.sql import functions as F

from heightfield.model import channel
from heightfield.sources import tiff, workspace
from heightfield.sources.tables import ranked


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def file_bytes(raw=b"", w=2, h=2, pixel_type=0, gain=1.0, offset=0.0, image_type=0, size=(4.0, 2.0), unit="nm", name="Height",
               magic=True, header_bytes=352, header=True, data=True, order="<") -> bytes:
    head = bytearray(352)
    for key, v in {"image_type": image_type, "width": w, "height": h, "x_size": size[0], "y_size": size[1], "x_offset": 1.5,
                   "y_offset": -2.0, "gain": gain, "z_offset": offset, "pixel_type": pixel_type}.items():
        struct.pack_into(tiff.OFFSETS[key][0], head, tiff.OFFSETS[key][1], v)
    for key, v in {"source_name": name, "unit": unit}.items():
        at = tiff.TEXTS[key][0]
        head[at:at + 2 * len(v)] = v.encode("utf-16-le")
    entries = ([(0xC500, 4, 1, 1)] if magic else []) + ([(0xC502, 1, len(raw), 400)] if data else [])
    if header:
        entries.append((0xC503, 1, header_bytes, 400 + len(raw)))
    body = struct.pack(order + "2sHIH", b"II" if order == "<" else b"MM", 42, 8, len(entries))
    for e in entries:
        body += struct.pack(order + "HHII", *e)
    return body.ljust(400, b"\0") + raw + bytes(head)


SHORTS = struct.pack("<4h", 1, -2, 300, 4)
CASES = {
    "short": (file_bytes(SHORTS, gain=0.5, offset=10.0), None),
    "int": (file_bytes(struct.pack("<4i", 1, 2, 3, 70000), pixel_type=1), None),
    "float": (file_bytes(struct.pack("<4f", 1, 2, math.nan, 4), pixel_type=2, unit="furlong", name=""), None),
    "garbage": (b"hello", "Io"),
    "nomagic": (file_bytes(SHORTS, magic=False), "NotPsiaTiff"),
    "noheader": (file_bytes(SHORTS, header=False), "Corrupt"),
    "shortheader": (file_bytes(SHORTS, header_bytes=351), "Corrupt"),
    "profile": (file_bytes(SHORTS, image_type=1), "UnsupportedImageType"),
    "nodims": (file_bytes(SHORTS, w=0), "Corrupt"),
    "nosize": (file_bytes(SHORTS, size=(math.nan, 1.0)), "Corrupt"),
    "badtype": (file_bytes(SHORTS, pixel_type=9), "Corrupt"),
    "nodata": (file_bytes(data=False), "Truncated"),
    "fewbytes": (file_bytes(SHORTS[:-2]), "Truncated"),
}


def test_ingest_types_and_quarantine(spark):
    where = folder()
    for name, (content, _) in CASES.items():
        with open(f"{where}/{name}.tiff", "wb") as f:
            f.write(content)
    scans, errors = tiff.read_scans(spark, where)
    bad = {r["path"].rsplit("/", 1)[1][:-5]: r["kind"] for r in errors.collect()}
    assert bad == {n: kind for n, (_, kind) in CASES.items() if kind}
    name = F.regexp_extract("source.path", r"(\w+)\.tiff$", 1)
    got = {r["name"]: r for r in scans.scans.withColumn("name", name).collect()}
    ids = {r["dataset_id"]: n for n, r in got.items()}
    frame = scans.pixels.toPandas().sort_values(["y", "x"])
    z = {ids[k]: g["z"].tolist() for k, g in frame.groupby("dataset_id")}
    assert z["short"] == [10.5, 9.0, 160.0, 12.0] and z["int"][3] == 70000 and math.isnan(z["float"][2])
    x = got["short"]["x"]
    assert (x["origin"], x["step"], x["count"], x["unit"], x["direction"]) == (1.5, 2.0, 2, "um", "Forward")
    assert got["short"]["channel"]["kind"] == "Topography"
    assert tuple(got["float"]["channel"])[:3] == ("channel", "Unknown", "1")
    assert len(got["short"]["extended"]) == 10 and len(got["short"]["source"]["content_hash"]) == 64


def test_export_refuses_what_the_format_cannot_hold(spark):
    where = folder()
    im = images(spark, np.zeros((2, 3)), np.ones((2, 2)))
    odd = im.scans.withColumn("x", F.when(F.col("dataset_id") == 1, F.col("x").withField("unit", F.lit("V"))).otherwise(F.col("x")))
    refused = tiff.write_scans(im.with_pixels(im.pixels, odd), where).collect()
    assert [r["dataset_id"] for r in refused] == [1] and refused[0]["error"].startswith("Unsupported")
    assert [f.rsplit("/", 1)[1] for f in glob.glob(f"{where}/*")] == ["0.tiff"]


def test_round_trip_keeps_identity_directions_and_floats(spark):
    where = folder()
    a = np.random.default_rng(1).normal(size=(3, 5)).astype(np.float32)
    im = images(spark, a)
    scans = im.scans.withColumn("x", F.col("x").withField("direction", F.lit("Reverse"))).withColumn("channel", channel("Phase é", "Phase", "nm"))
    tiff.write_scans(im.with_pixels(im.pixels, scans), where)
    back, errors = tiff.read_scans(spark, where)
    row = back.scans.first()
    assert errors.count() == 0 and row["x"]["direction"] == "Reverse" and row["channel"]["key"] == "Phase é"
    assert len(row["dataset_id"]) == 36 and row["provenance"]
    again = tiff.read_scans(spark, where)[0].scans.first()
    assert again["dataset_id"] == row["dataset_id"]
    pixels = back.pixels.withColumn("dataset_id", F.lit(0))
    np.testing.assert_array_equal(grids(pixels)[0], a.astype(float))


def test_workspace_versions_and_errors(spark):
    where = folder()
    with pytest.raises(workspace.WorkspaceError, match="NotAWorkspace"):
        workspace.open_workspace(spark, where)
    a = np.arange(6.0).reshape(2, 3)
    workspace.save(workspace.Workspace(images(spark, a), active_id="0"), where)
    workspace.save(workspace.Workspace(images(spark, a + 1, a), active_id="1", comparison=("0",)), where)
    ws = workspace.open_workspace(spark, where)
    np.testing.assert_array_equal(grids(ws.images)[0], a + 1)
    assert (ws.active_id, ws.comparison) == ("1", ("0",))
    workspace.save(workspace.Workspace(images(spark, a), active_id="9"), where)
    with pytest.raises(workspace.WorkspaceError, match="dangling active"):
        workspace.open_workspace(spark, where)
    broken = images(spark, a)
    workspace.save(workspace.Workspace(broken.with_pixels(broken.pixels.filter("x > 0"))), where)
    with pytest.raises(workspace.WorkspaceError, match="does not match"):
        workspace.open_workspace(spark, where)
    row = [("v", "9.9", 1 << 62, None, None)]
    spark.createDataFrame(row, workspace.MANIFEST).write.mode("append").json(f"{where}/manifest")
    with pytest.raises(workspace.WorkspaceError, match="UnsupportedSchemaVersion"):
        workspace.open_workspace(spark, where)


def test_rank_is_dense_across_blocks(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = ranked(rows, "k", ["id"], F.floor(F.col("id") / 7)).toPandas().sort_values("id")
    for _, g in got.groupby("k"):
        assert g["rank"].tolist() == list(range(len(g)))


def test_files_are_written_line_by_line_from_batches():
    """Twenty lines at a time: what is held at once is a batch, not a scan."""
    import os
    import tracemalloc

    import pyarrow as pa

    w, h, where = 4000, 1500, folder()
    facts = {"w": w, "h": h, "xo": 0.0, "yo": 0.0, "xs": 0.1, "ys": 0.1, "xdir": "Forward", "ydir": "Forward", "key": "z", "unit": "nm", "model": "m",
             "provenance": None, "file_id": "0" * 8}

    def batches():
        for name in ("one", "two"):
            for y in range(0, h, 20):
                keep = [k for k in range(y, y + 20) if not (name == "two" and k in (0, 700, h - 1))]
                rows = {"dataset_id": pa.array([name] * len(keep)), "y": pa.array(keep, pa.int32()), "z": pa.array([np.full(w, k, np.float32) for k in keep], pa.list_(pa.float32()))}
                yield pa.RecordBatch.from_pydict(rows | {f: pa.array([v] * len(keep)) for f, v in facts.items()})

    tracemalloc.start()
    assert sum(tiff.stream_files(batches(), where)) == 2 * h - 3
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20 < 4 * w * h
    assert sorted(os.listdir(where)) == ["one.tiff", "two.tiff"]
    z = np.array(tiff.decode(open(f"{where}/two.tiff", "rb").read())["lines"])
    assert z.shape == (h, w) and np.isnan(z[[0, 700, h - 1]]).all() and (z[701] == 701).all()


def test_a_failed_stream_leaves_no_file():
    import os

    import pyarrow as pa

    where = folder()
    rows = {"dataset_id": ["a", "a"], "y": [0, 1], "z": [[1.0, 2.0], [3.0, 4.0]], "w": [2, 2], "h": [2, 2], "xo": [0.0] * 2, "yo": [0.0] * 2, "xs": [1.0] * 2, "ys": [1.0] * 2,
            "xdir": ["Forward"] * 2, "ydir": ["Forward"] * 2, "key": ["k"] * 2, "unit": ["nm"] * 2, "model": ["m"] * 2, "provenance": [None] * 2, "file_id": ["0"] * 2}

    def broken():
        yield pa.RecordBatch.from_pydict(rows)
        raise OSError("lost")

    with pytest.raises(OSError):
        list(tiff.stream_files(broken(), where))
    assert os.listdir(where) == []


def test_opening_reads_no_pixels_and_the_audit_reads_them_all(spark, monkeypatch):
    import os

    where = folder()
    version = workspace.save(workspace.Workspace(images(spark, np.arange(400.0).reshape(20, 20), np.ones((5, 7)))), where)
    read = []
    monkeypatch.setattr(workspace, "positions", lambda pixels, real=workspace.positions: read.append(1) or real(pixels))
    opened = workspace.open_workspace(spark, where)
    assert not read and "ReadSchema: struct<>" in opened.images.pixels.groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert workspace.audit(opened) is opened and read == [1]
    # another pixel in place of one leaves the counts, which only the audit sees
    base = f"{where}/versions/{version}"
    moved = opened.images.pixels.withColumn("x", F.when((F.col("dataset_id") == 1) & (F.col("y") == 2) & (F.col("x") == 3), 4).otherwise(F.col("x")))
    moved.repartition(3).write.parquet(f"{base}/moved")
    os.rename(f"{base}/pixels", f"{base}/before")
    os.rename(f"{base}/moved", f"{base}/pixels")
    opened = workspace.open_workspace(spark, where)
    with pytest.raises(workspace.WorkspaceError, match="does not match"):
        workspace.audit(opened)
    # a lost file is seen by the footers
    lost = max(glob.glob(f"{base}/pixels/part-*.parquet"), key=os.path.getsize)
    os.remove(lost)
    with pytest.raises(workspace.WorkspaceError, match="pixels where"):
        workspace.open_workspace(spark, where)


def test_the_round_trip_never_broadcasts_its_pixels(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["s1_s5_tiff_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # pixels come out of arrays, on the left: they were the side that is built
    assert "BuildRight" in plan and "BuildLeft" not in plan
