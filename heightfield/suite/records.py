"""Ingest, export, workspace and lineage queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heightfield.model import axis, channel
from heightfield.operators import lineage, registry
from heightfield.plans.iterate import scratch_dir
from heightfield.plans.layout import attach
from heightfield.sources import tiff, workspace
from heightfield.sources.tables import embedding_images
from heightfield.suite import query
from heightfield.suite.sql import PIX, PX, b, moments, r


def scratch(spark, what: str) -> str:
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


def described(images):
    """The image set with a nanometre Y axis, a reversed X axis, offsets and an instrument name."""
    c = F.col
    scans = images.scans.withColumns({
        "x": axis("X", "um", c("x.count"), origin=3.5, step=0.1, direction="Reverse"),
        "y": axis("Y", "nm", c("y.count"), origin=-250.0, step=100.0),
        "channel": channel("Z Height", unit="nm"), "instrument_model": F.lit("scan")})
    return images.among(scans)


def exported(spark, path) -> str:
    """Write the images as files, one per label, named by the label."""
    folder = scratch(spark, "scans")
    tiff.write_scans(described(embedding_images(spark, path)), folder)
    return folder


def label():
    return F.regexp_extract(F.col("source.path"), r"(\d+)\.tiff$", 1).cast("bigint")


@query("s1_s5_tiff_round_trip", f"WITH {PX} {PIX} px")
def _(spark, path):
    images, _errors = tiff.read_scans(spark, exported(spark, path))
    named = images.scans.select("dataset_id", label().alias("label"))
    # attached, not joined: rows that come out of arrays are estimated as fewer bytes than the catalog, and would be the side that is broadcast
    return attach(images, images.pixels, named).select(F.col("label").alias("dataset_id"), "y", "x", "z")


@query("s3_s4_scan_catalog", f"""WITH {PX} SELECT dataset_id, 'Z Height' AS key, 'Topography' AS kind, 'nm' AS unit, 'scan' AS model,
    {r('3.5', 'x_origin')}, {r('0.1', 'x_step')}, 'Reverse' AS x_direction, {r('-0.25', 'y_origin')}, {r('0.1', 'y_step')}, {b('h', 'y_count')},
    CAST(w AS VARCHAR) AS width_text, 'nm' AS raw_unit, CAST(10 AS BIGINT) AS keys FROM dims""")
def _(spark, path):
    scans = tiff.read_scans(spark, exported(spark, path))[0].scans
    return scans.select(
        label().alias("dataset_id"), "channel.key", "channel.kind", "channel.unit", F.col("instrument_model").alias("model"),
        F.col("x.origin").alias("x_origin"), F.col("x.step").alias("x_step"), F.col("x.direction").alias("x_direction"),
        F.col("y.origin").alias("y_origin"), F.col("y.step").alias("y_step"), F.col("y.count").alias("y_count"),
        F.col("extended")["psia.width"].alias("width_text"), F.col("extended")["psia.unitRaw"].alias("raw_unit"), F.size("extended").alias("keys"))


@query("s2_ingest_errors", f"""WITH {PX} SELECT dataset_id, CASE dataset_id % 5 WHEN 0 THEN 'Truncated' WHEN 1 THEN 'Io' WHEN 2 THEN 'NotPsiaTiff'
    WHEN 3 THEN 'Corrupt' END AS kind FROM dims WHERE dataset_id % 5 < 4""")
def _(spark, path):
    """Every fifth file stays whole; the others lose a tag, a field or their tail."""
    folder = scratch(spark, "damaged")
    images = described(embedding_images(spark, path))
    good = tiff.export_rows(images).filter("error is null").select("dataset_id", F.hex("content").alias("h"))
    k, h = F.col("dataset_id") % 5, F.col("h")

    def patched(byte: int, value: str):
        return F.concat(F.substring(h, 1, 2 * byte), F.lit(value), h.substr(F.lit(2 * byte + 1 + len(value)), F.length(h)))

    # directory entries of 12 bytes start at byte 10: description, magic, data, header
    damaged = (F.when(k == 0, patched(10 + 24 + 4, "04000000")).when(k == 1, F.substring(h, 1, 2 * 300))
               .when(k == 2, patched(10 + 12, "01C5")).when(k == 3, patched(10 + 36 + 4, "64000000")).otherwise(h))
    tiff.write_files(good.select("dataset_id", F.unhex(damaged).alias("content")), folder)
    errors = tiff.read_scans(spark, folder)[1]
    return errors.select(F.regexp_extract("path", r"(\d+)\.tiff$", 1).cast("bigint").alias("dataset_id"), "kind")


@query("s2_duplicate_ids", f"WITH {PX} SELECT dataset_id, 'Duplicate' AS kind FROM dims WHERE dataset_id % 2 = 0")
def _(spark, path):
    """Every second file lies there twice; the copy that comes later by its path is quarantined."""
    folder = scratch(spark, "copies")
    good = tiff.export_rows(described(embedding_images(spark, path))).filter("error is null").select("dataset_id", "content")
    tiff.write_files(good.select(F.concat(F.lit("a"), "dataset_id").alias("dataset_id"), "content"), folder)
    tiff.write_files(good.filter("dataset_id % 2 = 0").select(F.concat(F.lit("b"), "dataset_id").alias("dataset_id"), "content"), folder)
    images, errors = tiff.read_scans(spark, folder)
    twice = images.pixels.groupBy("dataset_id", "y", "x").count().filter("count > 1").select(F.lit(-1).cast("bigint").alias("dataset_id"), F.lit("twice").alias("kind"))
    return errors.select(F.regexp_extract("path", r"b(\d+)\.tiff$", 1).cast("bigint").alias("dataset_id"), "kind").unionByName(twice)


@query("s4_content_hash", f"WITH {PX} SELECT dataset_id, true AS same_digest, substr(md5(CAST(dataset_id AS VARCHAR)), 1, 8) AS id_start FROM dims")
def _(spark, path):
    """The recorded digest of every file beside that of the bytes as written, and the first group of the side-car's id."""
    folder = exported(spark, path)
    files = spark.read.format("binaryFile").load(f"{folder}/*.tiff").select("path", F.upper(F.sha2("content", 256)).alias("digest"))
    scans = tiff.read_scans(spark, folder)[0].scans
    both = scans.join(files, F.col("source.path") == F.col("path"))
    return both.select(label().alias("dataset_id"), (F.col("extended")["source.contentHash"] == F.col("digest")).alias("same_digest"),
                       F.split("dataset_id", "-")[0].alias("id_start"))


def saved(spark, path) -> str:
    folder = scratch(spark, "workspace")
    images = embedding_images(spark, path)
    workspace.save(workspace.Workspace(images, active_id="1", comparison=("0", "2")), folder)
    return folder


@query("s6_s7_workspace_round_trip", f"WITH {PX} {PIX} px")
def _(spark, path):
    return workspace.open_workspace(spark, saved(spark, path)).images.pixels


@query("s7_integrity_problems", f"""WITH {PX} SELECT CAST(dataset_id AS VARCHAR) AS dataset_id, 'pixel buffer does not match its axes' AS problem FROM dims WHERE dataset_id % 3 = 0
    OR dataset_id % 3 = 1 AND h > 3 AND w > 3 UNION ALL SELECT CAST(dataset_id AS VARCHAR), 'unknown channel unit' FROM dims WHERE dataset_id % 4 = 1 UNION ALL SELECT 'nowhere', 'dangling active id'""")
def _(spark, path):
    images = embedding_images(spark, path)
    d, x, y = F.col("dataset_id"), F.col("x"), F.col("y")
    lost = images.pixels.filter(~((d % 3 == 0) & (y == 2)))
    # in others one pixel is written over its neighbour: the count stays right
    lost = lost.withColumn("x", F.when((d % 3 == 1) & (y == 1) & (x == 2), F.lit(1)).otherwise(x))
    unit = F.when(F.col("dataset_id") % 4 == 1, "parsec").otherwise(F.col("channel.unit"))
    scans = images.scans.withColumn("channel", F.col("channel").withField("unit", unit))
    return workspace.problems(images.with_pixels(lost, scans), "nowhere", ("0",))


# --- lineage over events: every event derives from one with a third of its id -----------------

def links(spark, path):
    e = spark.read.parquet(f"{path}/events.parquet").select(F.col("event_id").alias("dataset_id"))
    parent = F.floor(F.col("dataset_id") / 3).cast("bigint")
    return e.withColumn("parent_id", F.when(F.col("dataset_id") > 0, F.when(parent % 11 == 10, -parent).otherwise(parent)))


def known(table):
    return table.select("dataset_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


LK = """lk AS (SELECT event_id AS dataset_id, CASE WHEN event_id > 0 THEN
    CASE WHEN (event_id // 3) % 11 = 10 THEN -(event_id // 3) ELSE event_id // 3 END END AS parent_id FROM events)"""
TREE = f"""{LK}, walk(dataset_id) AS (SELECT dataset_id FROM lk WHERE parent_id = 1
    UNION SELECT lk.dataset_id FROM lk JOIN walk ON lk.parent_id = walk.dataset_id)"""


def targets(spark, path):
    return links(spark, path).filter("parent_id = 1").select("dataset_id")


@query("j3_parents", f"WITH {LK} SELECT a.dataset_id, coalesce(b.dataset_id, -1) AS parent_id FROM lk a LEFT JOIN lk b ON a.parent_id = b.dataset_id")
def _(spark, path):
    return known(lineage.parents(links(spark, path)))


@query("j3_roots", f"WITH {LK} SELECT dataset_id FROM lk a WHERE NOT EXISTS (SELECT 1 FROM lk b WHERE b.dataset_id = a.parent_id)")
def _(spark, path):
    return lineage.roots(links(spark, path))


@query("g2_descendants", f"WITH RECURSIVE {TREE} SELECT dataset_id FROM walk WHERE dataset_id NOT IN (SELECT dataset_id FROM lk WHERE parent_id = 1)")
def _(spark, path):
    return lineage.descendants(links(spark, path), targets(spark, path))


RING = f"""{LK}, ring AS (SELECT dataset_id, CASE WHEN dataset_id % 500 = 7 THEN dataset_id + 2 WHEN dataset_id % 500 IN (8, 9) THEN dataset_id - 1 ELSE parent_id END AS parent_id FROM lk)"""


@query("g3_cycles", f"""WITH RECURSIVE {RING}, up(start, pos) AS (SELECT a.dataset_id, b.dataset_id FROM ring a JOIN ring b ON a.parent_id = b.dataset_id
    UNION SELECT start, ring.parent_id FROM up JOIN ring ON ring.dataset_id = up.pos WHERE ring.parent_id IS NOT NULL)
    SELECT DISTINCT start AS dataset_id FROM up WHERE start = pos""")
def _(spark, path):
    d = F.col("dataset_id")
    ring = F.when(d % 500 == 7, d + 2).when((d % 500).isin(8, 9), d - 1).otherwise(F.col("parent_id"))
    return lineage.cycles(links(spark, path).withColumn("parent_id", ring))


@query("g4_remove_cascade", f"WITH RECURSIVE {TREE} SELECT lk.dataset_id, coalesce(lk.parent_id, -1) AS parent_id FROM lk WHERE dataset_id NOT IN (SELECT dataset_id FROM walk)")
def _(spark, path):
    table = links(spark, path)
    return known(lineage.remove({"links": table}, table, targets(spark, path), "Cascade")["links"])


@query("g4_remove_block", f"""WITH {LK}, tg AS (SELECT dataset_id FROM lk a WHERE NOT EXISTS (SELECT 1 FROM lk b WHERE b.dataset_id = a.parent_id))
    SELECT dataset_id, coalesce(parent_id, -1) AS parent_id FROM lk WHERE dataset_id NOT IN (SELECT dataset_id FROM tg)
    OR dataset_id IN (SELECT parent_id FROM lk WHERE parent_id IS NOT NULL)""")
def _(spark, path):
    table = links(spark, path)
    return known(lineage.remove({"links": table}, table, lineage.roots(table), "Block")["links"])


@query("j5_measurements_of_sources", f"""WITH {PX}, {moments('px')}
    SELECT dataset_id AS source_id, 'Sq' AS name, {r('sq', 'value')} FROM m JOIN dims USING (dataset_id) WHERE h >= 50
    UNION ALL SELECT dataset_id, 'Sa', {r('sa', 'value')} FROM m JOIN dims USING (dataset_id) WHERE h >= 50""")
def _(spark, path):
    images = embedding_images(spark, path)
    found = registry.standard().run("image.roughness", images).measurements.filter(F.col("name").isin("Sq", "Sa"))
    attached = found.unionByName(found.filter("name = 'Sq'"))
    return lineage.measurements_of(attached, images.scans.filter("y.count >= 50")).select("source_id", "name", "value")
