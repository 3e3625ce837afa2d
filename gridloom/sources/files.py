"""Readers of whole files that Spark has no reader for, one file a task: zipped shapefiles, elevation rasters, JSON of map services."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPES = "file string, member string, row int, kind string, properties map<string, string>, parts array<array<struct<x: double, y: double>>>"
# Kinds of shapes by their code in a shapefile.
KINDS = {1: "point", 3: "line", 5: "polygon", 8: "points", 11: "point", 13: "line", 15: "polygon"}


def _shapes(data: bytes) -> Iterator[tuple[str, list]]:
    """Kind and parts of each record of a .shp member."""
    at = 100
    while at + 12 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        body, at = at + 12, at + 8 + size
        point = lambda i, start: dict(zip("xy", struct.unpack_from("<2d", data, start + 16 * i), strict=True))
        if kind in (1, 11):
            yield "point", [[point(0, body)]]
        elif kind == 8:
            yield "points", [[point(i, body + 36) for i in range(struct.unpack_from("<i", data, body + 32)[0])]]
        elif kind in (3, 5, 13, 15):
            parts, n = struct.unpack_from("<2i", data, body + 32)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 40), n]
            begin = body + 40 + 4 * parts
            yield KINDS[kind], [[point(i, begin) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            yield "none", []


def _attributes(data: bytes) -> Iterator[dict[str, str]]:
    """Fields of each record of a .dbf member, as text; blank ones are left out."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 13:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    for i in range(count):
        start, row = head + i * size + 1, {}
        for name, width in fields:
            value = data[start : start + width].decode("utf-8", "replace").strip(" \0")
            start += width
            if value:
                row[name] = value
        yield row


def shapefiles(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """A row per shape of zipped shapefiles, with its fields; a file that is no such archive gives no rows."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in sorted(n for n in z.namelist() if n.lower().endswith(".shp")):
                            table = next((n for n in z.namelist() if n.lower() == name.lower()[:-4] + ".dbf"), None)
                            fields = list(_attributes(z.read(table))) if table else []
                            for i, (kind, parts) in enumerate(_shapes(z.read(name))):
                                rows.append((file, name, i, kind, fields[i] if i < len(fields) else {}, parts))
                except (zipfile.BadZipFile, struct.error, IndexError):
                    rows = []
                yield pd.DataFrame(rows, columns=["file", "member", "row", "kind", "properties", "parts"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, SHAPES)
    return out if where is None else out.where(where)


def storm_parts(shapes: DataFrame) -> DataFrame:
    """Shapes of a storm advisory with ``part``: cone (polygons), track (lines) or points, by the member's name."""
    name = F.lower("member")
    part = F.when(name.contains("pgn"), "cone").when(name.contains("lin"), "track").when(name.contains("pts"), "points")
    return shapes.withColumn("part", part).where("part is not null")


def _tiff(data: bytes) -> tuple[np.ndarray, list[float]]:
    """Values and (x0, y0, width, height of a cell) of a one-band raster, plain or deflated, in strips or tiles."""
    order = "<" if data[:2] == b"II" else ">"
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = kinds.get(kind)
        if code is None:
            continue
        code = f"{order}{n}{code}"
        size = struct.calcsize(code)
        begin = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        tags[tag] = struct.unpack_from(code, data, begin)
    wide, high = tags[256][0], tags[257][0]
    bits, form = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    if tags.get(259, (1,))[0] not in (1, 8, 32946) or tags.get(317, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
        raise ValueError("a raster that is not plain or deflated, or has several bands")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form]}{bits // 8}")
    tile_w, tile_h = tags.get(322, (wide,))[0], tags.get(323, tags.get(278, (high,)))[0]
    places, sizes = tags.get(324, tags.get(273)), tags.get(325, tags.get(279))
    out, across = np.zeros((high, wide)), -(-wide // tile_w)
    for i, (begin, size) in enumerate(zip(places, sizes, strict=True)):
        raw = data[begin : begin + size]
        raw = raw if tags.get(259, (1,))[0] == 1 else zlib.decompress(raw)
        r, c = i // across * tile_h, i % across * tile_w
        cells = np.frombuffer(raw, dtype)
        cells = cells[: len(cells) // tile_w * tile_w].reshape(-1, tile_w)
        out[r : r + len(cells), c : c + tile_w] = cells[: high - r, : wide - c]
    dx, dy = tags.get(33550, (1.0, 1.0))[:2]
    tie = tags.get(33922, (0.0,) * 6)
    return out, [tie[3] - tie[0] * dx, tie[4] + tie[1] * dy, dx, dy]


def elevations(spark: SparkSession, path: str, every: int = 1) -> DataFrame:
    """file, row, col, x, y (middle) and value of every ``every``-th cell each way of raster files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                grid, (x0, y0, dx, dy) = _tiff(content)
                for begin in range(0, len(grid), every * 64):  # some rows at a time
                    rows = np.arange(begin, min(begin + every * 64, len(grid)), every)
                    r, c = (a.reshape(-1) for a in np.meshgrid(rows, np.arange(0, grid.shape[1], every), indexing="ij"))
                    yield pd.DataFrame({"file": file, "row": r, "col": c, "x": x0 + (c + 0.5) * dx, "y": y0 - (r + 0.5) * dy, "value": grid[r, c]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, row long, col long, x double, y double, value double")


def esri_features(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """attributes, kind and polygons of pages of a map service; of several rings each is a polygon of its own."""
    kind = "features array<struct<attributes: map<string, string>, geometry: struct<rings: array<array<array<double>>>, x: double, y: double>>>"
    f = payloads.select(F.explode(F.from_json(column, kind)["features"]).alias("f"))
    rings = F.transform("f.geometry.rings", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    which = F.when(F.size("f.geometry.rings") > 1, "MultiPolygon").when(F.size("f.geometry.rings") == 1, "Polygon").when(F.col("f.geometry.x").isNotNull(), "Point")
    return f.select("f.attributes", which.alias("kind"), rings.alias("polygons"), F.col("f.geometry.x").alias("x"), F.col("f.geometry.y").alias("y"))


def census_rates(payloads: DataFrame, part: str, whole: str, default: float, column: str = "payload") -> DataFrame:
    """geoid and rate (0..1) of census tables: a header row, then rows; what does not parse takes the default."""
    rows = payloads.select(F.from_json(column, "array<array<string>>").alias("t")).where(F.size("t") > 1)
    head = F.col("t")[0]
    each = rows.select(head.alias("h"), F.explode(F.slice("t", F.lit(2), F.size("t") - 1)).alias("r"))
    value = lambda name: F.get(F.col("r"), F.array_position("h", name).cast("int") - 1)
    number = lambda name: value(name).try_cast("double")
    rate = F.coalesce(F.try_divide(number(part), number(whole)), F.lit(default))
    return each.select(F.concat_ws("", value("state"), value("county"), value("tract")).alias("geoid"), F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0)).alias("rate"))


def mapped_bridges(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """id, name, lat, lon and span of bridges of a map query: the first name there is, the first length that is a number."""
    kind = "elements array<struct<id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    e = payloads.select(F.explode(F.from_json(column, kind)["elements"]).alias("e"))
    tag = lambda k: F.col("e.tags")[k]
    return e.select(
        "e.id", F.coalesce(tag("name"), tag("name:es"), tag("ref")).alias("name"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"),
        F.coalesce(tag("length").try_cast("double"), tag("maxlength").try_cast("double")).alias("span"),
    )


def parcel_lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """properties of features, one a line of text; times in milliseconds that are out of range are NULL."""
    parsed = spark.read.text(path).select(F.from_json("value", f"properties struct<{fields}, salesdttm: string>").alias("f")).where("f.properties is not null")
    ms = F.col("salesdttm").try_cast("long")
    return parsed.select("f.properties.*").withColumn("salesdttm", F.when(ms.between(-62_135_596_800_000, 253_402_300_799_999), F.timestamp_millis(ms)))


def table_name(file: Column, prefix: str = "") -> Column:
    """A table's name from its file: without folder, prefix and ending, at most 63 characters, in lower case."""
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    return F.lower(F.substring(F.regexp_replace(F.regexp_replace(stem, f"^{prefix}", ""), r"[^0-9A-Za-z_]", "_"), 1, 63))


def metric_despite_tag(df: DataFrame, x: str) -> bool:
    """Whether coordinates said to be degrees are metres: some is beyond 1,000."""
    return bool(df.agg(F.max(F.abs(x)) > 1000).first()[0])
