"""Shapes as well-known text: a kind (point, line or area) and parts, each an array of struct<x, y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the text form.
NAMES = {"point": ("POINT", "MULTIPOINT"), "line": ("LINESTRING", "MULTILINESTRING"), "area": ("POLYGON", "MULTIPOLYGON")}


def from_wkt(text: Column) -> Column:
    """struct<kind, parts>; EMPTY has no parts, and text of another kind or with a coordinate that is no number is NULL.

    A leading SRID and a third coordinate are passed over.  Rings of all polygons stand in order, outer ones before their holes.
    """
    tidy = F.regexp_replace(F.regexp_replace(text, r"^\s*(?i:SRID=\d+;)?\s*", ""), r"\s*([(),])\s*", "$1")
    word = F.upper(F.regexp_extract(tidy, r"^([A-Za-z]+)", 1))
    kind = F.lit(None).cast("string")
    for name, words in NAMES.items():
        kind = F.when(word.isin(*words), name).otherwise(kind)
    body = F.regexp_extract(tidy, r"^[^(]*\(+([^()].*?)\)+\s*$", 1)
    number = lambda p, i: F.get(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double")
    point = lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))
    parts = F.transform(F.split(body, r"\)+,\(+"), lambda part: F.transform(F.split(part, ","), point))
    good = F.forall(parts, lambda part: F.forall(part, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    empty = F.rlike(tidy, F.lit(r"(?i)\bEMPTY\s*$"))
    none = F.array().cast("array<array<struct<x: double, y: double>>>")
    return F.when(kind.isNotNull() & (empty | good), F.struct(kind.alias("kind"), F.when(empty, none).otherwise(parts).alias("parts")))


def _listed(points: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")"))


def _winding(ring: Column) -> Column:
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.signum(F.aggregate(F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v))


def to_wkt(kind: Column, parts: Column) -> Column:
    """The text of a shape: of an area, a ring that winds like the first one begins another polygon; no parts are EMPTY."""
    several = F.size(parts) > 1
    rings = F.transform(parts, lambda r: F.struct(_listed(r).alias("text"), (_winding(r) == _winding(F.get(parts, F.lit(0)))).alias("outer")))
    grouped = F.aggregate(rings, F.lit(""), lambda s, r: F.concat(s, F.when(s == "", F.lit("(")).when(r["outer"], F.lit("),(")).otherwise(F.lit(",")), r["text"]))
    outers = F.size(F.filter(rings, lambda r: r["outer"]))
    points = F.flatten(parts)
    said = (
        F.when(kind == "point", F.concat(F.when(F.size(points) > 1, F.lit("MULTIPOINT ")).otherwise(F.lit("POINT ")), _listed(points)))
        .when(kind == "line", F.when(several, F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform(parts, _listed), ","), F.lit(")"))).otherwise(F.concat(F.lit("LINESTRING "), _listed(F.get(parts, F.lit(0))))))
        .when(kind == "area", F.when(outers > 1, F.concat(F.lit("MULTIPOLYGON ("), grouped, F.lit("))"))).otherwise(F.concat(F.lit("POLYGON "), grouped, F.lit(")"))))
    )
    word = F.when(kind == "point", "POINT").when(kind == "line", "LINESTRING").when(kind == "area", "POLYGON")
    return F.when(F.size(parts) == 0, F.concat(word, F.lit(" EMPTY"))).otherwise(said)
