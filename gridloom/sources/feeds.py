"""Readers of public feeds and files: GeoJSON, delimited bridge lists, outage and quake JSON, script literals, pages of a service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import degrees

POINT_FEATURES = "features array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: array<double>>>>"
OUTAGES = (
    "regions array<struct<name: string, totalClients: int, totalClientsWithoutService: int, totalClientsWithService: int,"
    " totalClientsAffectedByPlannedOutage: int, totalClientsAffectedByLoadShed: int, percentageClientsWithoutService: double, percentageClientsWithService: double>>"
)


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """file, id, properties, x, y of the point features of GeoJSON files; files without features give no rows."""
    found = spark.read.schema(POINT_FEATURES).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("file"))
    each = found.select("file", F.explode("features").alias("f"))
    return each.where("f.geometry.type = 'Point'").select("file", "f.id", "f.properties", F.get("f.geometry.coordinates", F.lit(0)).alias("x"), F.get("f.geometry.coordinates", F.lit(1)).alias("y"))


def geojson_status(spark: SparkSession, path: str) -> DataFrame:
    """file, n and status (ok, empty or error) of each file: bad files are a status, not a failure."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", POINT_FEATURES, {"mode": "PERMISSIVE"}).alias("j"))
    n = F.size("j.features")
    return texts.select("file", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias("n"), F.when(F.col("j.features").isNull(), "error").when(n == 0, "empty").otherwise("ok").alias("status"))


def geojson_text(df: DataFrame, x: str, y: str, properties: list[str], digits: int = 6) -> DataFrame:
    """A row per part of the output, each a feature as JSON: a sink writes them as lines."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(x, digits), F.round(y, digits)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def bridges(spark: SparkSession, path: str, box: tuple[float, float, float, float] = (-68.5, 16.8, -64.0, 19.5)) -> DataFrame:
    """structure, lat, lon, year_built and span of a latin-1 list with degrees as digits, inside a box."""
    raw = spark.read.csv(path, header=True, encoding="iso-8859-1", quote="'")
    clean = lambda c: F.nullif(F.trim(F.translate(F.col(c), "'\"", "")), F.lit(""))
    positive = lambda c: F.when(clean(c).try_cast("double") > 0, clean(c).try_cast("double"))
    optional = lambda c: positive(c) if c in raw.columns else F.lit(None).cast("double")
    rows = raw.select(
        clean("STRUCTURE_NUMBER_008").alias("structure"), degrees(F.lpad(clean("LAT_016"), 8, "0"), 2).alias("lat"), (-degrees(F.lpad(clean("LONG_017"), 9, "0"), 3)).alias("lon"),
        optional("YEAR_BUILT_027").cast("int").alias("year_built"), optional("MAX_SPAN_LEN_MT_048").alias("span"),
    )
    return rows.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def outage_regions(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A row per named region of outage payloads; bad JSON gives none."""
    parsed = payloads.select(F.explode(F.from_json(column, OUTAGES)["regions"]).alias("r")).where(F.col("r.name").isNotNull() & (F.col("r.name") != ""))
    return parsed.select(
        F.col("r.name").alias("region"), F.col("r.totalClients").alias("clients"), F.col("r.totalClientsWithoutService").alias("without"), F.col("r.totalClientsWithService").alias("with"),
        F.col("r.totalClientsAffectedByPlannedOutage").alias("planned"), F.col("r.totalClientsAffectedByLoadShed").alias("shed"), F.col("r.percentageClientsWithoutService").alias("percent_without"),
    )


def quakes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """event_id, mag, place, at, lon, lat and depth of quake payloads, and whether they are significant (4.5 or more)."""
    features = F.from_json(column, POINT_FEATURES)["features"]
    f = payloads.select(F.explode(features).alias("f"))
    p, c = F.col("f.properties"), F.col("f.geometry.coordinates")
    mag = p["mag"].try_cast("double")
    return f.where("f.id is not null").select(
        F.col("f.id").alias("event_id"), mag.alias("mag"), p["place"].alias("place"), F.timestamp_millis(p["time"].try_cast("long")).alias("at"),
        F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(2)).alias("depth"), F.coalesce(mag >= 4.5, F.lit(False)).alias("significant"),
    )


def capacity_history(json_text: DataFrame, column: str = "value") -> DataFrame:
    """period, label and capacity from parallel arrays by period."""
    arrays = "struct<labels: array<string>, capacity: array<double>>"
    parsed = json_text.select(F.from_json(column, f"map<string, {arrays}>").alias("m")).select(F.explode("m").alias("period", "a"))
    return parsed.select("period", F.explode(F.arrays_zip("a.labels", "a.capacity")).alias("z")).select("period", F.col("z.labels").alias("label"), F.col("z.capacity").alias("capacity")).where("label is not null and capacity is not null")


def checksum(layer: Column, count: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", layer, count.cast("string")), 256), 1, 16)


def paged_source(fetch: Callable[[int, int], list[tuple]], schema: str, page: int = 1000, name: str = "pages") -> type[DataSource]:
    """A data source of a paged service: fetch(offset, limit) gives rows; an empty or short page ends it.

    The reported count of a service is not trusted, so pages follow one another in one task.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(0)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            offset = 0
            while True:
                rows = fetch(offset, page)
                yield from rows
                if len(rows) < page:
                    return
                offset += len(rows)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Pages
