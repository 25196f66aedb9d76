"""Event catalogues: earthquake GeoJSON, landslide CSV, STAC items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauscope.functions.expressions import as_double, blank_to_null

GEOJSON = """features array<struct<id:string,
  properties:struct<time:bigint,mag:string,magType:string,place:string,url:string>,
  geometry:struct<coordinates:array<string>>>>"""

STAC = """features array<struct<id:string,collection:string,bbox:array<double>,
  properties:struct<datetime:string,start_datetime:string,end_datetime:string>,
  assets:map<string,string>,links:array<struct<rel:string,href:string>>>>"""

GLC_TEXT = [
    "country_name", "country_code", "admin_division_name", "landslide_category", "landslide_trigger",
    "landslide_size", "landslide_setting", "location_accuracy", "source_name", "source_link",
]
GLC_NUMBERS = ["fatality_count", "injury_count", "longitude", "latitude"]


def documents(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse one JSON document per row with a fixed schema."""
    return df.withColumn("_doc", F.from_json(column, schema))


def comcat_features(pages: DataFrame, column: str = "json") -> DataFrame:
    """FeatureCollection documents to one row per feature, position in the page kept."""
    return documents(pages, column, GEOJSON).select(
        *[c for c in pages.columns if c != column], F.posexplode("_doc.features").alias("pos", "feature")
    )


def comcat_events(features: DataFrame) -> DataFrame:
    """Feature structs to the nine event columns; short coordinate arrays give null."""
    p, xyz = F.col("feature.properties"), F.col("feature.geometry.coordinates")
    return features.select(
        F.col("feature.id").alias("event_id"),
        F.timestamp_millis(p["time"]).alias("time"),
        as_double(F.get(xyz, F.lit(1))).alias("latitude"),
        as_double(F.get(xyz, F.lit(0))).alias("longitude"),
        as_double(F.get(xyz, F.lit(2))).alias("depth_km"),
        as_double(p["mag"]).alias("magnitude"),
        p["magType"].alias("mag_type"), p["place"].alias("place"), p["url"].alias("url"),
    )


def read_comcat(spark: SparkSession, path: str) -> DataFrame:
    return comcat_events(comcat_features(spark.read.text(path, wholetext=True), "value"))


def merge_pages(features: DataFrame, page: str = "page") -> DataFrame:
    """Drop repeated feature ids; the first page wins and rows without an id all stay.

    The first occurrence is found by a map-side combined minimum, not by sorting each id.
    """
    ident = F.col("feature.id")
    place = F.struct(page, "pos")
    first = (
        features.where(ident.isNotNull())
        .groupBy(ident.alias("_id"))
        .agg(F.min_by(F.struct(page, "pos", "feature"), place).alias("_kept"))
        .select("_kept.*")
    )
    return first.unionByName(features.where(ident.isNull()).select(page, "pos", "feature"))


def stac_items(pages: DataFrame, column: str = "json") -> DataFrame:
    rows = documents(pages, column, STAC).select(F.explode("_doc.features").alias("f"))
    own = F.get(F.filter("f.links", lambda link: link["rel"] == "self"), F.lit(0))
    return rows.select(
        F.col("f.id").alias("item_id"), F.col("f.collection").alias("collection"),
        F.col("f.properties.datetime").alias("datetime"),
        F.col("f.properties.start_datetime").alias("start_datetime"),
        F.col("f.properties.end_datetime").alias("end_datetime"),
        F.col("f.bbox").alias("bbox"),
        F.coalesce(F.array_join(F.array_sort(F.map_keys("f.assets")), ","), F.lit("")).alias("asset_keys"),
        own["href"].alias("self_href"),
    )


def event_date(text: Column) -> Column:
    """US 12-hour stamps first, then ISO-like text."""
    clock = F.try_to_timestamp(text, F.lit("MM/dd/yyyy hh:mm:ss a"))
    return F.coalesce(clock, F.try_to_timestamp(text)).cast("timestamp_ntz")


def parse_glc(raw: DataFrame) -> DataFrame:
    """Landslide rows to 17 typed columns; absent optional columns become null."""
    missing = {"event_id", "event_date", "longitude", "latitude"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(sorted(missing))}")
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    return raw.select(
        have("event_id").try_cast("double").cast("bigint").alias("event_id"),
        event_date(have("event_date")).alias("event_date"),
        F.year(event_date(have("event_date"))).alias("event_year"),
        *[blank_to_null(have(c)).alias(c) for c in GLC_TEXT],
        *[as_double(have(c)).alias(c) for c in GLC_NUMBERS],
    )


def read_glc(spark: SparkSession, path: str) -> DataFrame:
    return parse_glc(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def filter_glc(
    df: DataFrame, start: str | None = "2007-01-01", end: str | None = None, country: str | None = None,
    trigger: str | None = None, need_coordinates: bool = True,
) -> DataFrame:
    """Inclusive dates, case-insensitive country and trigger, coordinates present."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("event_date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        keep = keep & (F.col("event_date") <= F.lit(end).cast("timestamp_ntz"))
    if country is not None:
        keep = keep & (F.upper("country_code") == country.upper())
    if trigger is not None:
        keep = keep & (F.lower("landslide_trigger") == trigger.lower())
    if need_coordinates:
        keep = keep & F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    return df.where(keep)


def glc_reporting(df: DataFrame) -> DataFrame:
    """Events, countries and triggers per year; rows without a year form one group.

    Distinct values are combined on the map side first, so a year with a large share
    of all rows costs one row per distinct value.
    """
    return df.groupBy("event_year").agg(
        F.count("event_id").alias("n_events"),
        F.count_distinct("country_code").alias("n_countries"),
        F.count_distinct("landslide_trigger").alias("n_triggers"),
    )


def top_triggers(df: DataFrame, trigger: str, k: int, min_events: int) -> DataFrame:
    """Groups to study: a global one plus the k most frequent triggers, ``unknown`` then removed."""
    counts = df.where(F.col(trigger).isNotNull()).groupBy(F.col(trigger).alias("trigger")).agg(
        F.count(F.lit(1)).alias("n_events")
    )
    top = counts.orderBy(F.desc("n_events"), "trigger").limit(k)
    top = top.where((F.lower("trigger") != "unknown") & (F.col("n_events") >= min_events))
    everything = df.agg(F.count(F.lit(1)).alias("n_events")).select(F.lit("global").alias("trigger"), "n_events")
    return everything.unionByName(top)


def filter_box(events: DataFrame, boxes: DataFrame) -> DataFrame:
    """Events per named latitude/longitude box, edges included; ``boxes`` is a config table."""
    inside = F.col("latitude").between(F.col("lat_min"), F.col("lat_max")) & F.col("longitude").between(
        F.col("lon_min"), F.col("lon_max")
    )
    return events.join(boxes, inside)


def filter_depth(events: DataFrame, classes: DataFrame) -> DataFrame:
    """Events per half-open depth class; classes may overlap."""
    inside = (F.col("depth_km") >= F.col("depth_min")) & (F.col("depth_km") < F.col("depth_max"))
    return events.join(classes, inside)


def subset_grid(
    events: DataFrame, boxes: DataFrame, classes: DataFrame, magnitudes: DataFrame, min_events: int
) -> DataFrame:
    """Event counts for every magnitude floor, region and depth class, zero rows included.

    Each event is matched to the three small config tables and counted on the map side;
    the full grid is then left joined with the counts.
    """
    grid = magnitudes.crossJoin(boxes.select("region")).crossJoin(classes.select("depth_class"))
    hits = filter_depth(filter_box(events, boxes), classes).join(
        magnitudes, F.col("magnitude") >= F.col("min_magnitude")
    )
    keys = ["min_magnitude", "region", "depth_class"]
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = grid.join(counts, keys, "left").withColumn("n_events", F.coalesce("_n", F.lit(0))).drop("_n")
    return out.withColumn("usable", F.col("n_events") >= min_events)
