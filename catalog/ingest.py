"""Parsers, filters and joins of raw records.

Raw text and JSON documents are derived from the given tables by Spark, parsed again by
the operator, and checked against the values they were made from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import KEYS, query, r, rounded, rs, step
from tauscope.functions.expressions import beta_status, energy_joule, norm_gauge
from tauscope.functions.tables import config_table
from tauscope.session import shared_folder
from tauscope.sources import adapters, events, series

step("catalogue", """
SELECT 'ev' || event_id AS event_id, ts AS time, cast((user_id * 7) % 180 - 90 AS double) AS latitude,
       cast((user_id * 13) % 360 - 180 AS double) AS longitude,
       cast(json_extract_string(props, '$.k') AS double) * 7e0 AS depth_km,
       25e-1 + value / 50e0 AS magnitude, event_type AS mag_type, 'user ' || user_id AS place, event_id AS num
FROM events""")


def feature_json(spark, d):
    """One FeatureCollection per event; every seventh feature lacks its depth."""
    e = adapters.catalogue(spark, d).withColumn("num", F.substring("event_id", 3, 20).cast("bigint"))
    xy = F.array("longitude", "latitude")
    coordinates = F.when(F.col("num") % 7 == 0, xy).otherwise(F.concat(xy, F.array("depth_km")))
    feature = F.struct(
        F.when(F.col("num") % 11 != 0, F.concat(F.lit("q"), (F.col("num") % 4000).cast("string"))).alias("id"),
        F.struct(
            F.unix_millis(F.col("time").cast("timestamp")).alias("time"), F.col("magnitude").alias("mag"),
            F.col("mag_type").alias("magType"), "place", F.lit(None).cast("string").alias("url"),
        ).alias("properties"),
        F.struct(coordinates.alias("coordinates")).alias("geometry"),
    )
    return e.select(F.col("num").alias("page"), F.to_json(F.struct(F.array(feature).alias("features"))).alias("json"))


step("feature_rows", """
SELECT num AS page, CASE WHEN num % 11 <> 0 THEN 'q' || (num % 4000) END AS event_id, date_trunc('millisecond', time) AS time, latitude, longitude,
       CASE WHEN num % 7 <> 0 THEN depth_km END AS depth_km, magnitude, mag_type, place FROM catalogue""")


@query("src_comcat_json", f"SELECT event_id, time, {rs('latitude', 'longitude', 'depth_km', 'magnitude')}, mag_type, place FROM feature_rows")
def _(spark, d):
    out = events.comcat_events(events.comcat_features(feature_json(spark, d)))
    return rounded(out.withColumn("time", F.col("time").cast("timestamp_ntz")).drop("url"))


@query("merge_pages_dedup", f"""SELECT page, event_id, time, {rs('magnitude')} FROM feature_rows
QUALIFY event_id IS NULL OR row_number() OVER (PARTITION BY event_id ORDER BY page) = 1""")
def _(spark, d):
    merged = events.merge_pages(events.comcat_features(feature_json(spark, d)))
    return rounded(
        merged.select(
            "page", F.col("feature.id").alias("event_id"),
            F.timestamp_millis("feature.properties.time").cast("timestamp_ntz").alias("time"),
            F.col("feature.properties.mag").cast("double").alias("magnitude"),
        )
    )


def glc_raw(spark, d):
    """Landslide-like text rows: two date spellings, padded and empty texts."""
    e = adapters.table(spark, d, "events")
    n = F.col("event_id")
    clock = F.date_format("ts", "MM/dd/yyyy hh:mm:ss a")
    return e.select(
        n.cast("string").alias("event_id"),
        F.when(n % 13 == 0, "not a date").when(n % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(clock).alias("event_date"),
        F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("landslide_trigger"),
        F.when(F.col("user_id") % 5 == 0, "  ").otherwise(F.concat(F.lit("C"), F.col("user_id") % 9)).alias("country_code"),
        F.when(F.col("user_id") % 17 == 0, "n/a").otherwise((F.col("user_id") % 180).cast("string")).alias("longitude"),
        ((F.col("user_id") % 90) / F.lit(2.0)).cast("string").alias("latitude"),
        F.get_json_object("props", "$.k").alias("fatality_count"),
    )


step("glc_rows", """
SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', ts) END AS event_date,
       cast(CASE WHEN event_id % 13 <> 0 THEN year(ts) END AS int) AS event_year, event_type AS landslide_trigger,
       CASE WHEN user_id % 5 <> 0 THEN 'C' || (user_id % 9) END AS country_code,
       CASE WHEN user_id % 17 <> 0 THEN cast(user_id % 180 AS double) END AS longitude,
       (user_id % 90) / 2e0 AS latitude, cast(json_extract_string(props, '$.k') AS double) AS fatality_count
FROM events""")
GLC = ["event_id", "event_date", "event_year", "landslide_trigger", "country_code", "longitude", "latitude", "fatality_count"]


@query("src_glc_csv", f"""SELECT {', '.join(GLC)}, cast(NULL AS varchar) AS country_name, cast(NULL AS varchar) AS source_link,
cast(NULL AS double) AS injury_count FROM glc_rows""")
def _(spark, d):
    return events.parse_glc(glc_raw(spark, d)).select(*GLC, "country_name", "source_link", "injury_count")


@query("filter_glc", f"""SELECT {', '.join(GLC)} FROM glc_rows WHERE event_date >= TIMESTAMP '2024-01-05' AND event_date <= TIMESTAMP '2024-01-25'
AND country_code = 'C4' AND landslide_trigger = 'error' AND longitude IS NOT NULL AND latitude IS NOT NULL""")
def _(spark, d):
    parsed = events.parse_glc(glc_raw(spark, d))
    return events.filter_glc(parsed, "2024-01-05", "2024-01-25", "c4", "ERROR").select(*GLC)


@query("glc_reporting", """SELECT event_year, count(event_id) AS n_events, count(DISTINCT country_code) AS n_countries,
count(DISTINCT landslide_trigger) AS n_triggers FROM glc_rows GROUP BY event_year""")
def _(spark, d):
    return events.glc_reporting(events.parse_glc(glc_raw(spark, d)))


@query("top_triggers", """SELECT 'global' AS trigger, count(*) AS n_events FROM events UNION ALL
SELECT trigger, n_events FROM (SELECT CASE event_type WHEN 'signup' THEN 'unknown' ELSE event_type END AS trigger, count(*) AS n_events
FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) WHERE trigger <> 'unknown' AND n_events >= 50""")
def _(spark, d):
    e = adapters.table(spark, d, "events")
    label = F.when(F.col("event_type") == "signup", "unknown").otherwise(F.col("event_type"))
    return events.top_triggers(e.withColumn("t", label), "t", 3, 50)


BOXES = [("north", 20.0, 90.0, -180.0, 180.0), ("south", -90.0, -20.0, -180.0, 180.0), ("pacific", -60.0, 60.0, 100.0, 180.0),
         ("atlantic", -60.0, 60.0, -60.0, 0.0), ("tropic", -23.0, 23.0, -180.0, 180.0), ("global", -90.0, 90.0, -180.0, 180.0)]
DEPTHS = [("all", -1e9, 1e9), ("shallow", 0.0, 70.0), ("intermediate", 70.0, 300.0), ("deep", 300.0, 800.0)]
FLOORS = [(2.5,), (3.5,), (5.0,), (9.0,)]
box_values = ", ".join(f"('{n}', {a}e0, {b}e0, {c}e0, {e}e0)" for n, a, b, c, e in BOXES)
step("boxes", f"SELECT * FROM (VALUES {box_values}) t(region, lat_min, lat_max, lon_min, lon_max)")
depth_values = ", ".join(f"('{n}', cast({a!r} AS double), cast({b!r} AS double))" for n, a, b in DEPTHS)
step("depths", f"SELECT * FROM (VALUES {depth_values}) t(depth_class, depth_min, depth_max)")
step("floors", "SELECT * FROM (VALUES (25e-1), (35e-1), (5e0), (9e0)) t(min_magnitude)")


def boxes(spark):
    return config_table(spark, ["region", "lat_min", "lat_max", "lon_min", "lon_max"], BOXES)


def depths(spark):
    return config_table(spark, ["depth_class", "depth_min", "depth_max"], DEPTHS)


@query("filter_region", f"""SELECT region, count(*) AS n, {r('avg(magnitude)', 'mean_magnitude')} FROM catalogue JOIN boxes
ON latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max GROUP BY region""")
def _(spark, d):
    hits = events.filter_box(adapters.catalogue(spark, d), boxes(spark))
    return rounded(hits.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("magnitude").alias("mean_magnitude")))


@query("filter_depth", f"""SELECT depth_class, count(*) AS n, {r('avg(depth_km)', 'mean_depth')} FROM catalogue JOIN depths
ON depth_km >= depth_min AND depth_km < depth_max GROUP BY depth_class""")
def _(spark, d):
    hits = events.filter_depth(adapters.catalogue(spark, d), depths(spark))
    return rounded(hits.groupBy("depth_class").agg(F.count(F.lit(1)).alias("n"), F.avg("depth_km").alias("mean_depth")))


@query("subset_grid", """SELECT min_magnitude, region, depth_class, count(event_id) AS n_events, count(event_id) >= 30 AS usable
FROM floors CROSS JOIN boxes CROSS JOIN depths LEFT JOIN catalogue ON magnitude >= min_magnitude
AND latitude BETWEEN lat_min AND lat_max AND longitude BETWEEN lon_min AND lon_max AND depth_km >= depth_min AND depth_km < depth_max
GROUP BY ALL""")
def _(spark, d):
    floors = config_table(spark, ["min_magnitude"], FLOORS)
    return events.subset_grid(adapters.catalogue(spark, d), boxes(spark), depths(spark), floors, 30)


@query("energy_joule", f"SELECT event_id, {r('log10(pow(1e1, 524e-2 + 144e-2 * magnitude))', 'log_energy')} FROM catalogue")
def _(spark, d):
    e = adapters.catalogue(spark, d)
    return rounded(e.select("event_id", F.log10(energy_joule(F.col("magnitude"))).alias("log_energy")))


# ---- daily series files -----------------------------------------------------------


@query("src_river_csv", f"""SELECT cast(l_suppkey AS varchar) AS station_id, cast(l_shipdate AS timestamp) AS time,
{r('l_quantity - 2e0', 'discharge_m3s')}, l_returnflag AS quality_flag FROM lineitem WHERE l_quantity >= 2""")
def _(spark, d):
    raw = adapters.table(spark, d, "lineitem").select(
        F.format_string(" %d ", "l_suppkey").alias("no"), F.col("l_shipdate").cast("string").alias("date"),
        (F.col("l_quantity") - F.lit(2.0)).cast("string").alias("flow"), F.col("l_returnflag").alias("flag"),
    )
    out = series.parse_river(raw, "no", "date", "flow", quality_flag="flag")
    return rounded(out.select("station_id", "time", "discharge_m3s", "quality_flag"))


def river(spark, d):
    """River rows from shipments, for the filter and coverage operators."""
    return adapters.recorded_flow(spark, d).select(
        F.col("gauge_id").alias("station_id"), F.concat(F.lit("River "), "archive").alias("river_name"),
        F.col("day").cast("timestamp_ntz").alias("time"), F.col("q").alias("discharge_m3s"),
    )


@query("filter_river", f"""SELECT gauge_id AS station_id, cast(day AS timestamp) AS time, {r('q', 'discharge_m3s')} FROM recorded
WHERE gauge_id = '00000003' AND day >= DATE '1996-01-01' AND day <= DATE '1998-12-31'""")
def _(spark, d):
    out = series.filter_series(river(spark, d), "1996-01-01", "1998-12-31", station_id="00000003")
    return rounded(out.select("station_id", "time", "discharge_m3s"))


def glacier_raw(spark, d):
    e = adapters.table(spark, d, "events")
    point = F.when(F.col("user_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("P"), F.col("user_id") % 4))
    return e.select(
        F.concat(F.lit("G"), F.col("user_id") % 25).alias("glacier_id"), point.alias("point_id"),
        F.col("ts").cast("string").alias("time"), (F.col("value") - F.lit(40.0)).cast("string").alias("velocity_myr"),
        F.get_json_object("props", "$.k").alias("velocity_error_myr"), F.col("event_type").alias("source"),
    )


step("glacier_rows", """
SELECT 'G' || (user_id % 25) AS glacier_id, CASE WHEN user_id % 4 = 0 THEN 'point_001' ELSE 'P' || (user_id % 4) END AS point_id,
       ts AS time, value - 40e0 AS velocity_myr, cast(json_extract_string(props, '$.k') AS double) AS velocity_error_myr,
       event_type AS source FROM events""")


@query("src_glacier_csv", f"SELECT glacier_id, point_id, time, {rs('velocity_myr', 'velocity_error_myr')}, source FROM glacier_rows")
def _(spark, d):
    return rounded(series.parse_glacier(glacier_raw(spark, d)))


@query("filter_glacier", f"""SELECT glacier_id, point_id, time, {rs('velocity_myr')} FROM glacier_rows WHERE glacier_id = 'G3'
AND point_id = 'P1' AND time >= TIMESTAMP '2024-01-03' AND time <= TIMESTAMP '2024-01-28'""")
def _(spark, d):
    out = series.filter_series(series.parse_glacier(glacier_raw(spark, d)), "2024-01-03", "2024-01-28", glacier_id="G3", point_id="P1")
    return rounded(out.select("glacier_id", "point_id", "time", "velocity_myr"))


@query("src_nwis_json", f"""SELECT cast(l_suppkey AS varchar) AS station_id, cast(l_shipdate AS timestamp) AS time,
{r("CASE l_linestatus WHEN 'F' THEN l_quantity * 28316846592e-12 ELSE l_quantity END", 'discharge_m3s')},
l_returnflag || ',' || l_linestatus AS quality_flag, CASE l_linestatus WHEN 'F' THEN 'ft3/s' ELSE 'm3/s' END AS source_unit
FROM lineitem WHERE l_suppkey > 0""")
def _(spark, d):
    point = F.struct(
        F.col("l_quantity").cast("string").alias("value"), F.col("l_shipdate").cast("string").alias("dateTime"),
        F.array("l_returnflag", "l_linestatus").alias("qualifiers"),
    )
    site = F.when(F.col("l_suppkey") > 0, F.col("l_suppkey").cast("string")).otherwise(" ")
    one = F.struct(
        F.struct(F.lit("s").alias("siteName"), F.array(F.struct(site.alias("value"))).alias("siteCode")).alias("sourceInfo"),
        F.struct(
            F.lit("Streamflow").alias("variableName"),
            F.struct(F.when(F.col("l_linestatus") == "F", "ft3/s").otherwise("m3/s").alias("unitCode")).alias("unit"),
        ).alias("variable"),
        F.array(F.struct(F.array(point).alias("value"))).alias("values"),
    )
    pages = adapters.table(spark, d, "lineitem").select(
        F.to_json(F.struct(F.struct(F.array(one).alias("timeSeries")).alias("value"))).alias("json")
    )
    return rounded(series.parse_nwis(pages).select("station_id", "time", "discharge_m3s", "quality_flag", "source_unit"))


@query("src_stac_json", """SELECT 'i' || event_id AS item_id, event_type AS collection, 'csv,zarr' AS asset_keys,
'http://x/' || event_id AS self_href FROM events""")
def _(spark, d):
    n = F.col("event_id").cast("string")
    item = F.struct(
        F.concat(F.lit("i"), n).alias("id"), F.col("event_type").alias("collection"), F.array("value").alias("bbox"),
        F.struct(F.col("ts").cast("string").alias("datetime")).alias("properties"),
        F.create_map(F.lit("zarr"), n, F.lit("csv"), n).alias("assets"),
        F.array(
            F.struct(F.lit("root").alias("rel"), F.lit("http://x").alias("href")),
            F.struct(F.lit("self").alias("rel"), F.concat(F.lit("http://x/"), n).alias("href")),
        ).alias("links"),
    )
    pages = adapters.table(spark, d, "events").select(F.to_json(F.struct(F.array(item).alias("features"))).alias("json"))
    return events.stac_items(pages).select("item_id", "collection", "asset_keys", "self_href")


@query("src_camels_us_txt", f"""SELECT lpad(cast(l_suppkey AS varchar), 8, '0') AS gauge_id, cast(l_shipdate AS date) AS day,
{r('l_quantity - 3e0', 'q')} FROM lineitem WHERE l_quantity >= 3 AND l_linenumber <> 5 AND l_linenumber <> 6""")
def _(spark, d):
    day = F.col("l_shipdate")
    month = F.when(F.col("l_linenumber") == 6, 13).otherwise(F.month(day))
    tail = F.when(F.col("l_linenumber") == 5, "").otherwise(F.concat((F.col("l_quantity") - 3).cast("string"), F.lit(" A")))
    lines = adapters.table(spark, d, "lineitem").select(
        F.concat_ws("  ", norm_gauge(F.col("l_suppkey"), 8), F.year(day), month, F.dayofmonth(day), tail).alias("value")
    )
    return rounded(series.parse_us_lines(lines))


@query("src_camels_br_txt", f"""SELECT lpad(cast(l_suppkey AS varchar), 8, '0') AS gauge_id, cast(l_shipdate AS date) AS day,
{r("CASE WHEN l_linenumber <> 1 AND l_quantity >= 3 THEN l_quantity - 3e0 END", 'q')} FROM lineitem""")
def _(spark, d):
    day = F.col("l_shipdate")
    q = F.when(F.col("l_linenumber") == 1, "-9999").otherwise((F.col("l_quantity") - 3).cast("string"))
    lines = adapters.table(spark, d, "lineitem").select(
        norm_gauge(F.col("l_suppkey"), 8).alias("gauge_id"),
        F.concat_ws(" ", F.year(day), F.month(day), F.dayofmonth(day), q).alias("value"),
    )
    return rounded(series.parse_br_lines(lines))


step("gb_rows", """
SELECT lpad(cast(l_suppkey AS varchar), 8, '0') AS gauge_id, cast(l_shipdate AS date) AS day,
       max(CASE WHEN l_quantity >= 3 THEN l_quantity - 3e0 END) AS q FROM lineitem GROUP BY ALL""")
step("gb_span", "SELECT gauge_id, min(day) AS lo, max(day) AS hi FROM gb_rows WHERE q IS NOT NULL GROUP BY gauge_id")
step("gb_days", "SELECT gauge_id, cast(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS date) AS day FROM gb_span")


@query("src_camels_gb_csv", f"SELECT g.gauge_id, g.day, {r('q')} FROM gb_days g LEFT JOIN gb_rows r ON g.gauge_id = r.gauge_id AND g.day = r.day")
def _(spark, d):
    from tauscope.operators import prep

    rows = adapters.table(spark, d, "lineitem").select(
        norm_gauge(F.col("l_suppkey"), 8).alias("gauge_id"), F.to_date("l_shipdate").alias("day"),
        (F.col("l_quantity") - F.lit(3.0)).alias("q"),
    )
    daily = series.non_negative(rows, ["q"]).groupBy("gauge_id", "day").agg(F.max("q").alias("q"))
    trimmed = prep.trim_valid(daily, ["gauge_id"], "day", "q")
    return rounded(prep.regular_grid(trimmed, ["gauge_id"], "day"))


FLAGS = ["A", "N", "R"]


@query("src_wide_to_long", f"""SELECT gauge_id, day, {r('CASE WHEN q >= 5 THEN q - 5e0 END', 'q')} FROM
(SELECT f AS gauge_id, day, max(CASE WHEN l_returnflag = f THEN l_quantity END) AS q FROM
(SELECT cast(l_shipdate AS date) AS day, l_returnflag, l_quantity FROM lineitem), (VALUES ('A'), ('N'), ('R')) t(f) GROUP BY ALL)""")
def _(spark, d):
    lineitem = adapters.table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    pick = [F.coalesce((F.max(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))) - 5).cast("string"), F.lit("-99.99")).alias(f) for f in FLAGS]
    return rounded(series.wide_to_long(lineitem.groupBy("day").agg(*pick), F.col("day"), FLAGS))


@query("src_camels_dk_csv", f"""SELECT gauge_id, day, variable, {r('value')} FROM (SELECT lpad(cast(l_suppkey AS varchar), 8, '0') AS gauge_id,
cast(l_shipdate AS date) AS day, unnest(['l_discount', 'l_quantity', 'l_tax']) AS variable, unnest([l_discount, l_quantity, l_tax]) AS value FROM lineitem)""")
def _(spark, d):
    rows = adapters.table(spark, d, "lineitem").select(
        norm_gauge(F.col("l_suppkey"), 8).alias("gauge_id"), F.to_date("l_shipdate").alias("day"),
        *[F.col(c).cast("string").alias(c) for c in ("l_discount", "l_quantity", "l_tax")],
    )
    return rounded(series.variables_to_long(rows, ["gauge_id", "day"], ["l_discount", "l_quantity", "l_tax"]))


@query("src_forcing_text", f"""SELECT lpad(cast(l_suppkey AS varchar), 8, '0') AS gauge_id, cast(l_shipdate AS date) AS day,
{r('l_tax', 'precip')} FROM lineitem""")
def _(spark, d):
    lineitem = adapters.table(spark, d, "lineitem")
    day = F.col("l_shipdate")
    body = lineitem.select(
        norm_gauge(F.col("l_suppkey"), 8).alias("file"), (F.col("l_orderkey") + 10).alias("line"),
        F.concat_ws(" ", F.year(day), F.month(day), F.dayofmonth(day), F.lit("12"), "l_quantity", "l_tax").alias("value"),
    )
    heads = lineitem.select(norm_gauge(F.col("l_suppkey"), 8).alias("file")).distinct().select(
        "file", F.inline(F.array(
            F.struct(F.lit(1).cast("bigint").alias("line"), F.lit("45.0 year of record").alias("value")),
            F.struct(F.lit(4).cast("bigint").alias("line"), F.lit("Year Mnth Day Hr dayl(s) PRCP(mm/day)").alias("value")),
        ))
    )
    return rounded(series.parse_forcing(body.unionByName(heads), "file", "line"))


def chemistry(spark, d):
    """Sample rows: three solutes per line and four candidate discharges."""
    li = adapters.table(spark, d, "lineitem")
    raw = li.select(
        F.col("l_suppkey").cast("double").alias("gauge_id"), F.col("l_shipdate").alias("sample_start_dt"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity") - 25).alias("q_inst"),
        F.when(F.col("l_linenumber") == 2, F.col("l_quantity")).alias("q_15"),
        F.when(F.col("l_linenumber") != 3, F.lit(-1.0)).alias("q_derived"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("q_daily"),
        (F.col("l_discount") + F.col("l_quantity") / F.lit(100.0)).alias("ca"),
        (F.col("l_tax") + F.col("l_extendedprice") / F.lit(1e5)).alias("cl"), F.col("l_discount").alias("doc"),
    )
    return series.parse_chemistry(raw, ["ca", "cl", "doc", "absent"])


step("chemistry", """
SELECT lpad(cast(l_suppkey AS varchar), 8, '0') AS gauge_id, l_shipdate AS sample_date,
       CASE WHEN l_linenumber = 1 AND l_quantity > 25 THEN l_quantity - 25 WHEN l_linenumber = 2 AND l_quantity > 0 THEN l_quantity
            WHEN l_extendedprice > 0 THEN l_extendedprice / 1000e0 END AS q_use,
       unnest(['ca', 'cl', 'doc']) AS constituent,
       unnest([l_discount + l_quantity / 100e0, l_tax + l_extendedprice / 1e5, l_discount]) AS concentration FROM lineitem""")


@query("src_chem_csv", f"SELECT gauge_id, sample_date, constituent, {rs('q_use', 'concentration', digits=9)} FROM chemistry")
def _(spark, d):
    return rounded(chemistry(spark, d), 9)


def tracer(spark, d):
    """Input and stream samples of two cadences from all events: as they come, and the mean of every day."""
    e = adapters.table(spark, d, "events").select(
        F.concat(F.lit("S"), F.col("user_id") % 6).alias("site"), F.when(F.col("event_type") == "click", "Input").otherwise("Stream").alias("type"),
        "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    days = e.groupBy("site", "type", F.date_trunc("day", "ts").alias("ts")).agg(F.avg("value").alias("value"), F.avg("k").alias("k"))
    text = lambda rows: rows.select("site", "type", F.date_format("ts", "yyyy.MM.dd HH:mm").alias("stamp"), F.col("value").cast("string").alias("cl"), F.col("k").cast("string").alias("flow"))
    return series.parse_tracer(text(e), "stamp", "7-hourly", ["cl", "flow"]).unionByName(series.parse_tracer(text(days), "stamp", "daily", ["cl", "flow"]))


step("tracer_rows", "SELECT 'S' || (user_id % 6) AS site, CASE event_type WHEN 'click' THEN 'Input' ELSE 'Stream' END AS type, ts, value, cast(json_extract_string(props, '$.k') AS double) AS k FROM events")
step("tracer", """
SELECT site, type, '7-hourly' AS cadence, date_trunc('minute', ts) AS datetime, value AS cl, k AS flow FROM tracer_rows
UNION ALL SELECT site, type, 'daily', date_trunc('day', ts)::TIMESTAMP, avg(value), avg(k) FROM tracer_rows GROUP BY ALL""")


@query("src_tracer_tsv", f"SELECT site, type, cadence, datetime, {rs('cl', 'flow')} FROM tracer")
def _(spark, d):
    return rounded(tracer(spark, d))


def wells(spark, d):
    """Monthly levels per well file, from customer orders."""
    orders = adapters.table(spark, d, "orders")
    month = F.trunc("o_orderdate", "month")
    level = orders.groupBy((F.col("o_custkey") % 60).alias("w"), month.alias("date")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("groundwater_level")
    )
    name = F.when(F.col("w") == 7, "readme.csv").otherwise(
        F.concat(F.lit("camels_groundwater_monthly_timeseries_w"), "w", F.lit("_19950101-20011231.csv"))
    )
    return series.parse_wells(level.withColumn("file", name))


step("wells", """
SELECT 'W' || (o_custkey % 60) AS gw_well_id, 'w' || (o_custkey % 60) AS gw_well_id_norm,
       cast(date_trunc('month', o_orderdate) AS date) AS day, round(sum(o_totalprice), 2) AS level
FROM orders WHERE o_custkey % 60 <> 7 GROUP BY ALL""")


@query("src_gw_wells", f"SELECT gw_well_id, gw_well_id_norm, day, {r('level', digits=2)} FROM wells")
def _(spark, d):
    return rounded(wells(spark, d), 2)


step("attributes", """
SELECT lpad(cast(s_suppkey AS varchar), 8, '0') AS gauge_id, area, aridity, baseflow_index, snow_fraction, elevation, s_acctbal AS slope
FROM supplier LEFT JOIN (SELECT l_suppkey, round(avg(l_quantity), 6) AS aridity, round(avg(l_discount), 6) AS baseflow_index,
  round(avg(l_tax), 6) AS snow_fraction, round(sum(l_extendedprice), 2) AS area FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey
LEFT JOIN (SELECT c_nationkey, round(avg(c_acctbal), 6) AS elevation FROM customer GROUP BY 1) ON s_nationkey = c_nationkey""")


@query("attrs_join_files", f"""SELECT coalesce(a.gauge_id, b.gauge_id, c.gauge_id) AS gauge_id, {r('a.area', 'area')}, {r('b.aridity', 'aridity')},
{r('c.slope', 'slope')} FROM (SELECT * FROM attributes WHERE baseflow_index > 5e-2) a
FULL JOIN (SELECT * FROM attributes WHERE aridity > 255e-1) b ON a.gauge_id = b.gauge_id
FULL JOIN (SELECT * FROM attributes WHERE slope > 0) c ON coalesce(a.gauge_id, b.gauge_id) = c.gauge_id""")
def _(spark, d):
    a = adapters.attributes(spark, d)
    tables = [
        a.where(F.col("baseflow_index") > 0.05).select("gauge_id", "area"),
        a.where(F.col("aridity") > 25.5).select("gauge_id", "aridity", (F.col("area") * 2).alias("area")),
        a.where(F.col("slope") > 0).select("gauge_id", "slope", (F.col("aridity") * 2).alias("aridity")),
    ]
    return rounded(series.join_attributes(tables, "gauge_id"))


@query("sink_tables", f"SELECT archive, count(*) AS n, {r('sum(q)', 'total', 2)} FROM recorded GROUP BY archive")
def _(spark, d):
    """The recorded series, written as a table partitioned by archive and read back."""
    path = f"{shared_folder(spark)}/recorded-{uuid.uuid4().hex}"
    series.write_table(adapters.recorded_flow(spark, d), path, ["archive"])
    flow = spark.read.parquet(path)
    return rounded(flow.groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("total")), 2)


@query("resume_anti", f"""SELECT archive, gauge_id, day, {r('q')} FROM recorded WHERE gauge_id NOT IN
(SELECT gauge_id FROM attributes WHERE slope > 5000)""")
def _(spark, d):
    done = adapters.attributes(spark, d).where(F.col("slope") > 5000)
    return rounded(series.resume(adapters.recorded_flow(spark, d), done, ["gauge_id"]))


@query("status_class", f"""SELECT gauge_id, CASE WHEN baseflow_index IS NULL OR aridity IS NULL THEN 'no_test'
WHEN abs(aridity / 15e0 - 5e0 / 3e0) <= 5e-2 THEN 'near_5_3' WHEN aridity / 15e0 < 5e0 / 3e0 THEN 'below_5_3' ELSE 'above_5_3' END AS status,
{r('abs(aridity / 15e0 - 5e0 / 3e0)', 'distance')} FROM attributes""")
def _(spark, d):
    a = adapters.attributes(spark, d)
    beta = F.col("aridity") / F.lit(15.0)
    return rounded(a.select(
        "gauge_id", beta_status(beta, F.when(F.col("baseflow_index").isNotNull(), 1).otherwise(0), 0.05).alias("status"),
        F.abs(beta - F.lit(5.0 / 3.0)).alias("distance"),
    ))
