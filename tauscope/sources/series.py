"""Daily series files of several archives, parsed from text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauscope.functions.expressions import CFS_TO_CMS, as_double, blank_to_null, norm_gauge
from tauscope.functions.tables import long_form

WATERML = """value struct<timeSeries:array<struct<
  sourceInfo:struct<siteName:string,siteCode:array<struct<value:string>>>,
  variable:struct<variableName:string,unit:struct<unitCode:string>>,
  values:array<struct<value:array<struct<value:string,dateTime:string,qualifiers:array<string>>>>>>>>"""

RIVER_FILE = "station_id string, station_name string, river_name string, country_code string, time string, discharge_m3s string, quality_flag string"


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"missing required columns: {', '.join(sorted(missing))}")


def _date(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def _mapped(raw: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return raw.select(
        *[(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(name) for name, c in columns.items()]
    )


def parse_river(
    raw: DataFrame, station: str = "station_id", time: str = "time", discharge: str = "discharge_m3s", **optional: str
) -> DataFrame:
    """Column-mapped discharge rows with q >= 0; rows lacking id, time or q are dropped."""
    require(raw, [station, time, discharge])
    names = {n: optional.get(n, n) for n in ("station_name", "river_name", "country_code", "quality_flag")}
    work = _mapped(raw, {"station_id": station, "time": time, "discharge_m3s": discharge, **names})
    return work.select(
        blank_to_null(F.col("station_id")).alias("station_id"), "station_name", "river_name", "country_code",
        _date(F.col("time")).alias("time"), as_double(F.col("discharge_m3s")).alias("discharge_m3s"), "quality_flag",
    ).where(F.col("station_id").isNotNull() & F.col("time").isNotNull() & (F.col("discharge_m3s") >= 0))


def read_river(spark: SparkSession, path: str) -> DataFrame:
    return parse_river(spark.read.csv(path, header=True, schema=RIVER_FILE))


def filter_series(df: DataFrame, start: str | None = None, end: str | None = None, **ids: str) -> DataFrame:
    """Id equality and an inclusive time range; pushed down to columnar sources."""
    keep = F.lit(True)
    for column, wanted in ids.items():
        keep = keep & (F.col(column) == F.lit(wanted))
    if start is not None:
        keep = keep & (F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        keep = keep & (F.col("time") <= F.lit(end).cast("timestamp_ntz"))
    return df.where(keep)


def parse_glacier(raw: DataFrame) -> DataFrame:
    """Velocity rows; a missing point id becomes ``point_001`` and negative values stay."""
    require(raw, ["glacier_id", "time", "velocity_myr"])
    names = ["glacier_id", "point_id", "time", "velocity_myr", "velocity_error_myr", "source"]
    work = _mapped(raw, {n: n for n in names})
    return work.select(
        blank_to_null(F.col("glacier_id")).alias("glacier_id"),
        F.coalesce(blank_to_null(F.col("point_id")), F.lit("point_001")).alias("point_id"),
        _date(F.col("time")).alias("time"),
        as_double(F.col("velocity_myr")).alias("velocity_myr"),
        as_double(F.col("velocity_error_myr")).alias("velocity_error_myr"), "source",
    ).where(F.col("glacier_id").isNotNull() & F.col("time").isNotNull() & F.col("velocity_myr").isNotNull())


def parse_nwis(pages: DataFrame, column: str = "json") -> DataFrame:
    """WaterML documents to river rows; cubic feet become cubic metres."""
    series = pages.select(F.explode(F.from_json(column, WATERML)["value"]["timeSeries"]).alias("s"))
    blocks = series.select("s", F.explode("s.values").alias("b"))
    rows = blocks.select("s", F.explode("b.value").alias("p"))
    unit = F.col("s.variable.unit.unitCode")
    raw = as_double(F.col("p.value"))
    return rows.select(
        F.trim(F.coalesce(F.get(F.col("s.sourceInfo.siteCode"), F.lit(0))["value"], F.lit(""))).alias("station_id"),
        F.col("s.sourceInfo.siteName").alias("station_name"),
        F.coalesce(F.col("s.variable.variableName"), F.lit("Discharge")).alias("river_name"),
        F.lit("US").alias("country_code"),
        _date(F.col("p.dateTime")).alias("time"),
        F.when(unit.isin("ft3/s", "cfs"), raw * F.lit(CFS_TO_CMS)).otherwise(raw).alias("discharge_m3s"),
        F.coalesce(F.array_join("p.qualifiers", ","), F.lit("")).alias("quality_flag"),
        unit.alias("source_unit"),
    ).where((F.col("station_id") != "") & F.col("time").isNotNull() & (F.col("discharge_m3s") >= 0))


def _day(year: Column, month: Column, day: Column) -> Column:
    """Date from three texts; null when any part is unreadable or out of range."""
    y, m, d = (c.try_cast("int") for c in (year, month, day))
    sane = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31)
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(sane, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def parse_us_lines(lines: DataFrame, column: str = "value", gauge: Column | None = None) -> DataFrame:
    """``id year month day q flag`` lines; unreadable lines and negative q are skipped."""
    token = lambda i: F.get(F.col("_t"), F.lit(i))
    ident = gauge if gauge is not None else token(0)
    return (
        lines.withColumn("_t", F.split(F.trim(column), r"\s+"))
        .where(F.size("_t") >= 5)
        .select(ident.alias("gauge_id"), _day(token(1), token(2), token(3)).alias("day"), as_double(token(4)).alias("q"))
        .where(F.col("day").isNotNull() & (F.col("q") >= 0))
    )


def read_us_flow(spark: SparkSession, path: str) -> DataFrame:
    """Line files named by gauge; files are split by size, not read whole."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"))
    return parse_us_lines(lines, "value", F.regexp_replace("_file", r"\.[^.]*$", ""))


def first_per_day(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series and day (smallest q when a day repeats)."""
    return df.groupBy(*keys, "day").agg(F.min("q").alias("q"))


def parse_br_lines(lines: DataFrame, column: str = "value", gauge: str = "gauge_id") -> DataFrame:
    """``year month day q`` lines; -9999 and negative flow become gaps that stay."""
    token = lambda i: F.get(F.col("_t"), F.lit(i))
    q = as_double(token(3))
    return (
        lines.withColumn("_t", F.split(F.trim(column), r"\s+"))
        .select(gauge, _day(token(0), token(1), token(2)).alias("day"), F.when(q >= 0, q).alias("q"))
        .where(F.col("day").isNotNull())
    )


def non_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
    return df


def wide_to_long(wide: DataFrame, day: Column, stations: Sequence[str]) -> DataFrame:
    """One column per station to one row per station and day; sentinels become null."""
    work = wide.select(day.alias("day"), *[F.col(c).cast("string").alias(c) for c in stations])
    long = long_form(work, ["day"], stations, "gauge_id", "_text")
    q = as_double(F.when(~F.trim("_text").isin("-99.99", "n/a", "NA", ""), F.col("_text")))
    return long.where(F.col("day").isNotNull()).select("gauge_id", "day", F.when(q >= 0, q).alias("q"))


def variables_to_long(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Per-catchment storage and flux columns to (keys, variable, value)."""
    work = df.select(*keys, *[as_double(F.col(v)).alias(v) for v in variables])
    return long_form(work, keys, variables, "variable", "value")


def parse_forcing(lines: DataFrame, file: str, position: str, column: str = "value") -> DataFrame:
    """Daily precipitation below the header line found inside each file.

    The header is the first line naming year, month and precipitation; columns are
    looked up by its tokens. Lines carry their position, so files need not be whole rows.
    """
    low = F.lower(F.trim(column))
    is_header = low.contains("year") & low.contains("mnth") & (low.contains("prcp") | low.contains("precip"))
    tokens = F.split(F.trim(column), r"\s+")
    headers = (
        lines.where(is_header)
        .groupBy(file)
        .agg(F.min_by(F.split(low, r"\s+"), position).alias("_names"), F.min(position).alias("_at"))
    )
    where = lambda test: F.array_position(F.transform("_names", test), True).cast("int") - 1
    at = {
        "year": where(lambda n: n == "year"), "month": where(lambda n: n.isin("mnth", "month")),
        "day": where(lambda n: n == "day"), "p": where(lambda n: n.contains("prcp") | n.contains("precip")),
    }
    body = lines.join(headers, file).where(F.col(position) > F.col("_at")).withColumn("_t", tokens)
    pick = lambda n: F.when(at[n] >= 0, F.get(F.col("_t"), at[n]))
    whole = lambda n: pick(n).try_cast("double").cast("int").cast("string")
    return body.select(
        F.col(file).alias("gauge_id"), _day(whole("year"), whole("month"), whole("day")).alias("day"),
        as_double(pick("p")).alias("precip"),
    ).where(F.col("day").isNotNull())


def first_positive(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c > 0, c) for c in columns])


def parse_chemistry(raw: DataFrame, solutes: Sequence[str], width: int = 8) -> DataFrame:
    """Sample rows in long form with the first positive of four discharge columns."""
    number = lambda c: as_double(F.col(c)) if c in raw.columns else F.lit(None).cast("double")
    q = first_positive(*[number(c) for c in ("q_inst", "q_15", "q_derived", "q_daily")])
    wide = raw.select(
        norm_gauge(F.col("gauge_id"), width).alias("gauge_id"),
        F.try_to_timestamp(F.col("sample_start_dt").cast("string")).cast("timestamp_ntz").alias("sample_date"),
        q.alias("q_use"), *[number(s).alias(s) for s in solutes if s in raw.columns],
    )
    present = [s for s in solutes if s in raw.columns]
    return long_form(wide, ["gauge_id", "sample_date", "q_use"], present, "constituent", "concentration")


def parse_tracer(raw: DataFrame, stamp: str, cadence: str, numbers: Sequence[str]) -> DataFrame:
    """Tab-separated tracer rows with dotted time stamps, tagged by sampling cadence."""
    return raw.select(
        "site", "type", F.lit(cadence).alias("cadence"),
        F.try_to_timestamp(F.col(stamp), F.lit("yyyy.MM.dd HH:mm")).cast("timestamp_ntz").alias("datetime"),
        *[as_double(F.col(n)).alias(n) for n in numbers],
    )


def parse_wells(rows: DataFrame, file: str = "file") -> DataFrame:
    """Monthly well levels; the id sits in the file name, files without it are skipped."""
    ident = F.regexp_extract(file, r"monthly_timeseries_(.+)_\d{8}-\d{8}\.csv$", 1)
    return rows.withColumn("_id", ident).where(F.col("_id") != "").select(
        F.upper("_id").alias("gw_well_id"), F.lower("_id").alias("gw_well_id_norm"),
        F.try_to_timestamp(F.col("date").cast("string")).cast("date").alias("day"),
        as_double(F.col("groundwater_level")).alias("level"),
    ).where(F.col("day").isNotNull())


def join_attributes(tables: Sequence[DataFrame], key: str, how: str = "full_outer") -> DataFrame:
    """Attribute tables joined on the gauge id; a repeated column comes from the first table."""
    out = tables[0]
    for other in tables[1:]:
        fresh = [c for c in other.columns if c == key or c not in out.columns]
        out = out.join(other.select(*fresh), key, how)
    return out


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work left after a partial run: rows whose key is not in the finished output."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Write a result table, Parquet by default, partitioned for pruning."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition) if partition else writer).save(path)
