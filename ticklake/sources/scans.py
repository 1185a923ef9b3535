"""Scans (IO01-IO05, IO07, IO10, IO13-IO21, IO30, IO31)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.market import fold_levels
from ..functions.text import records_at

c = F.col


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: NULL from here on."""
    return df.select(*[F.nanvl(c(n), F.lit(None)).alias(n) if t in ("double", "float") else c(n) for n, t in df.dtypes])


def tick_csv(spark: SparkSession, path: str | Sequence[str], fmt: str = schemas.TICK_CSV_TIME) -> DataFrame:
    """IO01 tick CSV with a fixed time pattern."""
    paths = [path] if isinstance(path, str) else list(path)
    return nan_to_null(spark.read.schema(schemas.TICK).option("timestampNTZFormat", fmt).csv(paths, header=True))


def naive_utc(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Zoned times as zone-free UTC."""
    if isinstance(df.schema[ts].dataType, T.TimestampType):
        return df.withColumn(ts, F.to_utc_timestamp(ts, F.current_timezone()).cast("timestamp_ntz"))
    return df


def tick_parquet(spark: SparkSession, path: str | Sequence[str], ts: str = "Timestamp") -> DataFrame:
    """IO02/IO03 Parquet file or date-partitioned folder; Spark reads it in splits, so there is no chunk size."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return nan_to_null(naive_utc(df, ts).drop("date"))


def many_symbols(spark: SparkSession, paths: Mapping[str, str], ts: str = "Timestamp") -> DataFrame:
    """IO04 several tick files (or folders) as one table with ``Symbol``: one scan, the symbol from the path of a row's file."""
    df = spark.read.option("mergeSchema", True).parquet(*[paths[s] for s in sorted(paths)])
    file = F.url_decode(F.replace(c("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    symbol: Column = F.lit(None).cast("string")
    for s, path in sorted(paths.items(), key=lambda x: len(x[1])):  # the longest path that fits
        symbol = F.when(F.contains(F.concat(file, F.lit("/")), F.lit(path.split(":", 1)[-1].rstrip("/") + "/")), s).otherwise(symbol)
    return nan_to_null(naive_utc(df.withColumn("Symbol", symbol), ts).drop("date"))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def first_source(spark: SparkSession, symbol: str, root: str) -> DataFrame:
    """IO05 the Parquet history of a symbol, else its CSV."""
    for ext, read in ((".parquet", tick_parquet), (".csv", tick_csv)):
        p = f"{root}/{symbol}{ext}"
        if path_exists(spark, p):
            return read(spark, p).withColumn("Symbol", F.lit(symbol))
    raise FileNotFoundError(f"no history of {symbol} under {root}")


def since(spark: SparkSession, path: str, last: Column, lookback_days: int = 0, ts: str = "Timestamp") -> DataFrame:
    """IO07/IO10 rows newer than ``last`` plus ``lookback_days`` of context, with ``is_new``.

    Filters on the partition column and on the time, so old partitions are not read.
    """
    start = last - F.make_dt_interval(F.lit(lookback_days))
    df = spark.read.parquet(path)
    if "date" in df.columns:
        df = df.where(c("date") >= F.to_date(start)).drop("date")
    df = naive_utc(df, ts)
    return df.where((c(ts) > start) if not lookback_days else (c(ts) >= start)).withColumn("is_new", c(ts) > last)


def order_book(spark: SparkSession, path: str) -> DataFrame:
    """IO13 wide order-book snapshots with the levels as arrays."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    return fold_levels(df)


def context_csv(spark: SparkSession, folder: str, value: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """IO14/IO15/IO17 one CSV per symbol: first column the date, ``value`` the number, symbol from the file name."""
    df = spark.read.csv(folder, header=True)
    first = df.columns[0]
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    out = df.select(
        c(first).try_cast("timestamp_ntz").alias("Date"),
        F.url_decode(name).alias("Symbol"),
        c(value).try_cast("double").alias(value),
    ).where(c("Date").isNotNull())
    return out if symbols is None else out.where(c("Symbol").isin(list(symbols)))


def index_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO21 index OHLC file."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.toDF(*[x.strip() for x in df.columns])


def market_days(spark: SparkSession, path: str) -> DataFrame:
    """IO20 prediction-market daily dumps (one JSON list per file) as typed rows."""
    return typed_market_days(spark.read.schema(schemas.MARKET_DAY).json(path, multiLine=True, primitivesAsString=True))


def typed_market_days(raw: DataFrame) -> DataFrame:
    """IO20 numbers where they parse, 0 for missing volumes; bad dates or tickers are left out."""
    zero = lambda x: F.coalesce(c(x).try_cast("double"), F.lit(0.0)).alias(x)
    return raw.select(
        c("date").try_cast("date").alias("Date"), F.upper("report_ticker").alias("report_ticker"),
        zero("open_interest"), zero("daily_volume"), zero("block_volume"),
        c("high").try_cast("double").alias("high"), c("low").try_cast("double").alias("low"),
    ).where(c("Date").isNotNull() & c("report_ticker").isNotNull())


def series_spec(spec: str) -> dict:
    """IO19 ``provider::id?param=value&...`` taken apart."""
    provider, _, rest = spec.partition("::")
    if not rest:
        provider, rest = "", provider
    ident, _, query = rest.partition("?")
    params = dict(p.split("=", 1) for p in query.split("&") if "=" in p)
    return {"provider": provider.strip().lower(), "id": ident.strip(), "params": params}


# fixed values: where a provider's payload keeps its records, and their names of date and value; of several names the first at hand counts
RECORD_SHAPES = {
    "fred": ("observations", "date", "value"),
    "worldbank": ("[1]", "date", "value"),
    "imf": (("CompactData.DataSet.Series.Obs", "CompactData.DataSet.Series[0].Obs"), "@TIME_PERIOD", "@OBS_VALUE"),
    "finnhub": (("data", ""), "datetime", "value"),
    "alphavantage": (("data.data", "data", "series", "historical"), "date", ("value", "v")),
    "eodhd": (("data", ""), "date", "value"),
    "bcb": ("", ("data", "date"), ("valor", "value")),
    "statcan": (
        tuple(p + k for p in ("", "object.", "data.", "result.", "results.") for k in ("vectorDataPoints", "vectorDataPoint")),
        ("refPer2", "refPer", "referencePeriod", "refPeriod", "ref_date", "date"), ("value", "val", "value_decimal"),
    ),
    "generic": ("data", "date", "value"),
}
# fixed values: lists that run side by side (dates, values)
LIST_SHAPES = {"dbnomics": ("series.docs[0].period_start_day", "series.docs[0].value")}
SDMX_SHAPES = ("ecb", "oecd", "eurostat", "bankofengland")
EPOCH_SHAPES = ("finnhub",)  # dates are seconds since 1970, UTC
_DAY_SECONDS = 86_400


def day_of(text: Column) -> Column:
    """First day of a period: ISO dates and times, ``31/12/2024``, ``2024``, ``2024-05``, ``2024 MAY``, ``2024-Q2``, ``2024Q2`` or ``2024 Q2``, ``2024-M05`` or ``2024M05``."""
    t = F.trim(text)
    quarter = F.regexp_extract(t, "^(\\d{4})[- ]?Q([1-4])$", 2)
    named = F.regexp_extract(F.upper(t), "^\\d{4} (JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)", 1)
    month = F.regexp_extract(t, "^(\\d{4})-?M(\\d{1,2})$", 2)
    year = F.substring(t, 1, 4)
    first = F.when(quarter != "", F.concat_ws("-", year, F.lpad((quarter.try_cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("01")))
    first = first.when(month != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01")))
    first = first.when(t.rlike("^\\d{1,2}/\\d{1,2}/\\d{4}$"), F.regexp_replace(t, "^(\\d{1,2})/(\\d{1,2})/(\\d{4})$", "$3-$2-$1"))
    place = F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), named)
    first = first.when(named != "", F.concat_ws("-", year, F.lpad(F.floor((place + 2) / 3).cast("string"), 2, "0"), F.lit("01")))
    return first.otherwise(F.substring(t, 1, 10)).try_cast("date")


def day_of_epoch(text: Column) -> Column:
    """UTC day of seconds since 1970."""
    return F.date_from_unix_date(F.floor(text.try_cast("double") / _DAY_SECONDS).try_cast("int"))


def _number(text: Column, comma: str) -> Column:
    return F.replace(text, F.lit(","), F.lit(comma)).try_cast("double")


def _tuple(x) -> tuple:
    return (x,) if isinstance(x, str) else tuple(x)


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _inner(text: Column, *names: str) -> Column:
    """The number of a value that is an object holding it under one of ``names``, else the value."""
    return F.when(F.ltrim(text).startswith("{"), F.coalesce(*[_filled(F.get_json_object(text, f"$.{n}")) for n in names])).otherwise(_filled(text))


def _map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def _records(payload: str, path) -> Column:
    found = [records_at(c(payload), p, "map<string,string>") for p in _tuple(path)]
    return F.coalesce(*[F.when(F.size(F.filter(x, lambda r: r.isNotNull())) > 0, x) for x in found]) if len(found) > 1 else found[0]


def _bank_of_canada(df: DataFrame, payload: str, series: str | None) -> DataFrame:
    """``{"d": day, series: {"v": number}}``: the series asked for, else the only one described, else the first."""
    described = F.map_keys(_map(F.get_json_object(payload, "$.seriesDetail")))
    records = _records(payload, "observations")
    first = _first(F.filter(F.map_keys(_first(records)), lambda k: ~F.lower(k).isin("d", "date")))
    name = F.lit(series) if series else F.coalesce(F.when(F.size(described) == 1, _first(described)), first)
    rows = df.select(name.alias("k"), F.explode(records).alias("r"))
    day = F.coalesce(*[_filled(c("r")[n]) for n in ("d", "date", "DATE")])
    return rows.select(day.alias("d"), _inner(c("r")[c("k")], "v", "value", "value_decimal").alias("v"))


def _open_canada(df: DataFrame, payload: str) -> DataFrame:
    """Records whose date and value fields are told by their names and contents; an empty value falls back to the first number of its record."""
    records = _records(payload, ("result.records", "records"))
    rows = df.select(records.alias("rs")).where(F.size("rs") > 0)
    keys = F.map_keys(_first(c("rs")))
    all_have = lambda n: F.forall("rs", lambda r: F.map_contains_key(r, n))
    known = [F.when(all_have(n), F.lit(n)) for n in ("Date", "date", "ref_date", "REF_DATE", "reference_date")]
    named = _first(F.filter(keys, lambda k: F.lower(k).contains("date")))
    rows = rows.select("rs", F.coalesce(*known, named, _first(F.filter(keys, lambda k: k != "_id"))).alias("dk"))

    def numbers(r: Column) -> Column:
        usable = lambda e: (e["key"] != "_id") & (e["key"] != c("dk")) & _number(_inner(e["value"], "value", "v"), "").isNotNull()
        return F.filter(F.map_entries(r), usable)

    def field(r: Column) -> Column:
        found = numbers(r)
        return F.coalesce(_first(F.filter(found, lambda e: F.ltrim(e["value"]).startswith("{"))), _first(found))["key"]

    told = _first(F.filter(F.transform("rs", field), lambda k: k.isNotNull()))
    rows = rows.select("dk", told.alias("vk"), F.explode("rs").alias("r"))
    value = F.coalesce(_inner(c("r")[c("vk")], "value", "v"), _inner(_first(numbers(c("r")))["value"], "value", "v"))
    return rows.select(c("r")[c("dk")].alias("d"), value.alias("v"))


def _ons(df: DataFrame, payload: str) -> DataFrame:
    """Observations whose time is one of their dimensions."""
    rows = df.select(F.explode(_records(payload, ("observations", "items"))).alias("r"))
    rows = rows.select("r", F.map_entries(_map(c("r")["dimensions"])).alias("dims"))
    option = lambda x: F.coalesce(*[_filled(F.get_json_object(x, f"$.option.{n}")) for n in ("id", "label", "value")], F.when(~F.ltrim(F.get_json_object(x, "$.option")).startswith("{"), _filled(F.get_json_object(x, "$.option"))))
    time = ("time", "period", "date")
    at = _first(F.filter("dims", lambda e: F.lower(e["key"]).isin(*time) | F.coalesce(F.lower(F.get_json_object(e["value"], "$.id")).isin(*time), F.lit(False))))["value"]
    any_option = _first(F.filter(F.transform("dims", lambda e: option(e["value"])), lambda x: x.isNotNull()))
    labels = [_filled(F.get_json_object(at, f"$.{n}")) for n in ("label", "name", "id")]
    plain = [_filled(c("r")[n]) for n in ("time", "date", "period", "referencePeriod", "ref_period", "observation_date")]
    value = F.coalesce(_inner(c("r")["observation"], "value", "obs"), _inner(c("r")["value"], "value", "obs"))
    return rows.select(F.coalesce(option(at), *labels, any_option, *plain).alias("d"), value.alias("v"))


def _observed(observations: Column, labels: Column) -> tuple[Column, Column]:
    """Date and value of an SDMX entry ``(k, v)``: the last part of the key numbers the time, the value comes first in its list."""
    at = F.get(F.split("k", ":"), F.size(F.split("k", ":")) - 1).try_cast("int")
    return F.get(labels, at), F.when(F.ltrim(observations).startswith("["), F.get_json_object(observations, "$[0]")).otherwise(observations)


def _labels(values: Column) -> Column:
    """Texts of an SDMX dimension's values."""
    name = lambda x: F.when(F.ltrim(x).startswith("{"), F.coalesce(*[_filled(F.get_json_object(x, f"$.{n}")) for n in ("id", "name", "value")])).otherwise(x)
    return F.filter(F.transform(F.from_json(values, "array<string>"), name), lambda x: x.isNotNull())


def _sdmx(df: DataFrame, payload: str) -> DataFrame:
    """All series of the first data set of an SDMX-JSON message."""
    whole = F.coalesce(*[F.get_json_object(payload, f"$.{p}") for p in ("dataSets[0]", "dataSets.0", "dataSet")])
    dims = F.from_json(F.get_json_object(payload, "$.structure.dimensions.observation"), "array<string>")
    rows = df.select(whole.alias("set"), dims.alias("dims"))
    timed = _first(F.filter("dims", lambda x: F.upper(F.get_json_object(x, "$.id")).isin("TIME_PERIOD", "TIME")))
    series = lambda name: F.coalesce(F.transform(F.map_values(_map(F.get_json_object("set", f"$.{name}"))), lambda x: F.get_json_object(x, "$.observations")), F.array().cast("array<string>"))
    found = F.concat(F.array(F.get_json_object("set", "$.observations")), series("series"))
    found = F.filter(found, lambda x: x.isNotNull())
    found = F.when(F.size(found) > 0, found).otherwise(series("data"))
    time = F.coalesce(timed, F.get("dims", F.size("dims") - 1))
    rows = rows.select(_labels(F.get_json_object(time, "$.values")).alias("labels"), F.explode(found).alias("o"))
    rows = rows.select("labels", F.explode(_map(c("o"))).alias("k", "v"))
    day, value = _observed(c("v"), c("labels"))
    return rows.select(day.alias("d"), value.alias("v"))


def landed_records(df: DataFrame, shape: str | tuple, payload: str = "value", series: str | None = None) -> DataFrame:
    """IO19 (Date, value) from landed JSON texts of a provider; '.' and text mean missing.

    ``shape`` is a provider's name, or (path, date, value) of its records;
    ``series`` picks one where a payload of ``bankofcanada`` holds several.
    """
    shape = shape.replace("_", "") if isinstance(shape, str) else shape
    if shape in LIST_SHAPES:
        dates, values = (F.from_json(F.get_json_object(payload, f"$.{p}"), "array<string>") for p in LIST_SHAPES[shape])
        rows = df.select(F.explode(F.arrays_zip(dates.alias("d"), values.alias("v"))).alias("r")).select(c("r.d").alias("d"), c("r.v").alias("v"))
    elif shape in SDMX_SHAPES:
        rows = _sdmx(df, payload)
    elif shape == "bankofcanada":
        rows = _bank_of_canada(df, payload, series)
    elif shape == "opencanada":
        rows = _open_canada(df, payload)
    elif shape == "ons":
        rows = _ons(df, payload)
    else:
        path, date, value = RECORD_SHAPES[shape] if isinstance(shape, str) else shape
        pick = lambda names: F.coalesce(*[_filled(c("r")[n]) for n in _tuple(names)])
        rows = df.select(F.explode(_records(payload, path)).alias("r")).select(pick(date).alias("d"), pick(value).alias("v"))
    comma = "." if shape == "bcb" else ""  # a decimal comma there, a thousands mark elsewhere
    day = F.coalesce(day_of_epoch(c("d")), day_of(c("d"))) if shape in EPOCH_SHAPES else day_of(c("d"))
    return rows.select(day.alias("Date"), _number(c("v"), comma).alias("value")).where(c("Date").isNotNull() & c("value").isNotNull())


def landed_observations(df: DataFrame, values_path: str, dates_path: str, payload: str = "value") -> DataFrame:
    """IO19/X22 (Date, value) from an observation map keyed by index, alone or last after ':', and the list of its dates."""
    obs = _map(F.get_json_object(payload, "$." + values_path))
    rows = df.select(_labels(F.get_json_object(payload, "$." + dates_path)).alias("labels"), F.explode(obs).alias("k", "v"))
    day, value = _observed(c("v"), c("labels"))
    return rows.select(day_of(day).alias("Date"), _number(value, "").alias("value")).where("Date is not null and value is not null")


def external_context(df: DataFrame, table: DataFrame, rename: Mapping[str, str], how: str = "left") -> DataFrame:
    """IO30/J06 landed external records renamed and joined on the time."""
    return df.join(table.select(*[c(k).alias(v) for k, v in rename.items()]), "Timestamp", how)
