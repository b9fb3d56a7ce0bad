"""Readers of landed files. Each bar reader gives symbol, ts (ms), open, high, low, close, volume, contract.

Where the files don't say their symbol, a reader is given it: one symbol's name, or a column such
as ``in_path()``, so that the files of any number of symbols are one scan.

Rows whose numbers can't be read are dropped by ``checked`` or set aside by ``quarantined``;
both tests are one expression, so nothing is parsed twice. Files without rows give none.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import epoch_ms, finite

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("ts", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")), T.StructField("contract", T.StringType())])
_PRICES = ("open", "high", "low", "close")


def _iso_ms(x: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(x))


def any_ms(x: Column) -> Column:
    """Milliseconds from an epoch number in any unit, or from ISO text."""
    text = F.trim(x.cast("string"))
    return F.when(text.rlike(r"^\d+$"), epoch_ms(F.when(text.rlike(r"^\d+$"), text).otherwise("0"))).otherwise(_iso_ms(text))


def _bars(rows: DataFrame, symbol: Column, ts: Column, prices: tuple[Column, ...], volume: Column, contract: Column | None = None) -> DataFrame:
    contract = F.lit(None).cast("string") if contract is None else F.when(F.trim(contract) != "", contract)
    return rows.select(symbol.cast("string").alias("symbol"), ts.alias("ts"), *(finite(p.cast("string")).alias(n) for n, p in zip(_PRICES, prices, strict=True)), F.coalesce(finite(volume.cast("string")), F.lit(0.0)).alias("volume"), contract.alias("contract"))


def in_path(pattern: str = r"/symbol=([^/]+)/") -> Column:
    """The symbol in each file's own path: what the pattern's group matches, null if nothing."""
    found = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return F.when(found != "", F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def _of(rows: DataFrame, symbol: "str | Column") -> DataFrame:
    """rows of files with their symbol, taken while a row still knows its file."""
    return rows.withColumn("_symbol", symbol if isinstance(symbol, Column) else F.lit(symbol))


def _sound() -> Column:
    ok = F.col("ts").isNotNull()
    for c in _PRICES:
        ok = ok & F.col(c).isNotNull()
    return ok


def checked(bars: DataFrame) -> DataFrame:
    return bars.filter(_sound())


def quarantined(bars: DataFrame) -> DataFrame:
    return bars.filter(~_sound())


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """The store (partitioned by symbol, tf and year); filters on these prune folders. A folder that isn't there yet has no bars."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], BARS)
    return spark.read.schema(BARS).parquet(path)


def read_partition(spark: SparkSession, path: str, symbol: str, tf: str, years: list[int]) -> DataFrame:
    return read_bars(spark, path).filter((F.col("symbol") == symbol) & (F.col("tf") == tf) & F.col("year").isin(years))


def read_csv_bars(spark: SparkSession, path: str, symbol: str | Column, mapping: dict[str, str], ts_unit: str = "ms", delimiter: str = ",", since: int | None = None, until: int | None = None) -> DataFrame:
    """CSV with a header; mapping names the column of ts, the prices and maybe volume and contract; ts_unit is ms, s or iso. Of the bars, those with since < ts <= until.

    All files of a folder must name the same columns in the same order; another header is an error.
    """
    rows = _of(spark.read.option("header", True).option("enforceSchema", False).option("sep", delimiter).option("escape", '"').csv(path), symbol)
    col = lambda name: F.col(f"`{mapping[name]}`") if name in mapping else F.lit(None).cast("string")
    stamp = F.trim(col("ts"))
    ts = {"ms": stamp.try_cast("long"), "s": (stamp.try_cast("decimal(20,3)") * 1000).cast("long"), "iso": _iso_ms(stamp)}[ts_unit]
    bars = _bars(rows.filter(stamp != ""), F.col("_symbol"), ts, tuple(map(col, _PRICES)), col("volume"), col("contract"))
    after = F.lit(True) if since is None else F.col("ts") > since
    return bars.filter(after & (F.lit(True) if until is None else F.col("ts") <= until))


def read_kline_csv(spark: SparkSession, path: str, symbol: str | Column) -> DataFrame:
    """Open time in ms or us, then prices and volume; a header row, if any, has no digit first."""
    names = ["t", *_PRICES, "volume"]
    schema = ", ".join(f"{n} string" for n in names)
    rows = _of(spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path), symbol).filter(F.col("t").rlike(r"^\d"))
    return _bars(rows, F.col("_symbol"), epoch_ms(F.col("t")), tuple(map(F.col, _PRICES)), F.col("volume"))


def _json_rows(spark: SparkSession, path: str, schema: str, symbol: str | Column) -> DataFrame:
    """Each element of the JSON arrays in the files of path, with the file's symbol."""
    return _of(spark.read.text(path, wholetext=True), symbol).select("_symbol", F.explode(F.from_json("value", schema)).alias("r"))


def read_kline_json(spark: SparkSession, path: str, symbol: str | Column) -> DataFrame:
    rows = _json_rows(spark, path, "array<array<string>>", symbol)
    at = lambda i: F.get(F.col("r"), i)
    return _bars(rows, F.col("_symbol"), epoch_ms(at(0)), tuple(at(i) for i in (1, 2, 3, 4)), at(5))


def read_candles_json(spark: SparkSession, path: str, symbol: str | Column) -> DataFrame:
    """Arrays of time (s), low, high, open, close, volume."""
    rows = _json_rows(spark, path, "array<array<string>>", symbol)
    at = lambda i: F.get(F.col("r"), i)
    return _bars(rows, F.col("_symbol"), epoch_ms(at(0)), tuple(at(i) for i in (3, 2, 1, 4)), at(5))


def read_bars_page_json(spark: SparkSession, path: str, symbol: str | Column) -> DataFrame:
    """Pages of {bars: [{t, o, h, l, c, v}], next_page_token}; bars may be null."""
    rows = _of(spark.read.option("multiLine", True).schema("bars array<struct<t:string,o:string,h:string,l:string,c:string,v:string>>").json(path), symbol).select("_symbol", F.explode("bars").alias("r"))
    return _bars(rows, F.col("_symbol"), any_ms(F.col("r.t")), tuple(F.col(f"r.{c}") for c in "ohlc"), F.col("r.v"))


def _header(spark: SparkSession, path: str, symbol: str | Column | None = None) -> DataFrame:
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    rows = rows if symbol is None else _of(rows, symbol)
    return rows.toDF(*(c.strip().lower() for c in rows.columns))


def _alias(rows: DataFrame, *names: str) -> Column:
    return F.coalesce(*(F.col(n) for n in names if n in rows.columns), F.lit(None).cast("string"))


def read_ohlcv_csv_ns(spark: SparkSession, path: str, symbol: str | Column) -> DataFrame:
    """Columns by name: ts_event (ns), prices, volume, symbol (the contract)."""
    rows = _header(spark, path, symbol)
    return _bars(rows, F.col("_symbol"), any_ms(F.col("ts_event")), tuple(map(F.col, _PRICES)), F.col("volume"), _alias(rows, "symbol"))


def read_flat_minutes(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Whole-market CSV, plain or gzipped, with the usual names for ticker, time and volume; all tickers, or one."""
    rows = _header(spark, path)
    ticker = _alias(rows, "ticker", "symbol")
    rows = rows if symbol is None else rows.filter(ticker == symbol)
    return _bars(rows, ticker, any_ms(_alias(rows, "window_start", "timestamp", "ts", "t")), tuple(map(F.col, _PRICES)), _alias(rows, "volume", "v"))


def read_candle_objects_json(spark: SparkSession, path: str, symbol: str | Column) -> DataFrame:
    """Arrays of {ts or timestamp, open, high, low, close, volume?}; time as epoch or ISO."""
    rows = _json_rows(spark, path, "array<struct<ts:string,timestamp:string,open:string,high:string,low:string,close:string,volume:string>>", symbol)
    return _bars(rows, F.col("_symbol"), any_ms(F.coalesce("r.ts", "r.timestamp")), tuple(F.col(f"r.{c}") for c in _PRICES), F.col("r.volume"))


read_rates_json = read_candle_objects_json


def read_candle_short_json(spark: SparkSession, path: str, symbol: str | Column) -> DataFrame:
    rows = _json_rows(spark, path, "array<struct<t:string,o:string,h:string,l:string,c:string,v:string>>", symbol)
    return _bars(rows, F.col("_symbol"), any_ms(F.col("r.t")), tuple(F.col(f"r.{c}") for c in "ohlc"), F.col("r.v"))


def read_calendar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Holidays (exchange, date, name) and half days (also close_min), each with the calendar's version, covered_from and covered_to."""
    schema = "exchange string, version string, coverage struct<`from`:date,`to`:date>, holidays array<struct<date:date,name:string>>, halfDays array<struct<date:date,name:string,close:string>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    about = ["exchange", "version", F.col("coverage.from").alias("covered_from"), F.col("coverage.to").alias("covered_to")]
    part = lambda k: F.split("h.close", ":")[k].cast("int")
    each = lambda name: rows.select(*about, F.explode(name).alias("h")).filter("h is not null")
    keep = ["version", "covered_from", "covered_to"]
    return each("holidays").select("exchange", "h.date", "h.name", *keep), each("halfDays").select("exchange", "h.date", "h.name", (part(0) * 60 + part(1)).alias("close_min"), *keep)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(date, event, detail) rows of all event files of a folder, with the file's version, sources and coverage."""
    schema = "event string, detail string, version string, sources array<string>, coverage struct<`from`:date,`to`:date>, dates array<date>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    return rows.select(F.explode("dates").alias("date"), "event", "detail", "version", "sources", F.col("coverage.from").alias("covered_from"), F.col("coverage.to").alias("covered_to"))


def read_fills_csv(spark: SparkSession, path: str) -> DataFrame:
    """fill_id, symbol, side, quantity, price, fee, ts and ok (false where side, quantity or price can't be used); callers count and drop the rest."""
    rows = spark.read.option("header", True).csv(path).withColumn("file", F.input_file_name())
    rows = rows.toDF(*(c.strip().lower() for c in rows.columns))
    quantity, price = finite(F.col("quantity")), finite(F.col("price"))
    side = F.lower(F.trim("side"))
    ok = side.isin("buy", "sell") & (quantity > 0) & price.isNotNull() & (F.trim("symbol") != "")
    fee = finite(F.col("fee")) if "fee" in rows.columns else F.lit(None).cast("double")
    return rows.select(F.monotonically_increasing_id().alias("fill_id"), F.trim("symbol").alias("symbol"), side.alias("side"), quantity.alias("quantity"), price.alias("price"), fee.alias("fee"), any_ms(_alias(rows, "executedat", "executed_at")).alias("ts"), F.coalesce(ok, F.lit(False)).alias("ok"))
