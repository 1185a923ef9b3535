"""Fixed schemas of the tables read from files."""

from pyspark.sql import types as T

D, S, TS, L = T.DoubleType(), T.StringType(), T.TimestampNTZType(), T.LongType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


TICK = _schema(("Timestamp", TS, False), ("Bid", D, False), ("Ask", D, False), ("BidVolume", D, True), ("AskVolume", D, True))
TICK_SYMBOL = _schema(*[(f.name, f.dataType, f.nullable) for f in TICK], ("Symbol", S, True))
LABEL = _schema(("target", T.IntegerType(), False))
EVENT_LOG = _schema(("timestamp", TS, False), ("type", S, False), ("payload", S, True))
FEATURE_NUMBERS = ("return", "ma_5", "ma_10", "ma_30", "ma_60", "volatility_30", "rsi_14")
FEATURE = _schema(("Timestamp", TS, False), *[(n, D, False) for n in FEATURE_NUMBERS], ("market_regime", T.IntegerType(), False))
MARKET_DAY = _schema(
    ("date", S, True), ("report_ticker", S, True), ("open_interest", S, True), ("daily_volume", S, True),
    ("block_volume", S, True), ("high", S, True), ("low", S, True),
)

# fixed value: time format of tick CSV files
TICK_CSV_TIME = "yyyyMMdd HH:mm:ss:SSS"
