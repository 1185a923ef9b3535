"""Named feature operators and the jobs that chain them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import market as mk
from ..plans.ordered import BLK, IDX, TICKS, Order, halo_blocks
from . import indicators as ind, quality
from .base import RowOp, apply_together, require_columns

TableOp = Callable[[DataFrame, Order], DataFrame]
FEATURES: dict[str, RowOp | TableOp] = {}


def feature(name: str, requires: Sequence[str] = (), no_null: Sequence[str] = ()):
    """P01-P03 register ``fn(df, order) -> df`` with the columns it needs and must leave without NULL."""

    def register(fn: TableOp) -> TableOp:
        def checked(df: DataFrame, order: Order = TICKS) -> DataFrame:
            out = fn(require_columns(df, requires), order)
            return quality.assert_no_null(out, no_null) if no_null else out

        FEATURES[name] = checked
        return fn

    return register


def add(name: str, op: RowOp) -> None:
    FEATURES[name] = op


for _name, _op in {
    "price": ind.price_block(),
    "donchian": ind.donchian(),
    "keltner": ind.keltner(),
    "stochastic": ind.stochastic(),
    "ram": ind.ram(),
    "fractal": ind.fractal(),
    "spectral": ind.spectral_energy(),
    "fft": ind.fft_magnitude(),
    "wavelet": ind.wavelet(),
    "window_stats": ind.window_stats(),
    "auto_indicator": ind.lags_and_stats(["mid"]),
}.items():
    add(_name, _op)

for _name, _fn in {
    "macd": lambda d, o: ind.macd(d, "mid", order=o),
    "squeeze": lambda d, o: ind.squeeze(d, order=o),
    "adaptive_ma": lambda d, o: ind.kama(d, order=o),
    "kalman_ma": lambda d, o: ind.kalman_ma(d, order=o),
    "supertrend": lambda d, o: ind.supertrend(d, order=o),
    "volume": lambda d, o: ind.obv_mfi(d, order=o),
    "order_flow": lambda d, o: ind.order_flow(d, order=o),
    "stl": lambda d, o: ind.trend_seasonal(d, order=o),
    "vwap": lambda d, o: ind.anchored_vwaps(d, order=o),
    "microprice": lambda d, o: mk.microprice(d),
    "time": lambda d, o: d.withColumns(mk.time_features()),
    "sessions": lambda d, o: d.withColumns(mk.session_onehot()),
}.items():
    FEATURES[_name] = _fn


def build_features(df: DataFrame, names: Sequence[str], order: Order = TICKS, strict: bool = True) -> DataFrame:
    """P01 run registered operators: bounded ones share one blocked pass, the rest follow in order."""
    ops = [FEATURES[n] for n in names]
    rows = [o for o in ops if isinstance(o, RowOp)]
    if rows:
        df = apply_together(df, rows, order, strict)
    for o in ops:
        if not isinstance(o, RowOp):
            df = o(df, order)
    return df


def score_text(df: DataFrame, scorer: Callable[[list[str]], list[float]], text: str = "text", out: str = "score") -> DataFrame:
    """P07 score a text column with any batch function; it travels to the executors with the job."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for pdf in batches:
            pdf[out] = [float(x) for x in scorer(pdf[text].fillna("").tolist())]
            yield pdf[schema.names]

    return df.mapInPandas(run, schema)


def label_sign(label: str = "label", score: str = "score"):
    """P07 signed score of a classified text: positive +, negative -, anything else 0."""
    low = F.lower(label)
    return F.when(low.startswith("pos"), F.col(score)).when(low.startswith("neg"), -F.col(score)).otherwise(0.0)


def per_key(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: Order = TICKS, back: int = 0, ahead: int = 0) -> DataFrame:
    """P06 a pandas function per block of a key's rows: groups stay small however long a key is.

    ``fn`` gets the rows of a block in their order, with ``back`` rows before and
    ``ahead`` after it, and returns a row (or none) for each under the same index; those
    of the block itself are kept.  So a function that looks no further sees no edge.
    """
    rows, _ = halo_blocks(df, order, back, ahead)
    columns = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX, ignore_index=True)
        out = fn(pdf[columns])
        return out[(pdf[BLK] == pdf["__home"]).reindex(out.index).to_numpy()]

    return rows.groupBy(*order.keys, BLK).applyInPandas(run, schema)
