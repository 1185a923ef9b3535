"""Joins of slow-moving context (J01-J16, J20, J21, IO16, IO18)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import symbol_variants, words
from ..plans.asof import asof_join
from ..plans.ordered import TICKS, Order, micros
from .base import nz

c = F.col


def add_context(df: DataFrame, context: DataFrame, cols: Sequence[str], date: str = "Date", fill: float | None = 0.0, tie: Sequence[str] = (), order: Order = TICKS) -> DataFrame:
    """J01 newest context row of the key at or before each row; missing values become ``fill``."""
    d = asof_join(df, context, cols, date, tie, order)
    return d if fill is None else d.fillna(fill, list(cols))


def add_market_context(df: DataFrame, series: DataFrame, cols: Sequence[str], date: str = "Date", order: Order = TICKS) -> DataFrame:
    """J03 as-of join without a key (an index or a macro series): rows meet by time bucket."""
    return asof_join(df, series, cols, date, (), order.with_keys())


def macro_long(df: DataFrame, series: Sequence[str], date: str = "Date", region: str = "Region") -> DataFrame:
    """IO18 wide macro columns to (Date, Region, series, value) rows."""
    return df.unpivot([date, region], list(series), "series", "value").where(c("value").isNotNull())


def add_macro(
    df: DataFrame,
    macro: DataFrame,
    series: Sequence[str],
    delay_seconds: float | Mapping[str, float] = 0.0,
    region: str = "Region",
    fill: float = 0.0,
    order: Order = TICKS,
) -> DataFrame:
    """J04 macro series as they were known at each row: values count from their date plus a delay.

    ``macro`` is long (Date, Region, series, value).  A delay may be given per
    series (with or without the ``macro_`` prefix), ``default`` for the rest;
    negative delays count 0.
    """
    if isinstance(delay_seconds, Mapping):
        known = {k.removeprefix("macro_"): max(float(v), 0.0) for k, v in delay_seconds.items()}
        default = known.get("default", 0.0)
        delays = {s: known.get(s, default) for s in series}
    else:
        delays = {s: max(float(delay_seconds), 0.0) for s in series}
    for s in series:
        # one pass per delay group would also do; series are few and named
        when = F.timestamp_micros(micros("Date") + int(delays[s] * 1_000_000)).cast("timestamp_ntz")
        one = macro.where(c("series") == s).select(region, when.alias("__from"), c("value").alias(f"macro_{s}"))
        df = asof_join(df, one, [f"macro_{s}"], "__from", (), order.with_keys(region))
    return df.fillna(fill, [f"macro_{s}" for s in series])


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """J02 exact match on (symbol, time)."""
    return df.join(table.select(*on, *cols), list(on), "left")


def in_windows(df: DataFrame, windows: DataFrame, order: Order = TICKS, bucket_seconds: int = 3600) -> DataFrame:
    """J05 ``quiet``: the row's time lies in a window (start, end, Symbol), both ends included.

    Windows are spread over the time buckets they touch, so this is an equi join
    on (Symbol, bucket), not a nested loop.
    """
    us = bucket_seconds * 1_000_000
    slot = lambda ts: F.floor(micros(ts) / us).cast("long")
    w = windows.select("Symbol", "start", "end", F.explode(F.sequence(slot("start"), slot("end"))).alias("__b"))
    d = df.withColumn("__b", slot(order.ts))
    hit = d.join(w, ["Symbol", "__b"]).where((c(order.ts) >= c("start")) & (c(order.ts) <= c("end")))
    ids = [*order.keys, order.ts, *order.tie]
    flagged = hit.select(*ids).distinct().withColumn("quiet", F.lit(True))
    return df.join(flagged, ids, "left").fillna(False, ["quiet"])


def windows_by_currency(windows: DataFrame, symbols: DataFrame) -> DataFrame:
    """J05 windows of currencies to windows of symbols: a currency matches the symbols whose name holds it."""
    cur = windows.select("start", "end", F.explode("currencies").alias("__c"))
    parts = symbols.select("Symbol").distinct().withColumn("__c", F.explode(name_parts(c("Symbol"))))
    return cur.join(parts, "__c").select("start", "end", "Symbol").distinct()


def name_parts(name: Column) -> Column:
    """All three-letter pieces of a name: currency codes in it are found by an equi join."""
    return _pieces(F.upper(name))


def join_on_time(df: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """J06 equi join on Timestamp."""
    return df.join(table, "Timestamp", how)


def add_dimension(df: DataFrame, dim: DataFrame, on: str, cols: Sequence[str], fill: float = 0.0) -> DataFrame:
    """J07 dimension columns by key; the optimiser broadcasts small dimensions and splits skewed keys."""
    return df.join(dim.select(on, *cols), on, "left").fillna(fill, list(cols))


def funding_costs(df: DataFrame, info: DataFrame) -> DataFrame:
    """J07 swap rate, margin requirement and leverage by symbol."""
    d = add_dimension(df, info, "Symbol", ["swap_rate", "margin_requirement"])
    return d.withColumn("account_leverage", F.coalesce(1 / nz(c("margin_requirement")), F.lit(0.0)))


def statements_and_ratios(statements: DataFrame, ratios: DataFrame, macro: DataFrame | None = None) -> DataFrame:
    """IO16/J12 statements and ratios of a symbol and date, either side may miss; macro by date."""
    d = statements.join(ratios, ["Date", "Symbol"], "full")
    return d if macro is None else d.join(macro, "Date", "left")


def keyword_matches(
    texts: DataFrame, keywords: DataFrame, text: str = "text", row_id: str = "id", max_listed: int = 100_000, frame_bytes: int = 64 << 20
) -> DataFrame:
    """J13 (id, symbol), once each, where the lower-cased text contains one of the symbol's keywords.

    Texts are dealt into buckets of about ``frame_bytes`` and keywords into
    parts of about ``max_listed``; every bucket meets every part in a task, which
    goes over each text once with an automaton of the part's words.  One way for all
    sizes, and only the two sums that set the number of buckets and parts reach the driver.

    Blank keywords and null or empty texts match nothing.
    """
    low = texts.select(row_id, F.lower(text).alias("__t")).where("__t <> ''")
    kw = keywords.select("symbol", F.lower(F.trim("keyword")).alias("__k")).where("__k <> ''").distinct()
    parts = kw.count() // max(max_listed, 1) + 1
    buckets = int((low.agg(F.sum(F.octet_length("__t"))).first()[0] or 0) // frame_bytes) + 1
    left = low.select("*", F.pmod(F.xxhash64(row_id, "__t"), F.lit(buckets).cast("long")).alias("__b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__p"))
    right = kw.select("symbol", "__k", F.pmod(F.xxhash64("__k"), F.lit(parts)).cast("int").alias("__p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("__b"))
    schema = T.StructType([low.schema[row_id], kw.schema["symbol"]])

    def scan(rows: pa.Table, words: pa.Table) -> pa.Table:
        automaton, symbols = ahocorasick.Automaton(), {}
        for symbol, word in zip(words["symbol"].to_pylist(), words["__k"].to_pylist()):
            symbols.setdefault(word, []).append(symbol)
            automaton.add_word(word, word)
        places, found = [], []
        if symbols:
            automaton.make_automaton()
            for i, t in enumerate(rows["__t"].to_pylist()):
                own = {s for word in {w for _, w in automaton.iter(t)} for s in symbols[word]}
                places += [i] * len(own)
                found += own
        return pa.table({row_id: rows[row_id].take(pa.array(places, pa.int64())), "symbol": pa.array(found, words.schema.field("symbol").type)})

    return left.groupBy("__b", "__p").cogroup(right.groupBy("__b", "__p")).applyInArrow(scan, schema).distinct()


def _pieces(text: Column, n: int = 3) -> Column:
    """Distinct overlapping pieces of ``n`` letters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def ticker_matches(symbols: DataFrame, tickers: DataFrame) -> DataFrame:
    """J14 tickers that begin with a spelling of the symbol or are the beginning of one.

    Both sides are expanded to their prefixes, so each direction is an equi join.
    """
    sv = symbols.select(c("Symbol"), F.explode(symbol_variants(c("Symbol"))).alias("__v"))
    tk = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    prefixes = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda n: F.substring(x, F.lit(1), n))
    down = tk.withColumn("__v", F.explode(prefixes(c("ticker")))).join(sv, "__v").select("Symbol", "ticker")
    up = sv.withColumn("ticker", F.explode(prefixes(c("__v")))).join(tk, "ticker").select("Symbol", "ticker")
    return down.unionByName(up).distinct()


def broker_spreads(quotes: DataFrame, keys: Sequence[str] = ("Symbol",), broker: str = "broker") -> DataFrame:
    """J15 distance of the newest mids of each broker pair (a < b) of a symbol.

    Pairs are made only between the brokers of a symbol after its quotes are
    reduced to one per broker.
    """
    last = quotes.groupBy(*keys, broker).agg(F.max_by("mid", F.struct("Timestamp", *[x for x in ("seq",) if x in quotes.columns])).alias("mid"))
    a = last.select(*keys, c(broker).alias("a"), c("mid").alias("mid_a"))
    b = last.select(*keys, c(broker).alias("b"), c("mid").alias("mid_b"))
    d = a.join(b, list(keys)).where(c("a") < c("b"))
    return d.withColumn("spread", F.abs(c("mid_a") - c("mid_b")))


def arbitrage(quotes: DataFrame, threshold: float, **kw) -> DataFrame:
    """J15 broker pairs further apart than ``threshold``, with the side to buy on."""
    d = broker_spreads(quotes, **kw).where(c("spread") > threshold)
    return d.withColumn("buy_at", F.when(c("mid_a") < c("mid_b"), c("a")).otherwise(c("b")))


def event_distance(df: DataFrame, events: DataFrame, event_ts: str = "event_ts", first_only: bool = False, order: Order = TICKS) -> DataFrame:
    """J16/X26 minutes to the next and from the last event, nearest, and whether one is within the hour.

    ``first_only`` measures everything from the first event alone.
    """
    if first_only:
        from ..plans.ordered import with_row

        d = with_row(df, events.agg(F.min(event_ts).alias("__e")))
        gap = (micros("__e") - micros(order.ts)) / 60e6
        d = d.withColumn("minutes_to_event", gap).withColumn("minutes_from_event", -gap)
        near = F.abs("minutes_to_event")
        d = d.drop("__e")
    else:
        keys = list(order.keys) if all(k in events.columns for k in order.keys) else []
        o = order.with_keys(*keys)
        e = events.select(*keys, c(event_ts).alias("__ets"))
        d = asof_join(df, e, [], "__ets", (), o, keep_ts="__last")
        d = asof_join(d, e, [], "__ets", (), o, forward=True, keep_ts="__next")
        d = d.withColumn("minutes_to_event", (micros("__next") - micros(order.ts)) / 60e6)
        d = d.withColumn("minutes_from_event", (micros(order.ts) - micros("__last")) / 60e6)
        near = F.least(F.abs("minutes_to_event"), F.abs("minutes_from_event"))
        d = d.drop("__last", "__next")
    d = d.withColumn("nearest_news_minutes", near)
    soon = (c("minutes_to_event") >= 0) & (c("minutes_to_event") <= 60)
    return d.withColumn("upcoming_red_news", F.coalesce(soon, F.lit(False)).cast("int"))


# ---------------------------------------------------------------- graphs


def knowledge_edges(supply: DataFrame, sectors: DataFrame, countries: DataFrame, events: DataFrame) -> DataFrame:
    """J21 edges (src, dst, relation): supply chain, company and currency, currency and event, company and sector.

    A sector links its companies through the sector node; all company pairs of
    a sector are never written out.
    """
    s = lambda x: c(x).cast("string")
    return (
        supply.select(s("supplier").alias("src"), s("customer").alias("dst"), F.lit("supply_chain").alias("relation"))
        .unionByName(countries.select(s("company").alias("src"), s("currency").alias("dst"), F.lit("country").alias("relation")))
        .unionByName(events.where(c("currency").isNotNull()).select(s("currency").alias("src"), s("id").alias("dst"), F.lit("event").alias("relation")))
        .unionByName(sectors.select(s("company").alias("src"), s("sector").alias("dst"), F.lit("sector").alias("relation")))
    )


def graph_scores(companies: DataFrame, sectors: DataFrame, countries: DataFrame, events: DataFrame) -> DataFrame:
    """J20 per company: events of its currencies (two hops) and companies sharing its sectors."""
    per_cur = events.where(c("currency").isNotNull()).groupBy("currency").agg(F.countDistinct("id").alias("__n"))
    risk = countries.select("company", "currency").join(per_cur, "currency").groupBy("company").agg(F.sum("__n").cast("double").alias("risk_score"))
    size = sectors.groupBy("sector").agg((F.count(F.lit(1)) - 1).alias("__m"))
    opp = sectors.join(size, "sector").groupBy("company").agg(F.sum("__m").cast("double").alias("opportunity_score"))
    d = companies.select("company").distinct().join(risk, "company", "left").join(opp, "company", "left")
    return d.fillna(0.0, ["risk_score", "opportunity_score"])


def node_degree(edges: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """J20 edges per (time, node) whose weight is above ``min_weight`` in size."""
    return edges.where(F.abs("weight") > min_weight).groupBy("Timestamp", "src").agg(F.count(F.lit(1)).alias("degree"))
