"""Nearest earlier rows by levels, streams step by step, nearest texts in bounded blocks, words cut without a pattern."""

import math
import tempfile
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticklake.operators import news, quality, similar
from ticklake.streaming import ticks as st

KEYS = ["Symbol", "__level"]


def tmp():
    return tempfile.mkdtemp(prefix="round4-") + "/x"


# --- F1 ---


def sent(spark, v):
    """Rows that the second pass sends to blocks, per row."""
    table = spark.createDataFrame([("A", i, *map(float, x), 0.0) for i, x in enumerate(v)], "Symbol string, i long, a double, b double, r double")
    blocks = similar.cell_blocks(similar.leveled(table, ["Symbol"], ["a", "b"], 5, 64), KEYS, ["a", "b"], 64).cache()
    first = similar.first_pass(blocks, KEYS, 2, 5).cache()
    assert blocks.agg(F.sum("n")).first()[0] <= 3 * len(v)  # all levels together
    return (similar.open_pairs(blocks, first, KEYS, ["a", "b"]).agg(F.sum(F.size("rows"))).first()[0] or 0) / len(v)


def test_rows_sent_grow_with_the_rows(spark):
    v = np.random.default_rng(3).normal(size=(24_000, 2))
    few, many = sent(spark, v[:6_000]), sent(spark, v)
    assert many < 1.3 * few + 0.2


def test_rows_at_one_place_meet_the_first_of_them(spark):
    assert sent(spark, np.zeros((6_000, 2))) == 0
    table = spark.createDataFrame([("A", i, 1.0, 2.0, float(i)) for i in range(3_000)], "Symbol string, i long, a double, b double, r double")
    got = {r.i: [e.j for e in r.near] for r in similar.nearest_earlier(table, ["Symbol"], ["a", "b"], 3, 64).collect()}
    assert got == {i: list(range(min(i, 3))) for i in range(1, 3_000)}


# --- F2, F3 ---


@pytest.mark.parametrize("ddof", [0, 1])
def test_windows_equal_pandas(ddof):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    x[rng.random(400) < 0.3] = np.nan
    x[200:260] = np.nan
    for cut in (0, 7, 100):
        got = list(st._rolled(x[max(0, cut - 50) : cut].tolist(), x[cut:], 50, ddof))
        m, s, w = (np.concatenate([g[n] for g in got]) for n in (2, 3, 4))
        want = [pd.Series(x[max(0, i - 49) : i + 1]) for i in range(cut, 400)]
        assert np.allclose(m, [v.mean() for v in want], equal_nan=True) and np.allclose(s, [v.std(ddof=ddof) for v in want], equal_nan=True)
        assert np.array_equal(w, [(v > 0).mean() for v in want])


def test_health_and_equity_over_batches(spark, monkeypatch):
    monkeypatch.setattr(st, "STEP", 16)
    n, t0 = 300, datetime(2024, 1, 1)
    pnl = np.random.default_rng(5).integers(-5, 6, n).astype(float)
    rows = [("x", t0 + timedelta(minutes=i), i, float(v)) for i, v in enumerate(pnl)] + [(None, t0, n, 1.0)]
    schema = "key string, Timestamp timestamp_ntz, seq long, pnl double"
    path = tmp()
    for part in (rows[:40], rows[40:45], rows[45:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: st.tick_stream(spark, path, spark.createDataFrame([], schema).schema)
    out, ck, out2, ck2 = tmp(), tmp(), tmp(), tmp()
    st.run_available(st.algorithm_health(stream(), key="key", n=20, cooldown_seconds=600.0, tie=["seq"]), out, ck)
    st.run_available(st.equity(stream(), key="key", n=20), out2, ck2)
    health = spark.read.parquet(out).where("key is not null").orderBy("Timestamp").collect()
    curve = spark.read.parquet(out2).orderBy("seq").collect()
    assert len(health) == n and len(curve) == n + 1 and curve[-1].key is None
    until, peak = -1.0, -math.inf
    for i in range(n):
        w = pd.Series(pnl[max(0, i - 19) : i + 1])
        sharpe = w.mean() / (w.std() + 1e-8) * math.sqrt(len(w)) if len(w) > 1 else 0.0
        if until < 0 or i * 60 >= until:
            until = -1.0 if sharpe >= 0 and (w > 0).mean() >= 0.5 else i * 60 + 600.0
        peak = max(peak, pnl[: i + 1].sum())
        sd = w.std(ddof=0)
        assert health[i].sharpe == pytest.approx(sharpe) and health[i].enabled == (until < 0)
        assert curve[i].equity == pnl[: i + 1].sum() and curve[i].drawdown == peak - curve[i].equity
        assert curve[i].sharpe == pytest.approx(w.mean() / sd if sd > 0 else 0.0)


# --- F4 ---


def test_filter_in_steps_and_bounded_batches(spark, ticks):
    from dataclasses import replace

    from ticklake.catalog.streams import FILES, _arrive

    d = ticks.withColumns({"Ask": F.col("mid") + 0.01 + F.col("Volume") * 0.0005, "Bid": F.col("mid") - 0.01}).select("Symbol", "Timestamp", "seq", "Bid", "Ask")
    t, out, ck = SimpleNamespace(spark=spark), tmp(), tmp()
    stream = _arrive(t, d, most=100)  # 823 rows
    seen = []
    st.run_batches(stream, lambda batch, _: seen.append(batch.count()), tmp())
    assert sum(seen) == 823 and len(seen) == 9 and max(seen) < 130 and FILES == 4
    st.run_available(st.filter_stream(stream, 2.0, order=replace(st.TICKS, scan_rows=16)), out, ck)
    want = quality.online_filter(d, 2.0).where("accepted").select("seq")
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == sorted(r.seq for r in want.collect())


# --- F5 ---


def test_nearest_texts_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(news, "SIMILARITIES", 30)
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 9)))
    docs = spark.createDataFrame([(i, text()) for i in range(150)] + [(200, None)], "id long, text string").coalesce(1)
    queries = spark.createDataFrame([(i, text()) for i in range(7)], "qid long, text string")
    got = {}
    for r in news.similar_events(docs, queries, 4, block=3).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.id, r.similarity)

    def dense(df, key):
        out = {r[0]: np.zeros(32) for r in df.collect()}
        for r in news.embed_long(df.where("text is not null"), row_id=key).collect():
            out[r[0]][r.slot] = r.weight
        return out

    v, q = dense(docs, "id"), dense(queries, "qid")
    for k, x in q.items():
        want = sorted((-round(1 - math.sqrt(max(2 - 2 * x @ y, 0.0)) / 2, 6), i) for i, y in v.items())[:4]
        assert [round(got[k][n][1], 6) for n in range(1, 5)] == [-s for s, _ in want]


# --- op1 ---


def test_common_words_are_cut_without_the_pattern(monkeypatch):
    from ticklake.llm import tokens

    words = ["plain", "Größe,", "ende...", "Ünï-", "a", "x)!", "it's", "l'eau,", "a1b", "12.", "--", "don't.", "<|x|>", "né'", "e_mail_", "ab\x01", "ªº.", "naïve;", "\u0130x", "e\u0301a."]
    file = tokens.path(tokens.WORD_BPE)
    whole, encoder = tokens.tokenizer(file), tokens.WordEncoder(file)
    for w in words:
        assert list(np.frombuffer(encoder[w], "<u4")) == whole.encode(w, add_special_tokens=False).ids, w
    monkeypatch.setattr(tokens, "_WORD_RUNS", None)
    fresh = tokens.WordEncoder(file)
    for w in ("plain", "Größe,", "ende...", "naïve;", "e_mail_"[:1] + "__"):
        assert fresh[w] == encoder[w]
