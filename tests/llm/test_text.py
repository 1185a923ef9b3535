import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest

from ticklake.llm.decontaminate import Finder, contaminated, decontaminated, normal
from ticklake.llm.quality import calibrate, dual_coordinate_descent, good, held_out, quality_scores
from ticklake.llm.toxicity import GRADES, Terms, severities

from . import edge

SMALL = "/root/testdata/sf0.01"


def sellers(item, text):
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev)


def test_finder_against_full_alignment():
    rng = random.Random(5)
    items = [(k, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 12)))) for k in range(25)]
    f = Finder(items, 0.1)
    budget = {i: int(k) for (i, _), k in zip(f.items, f.edits)}
    for _ in range(60):
        parts = []
        for _ in range(3):
            k, t = rng.choice(items)
            s = list(t)
            for _ in range(rng.randint(0, budget[k] + 2)):
                at = rng.randrange(len(s))
                s[at : at + rng.choice((0, 1))] = rng.choice(("", "x", "y"))
            parts += ["".join(s), "zz yy"]
        text = " ".join(parts)
        got = {h[0]: h[1:] for h in f(text)}
        for k, t in f.items:
            best = sellers(t, normal(text))
            assert (best <= budget[k]) == (k in got)
            if k in got:
                edits, start, end = got[k]
                assert edits == best == sellers(t, normal(text)[start:end])


def test_finder_over_slices(monkeypatch):
    monkeypatch.setattr("ticklake.llm.decontaminate._SLICE", 64)
    item = "the quick brown fox jumps over the lazy dog again"
    f = Finder([(1, item)], 0.1)
    for pad in range(0, 200, 7):
        (hit,) = f("p" * pad + " " + item.upper() + " tail" * 20)
        assert hit[:2] == (1, 0) and hit[3] - hit[2] == len(item)


def test_finder_on_text_that_repeats_itself():
    """Items of period 1, 2 and 3, whole and with edits, in short texts of the same period."""
    rng = random.Random(9)
    items = [(0, "-" * 40), (1, "ab" * 25), (2, "ab " * 20 + "a"), (3, "-" * 30 + "x" + "-" * 30), (4, "=" * 12), (5, "abcabdabc" * 6)]
    f = Finder(items, 0.1)
    budget = {i: int(k) for (i, _), k in zip(f.items, f.edits)}
    for base in ("-" * 150, "ab" * 80, "ab " * 60, "=" * 11, "-" * 35 + "y" + "-" * 35, "abcabdabc" * 12, "-=" * 50):
        for edits in (0, 1, 3, 9):
            s = list(base)
            for _ in range(edits):
                at = rng.randrange(len(s))
                s[at : at + rng.choice((0, 1))] = rng.choice(("", "x", "-"))
            text = normal("".join(s))
            got = {h[0]: h[1:] for h in f(text.decode())}
            for k, t in items:
                best = sellers(normal(t), text)
                assert (best <= budget[k]) == (k in got)
                if k in got:
                    assert got[k][0] == best == sellers(normal(t), text[got[k][1] : got[k][2]])


@pytest.mark.parametrize("item,text", [("-" * 1000, "-" * 260_000), ("-" * 120, "-" * 260_000), ("ab " * 300, "ab " * 90_000), ("-" * 500 + "x" + "-" * 499, "-" * 260_000)])
def test_finder_memory_on_text_that_repeats_itself(item, text):
    find = Finder([(1, item)], 0.1)
    tracemalloc.start()
    began = time.time()
    ((_, edits, start, end),) = find(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert edits == item.count("x") and start == 0 and end - start >= len(item.strip()) - edits
    assert peak < 300e6 and time.time() - began < 10  # seconds on a busy machine; about one alone


def test_contaminated_edge_rows(spark):
    items = spark.createDataFrame([(1, edge.BASE[:120]), (1, edge.BASE[:120]), (2, None), (3, "  "), (None, "w5x5 w6x6 w7x7"), (4, "ONE  two"), (5, "w59999")], "item_id long, text string")
    df = edge.docs(spark)
    for size in (4 << 20, 250):  # one block, and several
        got = sorted({(str(r.doc_id), str(r.item_id)) for r in contaminated(df, items, block_bytes=size).collect()})
        assert got == sorted([(d, "1") for d in ("3", "5", "9", "None")] + [("7", "None"), ("8", "4"), ("10", "4")] + [("7", "5")] * 0)
    for size in (4 << 20, 250):
        left = decontaminated(df, items, block_bytes=size)
        assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "11", "2", "4", "None"]
    assert contaminated(edge.empty(spark), items).count() == 0
    assert contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def joined(spark, df, target):
    rows = df.join(labels(spark), "doc_id").collect()
    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r[target] is not None]


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = quality_scores(docs, labels(spark))
    rows = joined(spark, out, "quality")
    assert all(r.held_out for r in rows)
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.9  # a few hundred rows to learn from
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_never_reads_held_out_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = quality_scores(docs, labels(spark)).collect()
    from pyspark.sql import functions as F

    b = quality_scores(docs, labels(spark).withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))).collect()
    assert sorted(a) == sorted(b)


def test_quality_edge_rows(spark):
    df = edge.docs(spark)
    l = spark.createDataFrame([(5, 1), (7, 0), (8, 1), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    got = quality_scores(df, l).collect()
    assert len(got) == len(edge.rows()) and all(0 <= r.score <= 1 for r in got)
    assert good(df, l, threshold=0.0).columns == df.columns and good(df, l, threshold=0.0).count() == len(got)
    assert quality_scores(edge.empty(spark), l).count() == 0
    none = quality_scores(df, l.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.array([int(y), 2 + int(rng.integers(20))]) for y in rng.integers(0, 2, 200)]
    y = np.array([1 if r[0] else -1 for r in rows])
    w, b = dual_coordinate_descent(rows, [np.ones(2) for _ in rows], y, 22)
    assert all(np.sign(w[r].sum() + b) == t for r, t in zip(rows, y))
    slope, _ = calibrate(np.array([w[r].sum() + b for r in rows]), y)
    assert slope > 0


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = joined(spark, severities(docs, labels(spark)).withColumnRenamed("toxic", "flag"), "toxic")
    bad, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.flag for r in bad) >= 0.6 * len(bad) and sum(r.flag for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r.severity <= GRADES - 1 for r in rows)


def test_toxicity_edge_rows(spark):
    df = edge.docs(spark)
    l = spark.createDataFrame([(5, 1), (7, 0), (8, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert severities(df, l).count() == len(edge.rows())
    assert severities(edge.empty(spark), l).count() == 0
    assert not any(r.toxic for r in severities(df, l.limit(0)).collect())


def test_terms_of_long_words(monkeypatch):
    def found(text):
        slot, count, words = Terms()(text.encode())
        return list(zip(slot.tolist(), count.tolist())), words

    glued = "nicewords" * 30
    assert found(glued + "x") != found(glued + "y") and found("a" * 64 + "b")[0] != found("a" * 64 + "c")[0]
    late = {s for s, _ in found(glued + "moron" + glued)[0]}
    assert {s for s, _ in found("moro")[0]} & late  # its beginning counts where no word begins
    texts = ["今天天气很好我们去公园散步" * 20 + "笨蛋", glued + "é" * 50, "a b " + glued + " c"]
    whole = [found(t) for t in texts]
    monkeypatch.setattr("ticklake.llm.toxicity._SLICE", 7)
    assert [found(t) for t in texts] == whole


def test_toxicity_late_in_text_without_blanks(spark):
    rng = random.Random(3)
    chars = "今天气很好我们去公园散步看书喝茶听音乐学习工作朋友家人山水花草"
    plain = lambda n: "".join(rng.choice(chars) for _ in range(n))
    text = lambda bad, n: plain(n) + ("笨蛋滚开" if bad else "") + plain(20)
    rows = [(i, text(i % 2, rng.randint(30, 90)), i % 2) for i in range(400)] + [(1000 + i, text(i % 2, rng.randint(30, 90)), None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = severities(df.select("doc_id", "text"), df.where("toxic is not null").select("doc_id", "toxic")).where("doc_id >= 1000").collect()
    assert len(got) == 20 and all(r.toxic == (r.doc_id % 2 == 1) for r in got)


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("ab cd", 1)])
def test_normal(text, n):
    assert normal(f" {text.upper()}\n") == text.encode() and (len(normal(text)) > 0) == bool(n)
