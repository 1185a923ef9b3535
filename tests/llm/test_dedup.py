import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from ticklake.llm.components import components
from ticklake.llm.exact_dedup import deduplicated, exact_duplicates, normalised
from ticklake.llm.near_dedup import Shingler, Sketcher, near_duplicates

from . import edge

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows, k, percent):
    """Smallest reachable id per id."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    ra, rb = sorted((find(a), find(b)))
                    root[rb] = ra
    return {i: find(i) for i in sets}


def test_near_edge_rows(spark):
    df = edge.docs(spark)
    got = near_duplicates(df, words=4).collect()
    assert len(got) == len(edge.rows())
    want = brute([r[:2] for r in edge.rows()], 4, 80)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    n = {r.doc_id: r.n_shingles for r in got if r.doc_id is not None}
    assert n[1] == n[2] == n[4] == 0 and n[8] == 1 and n[7] == 60_000 - 3
    assert near_duplicates(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("seed,block_rows", [(1, 64), (2, 3)])
def test_near_families_against_brute_force(spark, seed, block_rows):
    """Chains, stars and families just under the threshold, where a star alone loses links."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(int(rng.integers(6, 60)))]
        last = base
        for _ in range(12):
            w = list(last if rng.random() < 0.5 else base)
            for _ in range(int(rng.integers(1, 4))):
                w[int(rng.integers(len(w)))] = f"x{n}r{rng.integers(9)}"
            last = w
            rows.append((n * 7 % 1009, " ".join(w)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, words=2, block_rows=block_rows).collect()}
    assert got == brute(rows, 2, 80)


@pytest.mark.parametrize("limit", [{}, {"room": 4000}])
def test_near_family_is_sent_a_few_times(spark, monkeypatch, limit):
    """Sets just under the threshold of each other go to a bounded number of tasks, not to one for every other block."""
    head = [f"h{i}" for i in range(100)]
    rows = [(i, " ".join(head + [f"u{i}x{j}" for j in range(13 + i % 4)])) for i in range(120)]
    rows += [(200 + i, " ".join(head + [f"u{i}x{j}" for j in range(13 + i % 4)] + [f"v{i}"])) for i in range(0, 120, 40)]
    sent, real = [], GroupedData.applyInPandas

    def spy(self, *args):
        sent.append(self._df.selectExpr("count(*)", "sum(size(hashes))").first())
        return real(self, *args)

    monkeypatch.setattr(GroupedData, "applyInPandas", spy)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1, block_rows=4, **limit).collect()}
    assert got == brute(rows, 1, 80)
    assert sum(n for n, _ in sent) <= 4 * len(rows)  # a set went to 30 tasks before
    assert spark.conf.get(key, None) == before
    whole = sum(h or 0 for _, h in sent)
    if limit:
        assert len(sent) == -(-whole // max(4000, sum(len(set(t.split())) for _, t in rows) // 4)) > 1
    else:
        assert len(sent) == 1


def test_shingler_and_sketch():
    s = Shingler(3)
    assert len(s(b"")) == 0 and len(s(b" \n\t")) == 0
    assert s(b"A b\tC d")[0] == s(b"a B c  d")[0] and len(s(b"a b c d")) == 2
    assert len(s(b"a b")) == 1 and s(b"a b")[0] != s(b"ab")[0]
    long = b" ".join(b"%d" % i for i in range(70_000))  # over more than one block
    assert len(s(long)) == 70_000 - 2
    k = Sketcher(8, 4)
    one = k(s(b"x y z"))
    assert len(one) == 8 and (one == k(s(b"X Y Z"))).all()


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_edge_rows(spark, weak):
    """``weak`` digests collide, so the byte check has to part the groups."""
    digest = (lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)) if weak else None
    _, v = exact_duplicates(edge.docs(spark), **({"digest": digest} if weak else {}))
    got = v.collect()
    rows = edge.rows()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    of = {i: g for g in groups.values() for i in g if i is not None}
    kept = sum(r.kept for r in got)
    assert kept == len(groups)
    for r in got:
        if r.doc_id is not None:
            g = of[r.doc_id]
            assert r.group_size == len(g) and r.keep_id == min(x for x in g if x is not None)
    assert [r.doc_id for r in got if r.kept and r.doc_id == 9] == [9]


def test_exact_empty_and_columns(spark):
    _, v = exact_duplicates(edge.empty(spark))
    assert v.count() == 0
    df = edge.docs(spark)
    out = deduplicated(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == [1, 3, 4, 7, 8, 9, 10, 11]


def test_state_goes_on(spark, tmp_path):
    """A later batch is held against the digests of an earlier one."""
    folder = str(tmp_path / "index")
    exact_duplicates(spark.createDataFrame([(7, "a"), (8, "b")], "doc_id long, text string"), folder=folder)
    _, v = exact_duplicates(spark.createDataFrame([(9, "a"), (1, "c")], "doc_id long, text string"), folder=folder)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in v.collect()} == {7: (7, 2), 9: (7, 2), 8: (8, 1), 1: (1, 1)}


def test_bytes_are_checked_on_hits_of_an_earlier_call(spark, tmp_path):
    """With digests that collide, a later call follows the locators kept in state."""
    weak = lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)
    folder = str(tmp_path / "index")
    for name, rows in (("a b", [(5, "aa"), (6, "cc")]), ("c%d", [(1, "zz"), (7, "aa")]), ("e", [(2, "cc"), (None, "zz")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        _, v = exact_duplicates(spark.read.parquet(str(tmp_path / name)).where("text <> ''"), folder=folder, digest=weak)
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in v.collect())
    assert got == [("1", 1, 2, True), ("2", 2, 2, True), ("5", 5, 2, True), ("6", 2, 2, False), ("7", 5, 2, False), ("None", 1, 2, False)]


def test_normalised(spark):
    df = spark.createDataFrame([("a \t\r\n\x0b\x0cb\x1cc d",), (None,)], "text string").select(normalised().alias("t"))
    assert [r.t for r in df.collect()] == ["a b\x1cc d", ""]
